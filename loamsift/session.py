"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lets the per-label caps (up to 3,500 rows) be cut inside map tasks as well
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}

_local_scratch: dict[str, str] = {}


def build(master: str | None = None, app: str = "loamsift", **conf: str) -> SparkSession:
    """A session with our defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode."""
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="loamsift-")
    return _local_scratch[app]


def app_folder(spark: SparkSession) -> str:
    """This application's part of the scratch folder."""
    return f"{scratch_root(spark)}/loamsift/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the scratch folder."""
    return f"{app_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote to the scratch folder; call it when done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(app_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors.

    ``codec`` is another compression than the session's.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out over the cores when most of them would stay idle.

    A file cannot be read by more tasks than it has row groups, and cleaning costs far more than a
    shuffle. Inputs with twice as many splits as the cluster has cores are left alone unseen; of
    others the filled splits are counted, from the files' footers. What is no scan stays as it is.
    """
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    filled = df.select(F.spark_partition_id()).distinct().count()
    return df if 2 * filled > cores else df.repartition(cores)
