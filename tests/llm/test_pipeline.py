"""The pipeline's stages on a small folder: each works on what the one before kept."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.conftest import DOCS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    source = "/root/testdata/sf0.001"
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "s", 0)], DOCS)
    spark.read.parquet(f"{source}/documents.parquet").unionByName(extra).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, folder), name)
        results.append(docs)
        if name != "packing":
            assert docs.columns == columns
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in results]
    assert ids[0] == ids[1] and ids[1] >= ids[2] >= ids[3] == ids[4]
    lines = defaultdict(set)
    for r in results[1].collect():
        for x in (r["text"] or "").split("\n"):
            lines[x.strip(" \t\r\x0b\x0c").encode().lower()].add(r["doc_id"])
    assert all(len(own) < 10 for key, own in lines.items() if key)
    grams = lambda t: set(zip(*[re.findall(r"\S+", (t or "").lower())[i:] for i in range(5)]))
    sets = {r["doc_id"]: grams(r["text"]) for r in results[2].collect()}
    for a in sets:
        for b in sets:
            assert a >= b or not sets[a] or len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    plain = lambda t: set(zip(*[re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())[i:] for i in range(5)]))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {r["doc_id"] for r in results[2].collect() if any(
        s and len(s & plain(r["text"])) >= 0.8 * len(s) for s in items)}
    assert ids[3] == ids[2] - hit
    run = corpus_pipeline.run(spark, folder)
    assert sorted(run.select("doc_id", "piece", "ids_crc32").collect()) == sorted(
        results[4].select("doc_id", "piece", "ids_crc32").collect())


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path
    repo = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "loamsift", "suite"):
        (shutil.copytree if (repo / name).is_dir() else shutil.copy)(repo / name, tmp_path / name)
    shutil.rmtree(tmp_path / "loamsift" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'curate_v3' in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
