"""Rows chosen by their place in the files they are read from, so wide columns are never shuffled.

A decision about rows (which one of equal texts stays, which rows a cap keeps) is made on narrow
rows that carry a place: a 64-bit hash of the file's path and the position in the file as Parquet
counts it. ``choose`` turns kept places into bitmaps, one for every ``CHUNK`` rows of a
file, sends them to the tasks and filters the scan where it is read. At most ``SENT`` bitmaps (about
45 MB) go out at a time: files beyond that come in further portions, each a scan of its own files.

Two files of a million share a hash with a chance of 3 in 100 million.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.session import stash

PLACE = ("_place_file", "_place_row")
CHUNK = 4096  # rows of a bitmap
SENT = 1 << 16  # bitmaps sent at a time, each of about 700 bytes


def located(df: DataFrame) -> DataFrame:
    """``df``, which must be file-backed, with the place of every row."""
    return df.withColumns(dict(zip(PLACE, _place(), strict=True)))


def _place() -> tuple[Column, Column]:
    return F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")


def file_backed(df: DataFrame) -> DataFrame:
    """``df`` itself when its rows have places (a scan of Parquet files, filtered or projected).

    Anything else is written to the scratch folder and read back.
    """
    try:
        located(df).schema  # noqa: B018
        return df
    except AnalysisException:
        return stash(df, "placed")


def bitmaps(kept: DataFrame) -> DataFrame:
    """(_file, _chunk, _bits): the kept rows of every chunk that has one."""
    places = kept.select(*[F.col(c).alias(n) for c, n in zip(PLACE, ("_file", "_row"), strict=True)])
    word = F.floor(F.col("_row") % CHUNK / 64).cast("int")
    words = places.groupBy("_file", F.floor(F.col("_row") / CHUNK).alias("_chunk"), word.alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_row % 64 AS int)))").alias("_w"))
    by_word = F.map_from_entries(F.collect_list(F.struct("_word", "_w")))
    return words.groupBy("_file", "_chunk").agg(by_word.alias("_m")).select(
        "_file", "_chunk", F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 64 - 1)), lambda i: F.coalesce(
            F.element_at("_m", i), F.lit(0).cast("long"))).alias("_bits"))


def choose(df: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of a file-backed ``df`` whose places are in ``kept``; the scan is not shuffled."""
    sent = stash(bitmaps(kept), "bitmaps")
    portions = -(-sent.count() // SENT)
    out = None
    for p in range(max(1, portions)):
        own, rows = sent, df
        if portions > 1:
            own = sent.where(F.pmod("_file", F.lit(portions)) == p)
            # a condition on the path alone: other files are not opened
            rows = df.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(portions)) == p)
        part = _among(rows, own, df.columns)
        if portions > 1:  # one portion's bitmaps at a time
            part = stash(part, "chosen")
        out = part if out is None else out.unionByName(part)
    return out


def _among(df: DataFrame, sent: DataFrame, columns: list[str]) -> DataFrame:
    taken = {c.lower() for c in columns}
    file, row = (next(n for n in (f"{p}{i}" for i in range(len(taken) + 1)) if n not in taken) for p in PLACE)
    rows = df.withColumns(dict(zip((file, row), _place(), strict=True))).alias("r")
    marked = F.expr(f"(shiftright(b._bits[cast(floor(r.{row} % {CHUNK} / 64) AS int)], "
                    f"cast(r.{row} % 64 AS int)) & 1) = 1")
    same = (F.col(f"r.{file}") == F.col("b._file")) & (F.floor(F.col(f"r.{row}") / CHUNK) == F.col("b._chunk"))
    return rows.join(F.broadcast(sent.alias("b")), same & marked, "left_semi").drop(file, row)
