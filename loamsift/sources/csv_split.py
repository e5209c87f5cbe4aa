"""One large CSV file read by many tasks, although its fields may hold newlines.

A newline ends a record unless it lies inside quotes, which no task can tell from its own part of the
file. Spark's text source cuts a file into blocks of whole lines, and a block can begin in two ways:
at a record or inside a quoted field. So each block is scanned once for both beginnings and says in
which of the two states it ends: a function of two states, which keeps the state, swaps it or sets it.
Composing these functions in file order (a running sum of swaps since the last block that sets)
gives every block its true beginning. A second scan then cuts each block into records; the piece
before its first record and the open one at its end go, one row each, to the record they belong to.

Records are as the one-task reader sees them: quotes are doubled inside quotes; a quote opens only at
the beginning of a field and is text elsewhere; text after a closing quote belongs to the field;
empty lines are skipped. Lines end with ``\\n``, or ``\\r\\n`` if the first one does; then those inside quotes
become ``\\n``. The first record of every file is its header; files whose headers differ are refused.
Null bytes and encodings other than UTF-8 are not treated, and of fields with text between a closing
quote and the delimiter that holds further quotes and newlines, recovery may differ.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamsift.session import stash

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no import path

PLACED = ("_file", "_block", "_line")  # where a record begins
_LINE = "_file string, _block long, _line long"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of ``line`` lies inside quotes, given its beginning."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):  # a doubled quote
                at += 2
                continue
            inside, at = False, at + 1
        elif at == 0 and line.startswith('"'):
            inside, at = True, 1
        else:
            at = line.find(',"', at)
            if at < 0:
                return False
            inside, at = True, at + 2


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, value): the lines of each block in order, packed into tasks by Spark."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"), "value")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """((file, block), rows of the other columns) in order; a block may come in several pieces."""
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        rows = list(zip(*columns, strict=True))
        lo = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][:2] != rows[lo][:2]:
                yield rows[lo][:2], [r[2:] for r in rows[lo:i]]
                lo = i


def block_states(lines: DataFrame) -> DataFrame:
    """(_file, _block, _inside): whether each block begins inside quotes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ends = None, [False, True]
        for block, rows in _blocks(batches):
            if own != block:
                if own:
                    yield row(own, ends)
                own, ends = block, [False, True]
            for (line,) in rows:
                if line is not None:
                    ends = [ends_inside(line, e) for e in ends]
        if own:
            yield row(own, ends)

    def row(own: tuple, ends: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_file": [own[0]], "_block": [own[1]],
                                           "_plain": [ends[0]], "_quoted": [ends[1]]})
    # a line without quotes keeps the state and need not travel
    quoted = lines.withColumn("value", F.when(F.contains("value", F.lit('"')), F.col("value")))
    blocks = quoted.mapInArrow(run, "_file string, _block long, _plain boolean, _quoted boolean")
    until = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    swaps = (F.col("_plain") & ~F.col("_quoted")).cast("int")
    setting = F.when(F.col("_plain") == F.col("_quoted"), F.struct("_plain", "_swaps"))
    state = blocks.withColumn("_swaps", F.sum(swaps).over(until)).withColumns({
        "_set": F.last(setting, ignorenulls=True).over(before), "_so_far": F.last("_swaps").over(before)})
    turned = F.coalesce("_so_far", F.lit(0)) - F.coalesce("_set._swaps", F.lit(0))
    begins = F.coalesce(F.col("_set._plain"), F.lit(False)).cast("int") + turned
    return state.select("_file", "_block", (begins % 2 == 1).alias("_inside"))


WHOLE, CLOSING, BETWEEN, OPENING = range(4)  # kinds of pieces


def pieces(placed: DataFrame, crlf: bool) -> DataFrame:
    """(_file, _block, _line, _kind, _header, text): whole records, and parts of those across blocks.

    ``_line`` counts the records that begin in a block; parts that began earlier have -1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out, state = None, [], {}

        def begin(own: tuple, inside: bool) -> None:
            state.update(inside=inside, open=[], n=0, started=not inside, file=own[0], block=own[1])

        def put(kind: int) -> None:
            text = "\n".join(state["open"])
            own = state["started"]
            if crlf and kind in (WHOLE, CLOSING):
                text = text.removesuffix("\r")
            if own and state["block"] == 0 and state["n"] == 0:
                text = text.removeprefix("\ufeff")
            state.update(open=[], started=True)
            if kind == WHOLE and not text:
                return  # an empty line
            out.append((state["file"], state["block"], state["n"] if own else -1, kind,
                        own and state["block"] == 0 and state["n"] == 0, text))
            state["n"] += own

        def end() -> None:
            if state and state["open"]:
                put(OPENING if state["started"] else BETWEEN)
        for own, rows in _blocks(batches):
            if own != block:
                end()
                begin(own, bool(rows[0][1]))
                block = own
            for line, _ in rows:
                state["open"].append(line)
                state["inside"] = ('"' in line or state["inside"]) and ends_inside(line, state["inside"])
                if not state["inside"]:
                    put(WHOLE if state["started"] else CLOSING)
            if len(out) >= 1000:
                yield batch(out)
                out = []
        end()
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["_file", "_block", "_line", "_kind", "_header", "text"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows, strict=True), types, strict=True)], names=names)
    return placed.mapInArrow(run, _LINE + ", _kind int, _header boolean, text string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _line, _header, text): every record of the files, whole."""
    lines = lines_of(spark, path)
    # one row for each block that begins inside quotes: of 100 TB in blocks of 128 MB, 800,000 at most
    inside = block_states(lines).where("_inside")
    first = lines.select("value").first()
    crlf = first is not None and first["value"].endswith("\r")
    cut = stash(pieces(lines.join(F.broadcast(inside), ["_file", "_block"], "left"), crlf), "csv_records")
    names = ["_file", "_block", "_line", "_header", "text"]
    # at most two parts a block
    parts = cut.where(F.col("_kind") != WHOLE)
    begun = F.last(F.when(F.col("_kind") == OPENING, F.struct("_block", "_line")), ignorenulls=True).over(
        W.partitionBy("_file").orderBy("_block", "_line").rowsBetween(W.unboundedPreceding, 0))
    joined = parts.withColumn("_begun", begun).groupBy("_file", "_begun").agg(
        F.max("_header").alias("_header"),
        F.array_sort(F.collect_list(F.struct("_block", "_line", "text"))).alias("_parts"))
    text = F.concat_ws("\n", F.transform("_parts", lambda p: p["text"]))
    stitched = joined.select("_file", F.col("_begun._block").alias("_block"), F.col("_begun._line").alias("_line"),
                             "_header", text.alias("text"))
    out = cut.where(F.col("_kind") == WHOLE).select(*names).unionByName(stitched.select(*names))
    return out.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n"))) if crlf else out


def read_split(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """The columns of the files by their header, and ``PLACED``, where each record begins."""
    first = spark.read.options(**{**options, "header": "false"}).csv(path).first()
    if first is None:
        raise ValueError(f"{path} holds no record")
    header = [("" if c is None else c) for c in first]
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    parse = {k: v for k, v in options.items() if k not in ("header", "enforceSchema")}
    rows = records(spark, path).withColumn("_fields", F.from_csv("text", schema, parse))
    given = F.array(*[F.coalesce(F.col(f"_fields.c{i}"), F.lit("")) for i in range(len(header))])
    refused = F.raise_error(F.concat(F.lit("header differs from that of the first file: "), "text"))
    body = rows.where(F.when(F.col("_header"), F.when(given == F.array(*[F.lit(h) for h in header]), F.lit(
        False)).otherwise(refused.cast("boolean"))).otherwise(F.lit(True)))
    return body.select(*PLACED, *[F.col(f"_fields.c{i}").alias(h) for i, h in enumerate(header)])
