"""Large CSV in blocks against the one-task reader."""

import random

import pytest

from loamsift.sources import csv_split, readers


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def in_order(df):
    rows = sorted(df.collect(), key=lambda r: (r["_file"], r["_block"], r["_line"]))
    return [tuple(r)[3:] for r in rows]


def both(spark, path):
    one = [tuple(r) for r in readers.read_csv(spark, path).collect()]
    return one, readers.read_csv(spark, path, split=True)


PIECES = ["a", "b c", '"', "\n", "\r\n", ",", "é", "漢", '""', "\\", " ", "x" * 30]


@pytest.mark.parametrize("seed", range(6))
def test_rows_equal_the_one_task_reader(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    newline = ("\n", "\r\n")[seed % 2]
    lines = ["title, Body ,n"]
    for i in range(80):
        fields = []
        for _ in range(2):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7)))
            if rng.random() < 0.7:
                fields.append('"' + text.replace('"', '""') + '"')
            else:  # bare fields may hold quotes, not at their beginning
                fields.append("z" + "".join(c for c in text if c not in "\r\n,"))
        lines.append(",".join([*fields, str(i)]))
        if rng.random() < 0.05:
            lines.append("")
    path = f"{tmp_path}/one.csv"
    with open(path, "w", newline="") as f:
        f.write(newline.join(lines) + (newline if seed % 3 else ""))
    one, split = both(spark, path)
    assert in_order(split) == one and len(one) == 80
    assert split.columns == ["_file", "_block", "_line", "title", "body", "n"]
    assert split.select("_block").distinct().count() > 5  # many blocks, so many tasks


def test_fields_longer_than_blocks_and_other_shapes(spark, tmp_path, small_blocks):
    long = "line of it, \"\" and\n" * 300
    shapes = {"long": f'a,b\nx,"{long}"\ny,z\n', "header": "a,b\n", "short": 'a,b\n1\n"2"\n3,4,5\n',
              "bom": "﻿a,b\n1,2\n", "open": 'a,b\n1,"never closed\nx,y', "quoted header": '"a","b\n"\n1,2\n'}
    for name, text in shapes.items():
        path = f"{tmp_path}/{name}.csv"
        with open(path, "w", newline="") as f:
            f.write(text)
        one, split = both(spark, path)
        assert in_order(split) == one, name
    with open(f"{tmp_path}/none.csv", "w") as f:
        f.write("")
    with pytest.raises(ValueError, match="no record"):
        readers.read_csv(spark, f"{tmp_path}/none.csv", split=True)


def test_files_are_bound_by_one_header(spark, tmp_path, small_blocks):
    for name, text in {"a": "x,y\n1,2\n", "b": 'x,y\n3,"4\n5"\n'}.items():
        with open(f"{tmp_path}/{name}.csv", "w") as f:
            f.write(text)
    df = readers.read_csv(spark, str(tmp_path), ("y", "x"), split=True)
    assert in_order(df) == [("2", "1"), ("4\n5", "3")]
    stored = readers.store_with_row_ids(df, f"{tmp_path}/p")
    assert [tuple(r) for r in stored.orderBy("row_id").collect()] == [("2", "1", 0), ("4\n5", "3", 1)]
    with open(f"{tmp_path}/c.csv", "w") as f:
        f.write("y,x\n1,2\n")
    with pytest.raises(Exception, match="header differs"):
        readers.read_csv(spark, str(tmp_path), split=True).collect()


def test_block_functions_compose(spark, tmp_path, small_blocks):
    """Blocks that keep, swap or set the state, in long runs."""
    rng = random.Random(8)
    text = "h\n" + "".join(rng.choice(['"' + "q\n" * rng.randint(1, 90) + '"\n', "plain\n" * 20, 'a,"b"\n'])
                           for _ in range(60))
    path = f"{tmp_path}/s.csv"
    with open(path, "w") as f:
        f.write(text)
    got = {r["_block"]: r["_inside"] for r in csv_split.block_states(csv_split.lines_of(spark, path)).collect()}
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    for block, inside in got.items():
        # a block's first line is the first that begins after its start
        first = 0 if block == 0 else min(s for s in starts if s > block)
        assert inside == (text[:first].count('"') % 2 == 1)
    assert set(got.values()) == {True, False}
