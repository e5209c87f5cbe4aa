"""Line dedup, near-dedup and decontamination against plain Python."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamsift.llm import contain, lines, neardup
from loamsift.llm.common import NOT_SPACE, WordHasher, shingles
from loamsift.session import stash
from tests.llm.conftest import DOCS


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def plain_shingles(text, k):
    w = plain_words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_word_hashes_follow_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é\n\t.x\x1c ") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    h, at = WordHasher(NOT_SPACE)([t.encode() for t in texts])
    seen = {}
    for i, t in enumerate(texts):
        own = h[at[i]:at[i + 1]].tolist()
        assert len(own) == len(plain_words(t))
        for w, x in zip(plain_words(t), own):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    s, first = shingles(h, at, 3)
    assert np.diff(first).tolist() == [max(0, min(1, len(plain_words(t))), len(plain_words(t)) - 2) for t in texts]


# --- line dedup ---
def plain_lines(rows, min_docs, keep_first):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").encode().lower()
    found, lead = defaultdict(set), {}
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            found[key(x)].add(i)
            lead[key(x)] = min(lead.get(key(x), (i, p)), (i, p))
    out = {}
    for i, t in rows:
        own = list(enumerate((t or "").split("\n")))
        kept = [x for p, x in own if not key(x) or len(found[key(x)]) < min_docs
                or (keep_first and lead[key(x)] == (i, p))]
        out[i] = ("\n".join(kept), len(own), len(own) - len(kept))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("parts", [1, 13])
def test_line_dedup_equals_plain(spark, keep_first, parts):
    rng = random.Random(2)
    pool = ["Footer line", "  footer LINE ", "", " ", "Über uns"] + [f"line {i}" for i in range(60)]
    texts = ["\n".join(["hot"] * rng.randint(0, 3) + [rng.choice(pool) for _ in range(rng.randint(0, 12))]) for _ in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in
               lines.dedup_lines(docs_of(spark, texts), 10, 1, keep_first).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain_lines(list(enumerate(texts)), 10, keep_first)


def test_runs_are_decided_alike_for_any_batches():
    import pyarrow as pa
    rows = sorted((random.Random(3).randint(0, 6), 0, d, p) for d in range(40) for p in range(3))
    table = pa.table({"h1": [r[0] for r in rows], "h2": [0] * len(rows), "doc_id": [r[2] for r in rows],
                      "doc_key": [r[2] for r in rows], "text_hash": [0] * len(rows), "pos": [r[3] for r in rows]})

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0
    real, lines.TaskContext = lines.TaskContext, Context
    try:
        results = []
        for size in (1, 2, 7, 1000):
            out = [(k, p) for part in lines._Stream(5, False)(iter(table.to_batches(size)))
                   for k, p in zip(part["kind"].tolist(), part["pos"].to_pylist() if hasattr(part["pos"], "to_pylist") else part["pos"])]
            results.append(sorted(out))
        assert all(r == results[0] for r in results)
    finally:
        lines.TaskContext = real


def test_bitmaps_keep_lines_past_their_end():
    keep = zlib.compress(np.packbits(np.array([1, 0, 1, 1, 1, 1, 1, 1], np.uint8)).tobytes())
    assert lines.apply_bitmap(b"a\nb\nc\n" + b"\n".join([b"d"] * 20), keep)[1:] == (23, 1)


def test_lines_odd_rows(spark, odd_docs, no_docs):
    out = lines.without_lines(odd_docs, min_docs=3)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    rows = out.where("doc_id = 1 OR doc_id IS NULL").select("text").collect()
    assert [r["text"] for r in rows].count(None) == 2
    assert out.where("doc_id IN (7, 8)").select("text").distinct().collect()[0]["text"] == ""
    assert lines.dedup_lines(no_docs).count() == 0


# --- near-dedup ---
def plain_components(rows, k, percent):
    sets = {i: plain_shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts():
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(500)]
    out = ["", "a", "a", "A b", "a  B", None]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 160))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            out.append(" ".join(own))
            base = own if rng.random() < 0.5 else base  # chains of links
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_dedup_equals_all_pairs(spark, k, percent):
    texts = near_texts()
    got = {r["doc_id"]: r for r in neardup.link(docs_of(spark, texts), k, percent).collect()}
    want = plain_components(list(enumerate(texts)), k, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_dedup_finds_linked_pairs_in_a_crowd(spark):
    """400 versions of one text, all just under the threshold but for 200 pairs at it."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(1804)]
    texts = []
    for pair in range(200):
        spots = rng.sample(range(360), 46)
        for side, own in enumerate((spots[:26], spots[:6] + spots[26:])):
            text = list(base)
            for n, s in enumerate(own):
                text[5 * s + 4] = f"p{pair}x{s}" + ("" if n < 6 else f"y{side}")
            texts.append(" ".join(text))
    order = rng.sample(range(400), 400)
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(
        docs_of(spark, [texts[i] for i in order]), 5, 80).collect()}
    want = plain_components([(i, texts[x]) for i, x in enumerate(order)], 5, 80)
    assert len({root for _, root in want.values()}) == 200
    assert got == {i: root for i, (_, root) in want.items()}


def test_shared_shingles_of_blocks():
    rng = np.random.default_rng(2)
    left, right = [[np.unique(rng.integers(0, 30_000, n).astype(np.uint64)) for n in sizes]
                   for sizes in ((1, 9_000, 20_000), (3, 20_000))]
    assert neardup._common(left, right).tolist() == [
        [len(np.intersect1d(a, b)) for b in right] for a in left]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 900: 3}


def test_near_dedup_odd_rows(spark, odd_docs, no_docs):
    got = neardup.link(odd_docs, 5, 80).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == odd_docs.count()
    assert by[6][0]["component_id"] == 5 and by[8][0]["component_id"] == 7 and len(by[7]) == 2
    assert all(by[i][0]["component_id"] == i and by[i][0]["kept"] for i in (1, 2, 3))
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    kept = neardup.keep_one(odd_docs, 5, 80)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 7, None}
    assert neardup.link(no_docs, 5, 80).count() == 0


def test_near_dedup_keeps_one_row_of_repeats(spark):
    """A repeated row is kept once; a copy of one text of a doc_id does not take its other text."""
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (2, "g h i j k l"),
             (3, ""), (3, ""), (None, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in neardup.keep_one(docs, 5, 80).collect())
    assert kept == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l"), (3, ""), (3, "")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.link(docs, 5, 80).collect()}
    assert got == {(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (None, None, True)}


# --- decontamination ---
def plain_contained(docs, items, k=5):
    def sets(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    wanted = {i: sets(t) for i, t in items}
    out = set()
    for d, t in docs:
        own = sets(t)
        for i, s in wanted.items():
            if s and len(s & own) >= 0.8 * len(s):
                out.add((d, i, len(s & own), len(s)))
    return out


def test_contained_items_in_long_documents(spark):
    rng = random.Random(6)
    vocab = [f"t{i}" for i in range(3000)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 9, 30, 70, 400]))) for _ in range(60)]
    texts = []
    for n in range(120):
        body = [rng.choice(vocab) for _ in range(rng.choice([10, 200, 6000]))]
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items).split()
            if rng.random() < 0.4:
                own = own[:int(len(own) * rng.choice([0.7, 0.85, 0.95]))]
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in own]
        texts.append(" ".join(body))
    texts.append(items[0])
    item_rows = list(enumerate(items)) + [(100, None), (101, ""), (0, items[0])]
    frame = spark.createDataFrame(item_rows, "item_id long, text string")
    docs = docs_of(spark, texts)
    want = plain_contained(list(enumerate(texts)), item_rows)
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in contain.find_items(docs, frame).collect()}
    assert got == want and len(want) > 50
    kept = {r["doc_id"] for r in contain.drop_contaminated(docs, frame).collect()}
    assert kept == set(range(len(texts))) - {x[0] for x in want}


def test_item_blocks_cover_all_items(spark, monkeypatch):
    monkeypatch.setattr(contain, "BLOCK_SHINGLES", 50)
    items = [(i, " ".join(f"b{i}x{j}" for j in range(20))) for i in range(40)]
    docs = docs_of(spark, [t for _, t in items])
    got = {(r["doc_id"], r["item_id"]) for r in contain.find_items(
        docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(40)}


def test_contained_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "same text here now"), (2, None)], "item_id long, text string")
    assert contain.find_items(odd_docs, items).count() == 4
    kept = contain.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4
    none = items.where("false")
    assert contain.drop_contaminated(odd_docs, none).count() == odd_docs.count()
    assert contain.find_items(no_docs, items).count() == 0 and contain.find_items(odd_docs, none).count() == 0


def test_names_of_users_stay(spark, odd_docs):
    """Columns that carry inner names come back as they were."""
    for out in (lines.without_lines(odd_docs), neardup.keep_one(odd_docs),
                contain.drop_contaminated(odd_docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))):
        assert out.columns == odd_docs.columns
        rows = out.collect()
        assert rows and all(r[c] == "x" for r in rows for c in odd_docs.columns[5:])


def test_texts_of_one_item_count_once(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six"), (7, "five six seven eight nine ten"),
                                   (8, "one two three four five six")], "item_id long, text string")
    got = {tuple(r) for r in contain.find_items(docs, items, threshold=0.5).collect()}
    assert got == {(1, 7, 4, 4, 1.0), (1, 8, 2, 2, 1.0)}


def test_scattered_pieces_of_items_are_found(spark):
    """Sixty items, each cut into five pieces of twelve words, spread over documents of 10,000 words."""
    import random
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    items, docs = [], []
    for i in range(60):
        parts = [[word() for _ in range(12)] for _ in range(5)]
        items.append((i, " ".join(w for p in parts for w in p)))
        text = []
        for p in parts:
            text += [word() for _ in range(2000)] + p
        docs.append((i, " ".join(text)))
    got = contain.find_items(spark.createDataFrame(docs, "doc_id long, text string"),
                             spark.createDataFrame(items, "item_id long, text string"), threshold=0.7).collect()
    found = {r["doc_id"] for r in got if r["doc_id"] == r["item_id"]}
    assert len(found) >= 0.95 * 60 and all(r["doc_id"] == r["item_id"] for r in got)


def test_workers_need_no_import_path(tmp_path):
    """The driver runs in another folder and the workers have no path to the package."""
    import os
    import subprocess
    import sys
    code = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from loamsift.session import build
from loamsift.llm import contain, hardneg, lines, neardup, urlglob, whitening
from pyspark.sql import functions as F
spark = build("local[2]", "path", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
docs = spark.createDataFrame([(i, "a b c d e f g h " * (i + 1)) for i in range(9)], "doc_id long, text string")
items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
assert contain.find_items(docs, items).count() > 0
assert contain.drop_contaminated(docs, items).count() < 9
assert lines.without_lines(docs).count() == 9 and neardup.keep_one(docs).count() < 9
v = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)], i % 2) for i in range(60)],
                          "vec_id long, embedding array<float>, label int")
assert whitening.whiten(v, 2).count() == 120 and hardneg.mine(v, F.col("vec_id") % 50 == 0).count() >= 0
urls = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
assert urlglob.judge(urls, [urlglob.Rule("*.com/**", "block")]).first()["verdict"] == "block"
from loamsift.sources import readers, writers
writers.write_csv(docs, "{tmp_path}/c")
assert readers.read_csv(spark, "{tmp_path}/c", split=True).count() == 9
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]


def test_components_take_no_round_for_stars_and_few_files_else(spark, monkeypatch):
    written = []
    monkeypatch.setattr(neardup, "stash", lambda df, name: written.append(name) or stash(df, name))
    stars = [(1, i) for i in range(2, 30)] + [(40, i) for i in range(41, 60)]
    edges = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    roots = neardup.components(edges(stars))
    assert sorted(map(tuple, roots.collect())) == sorted({(b, a) for a, b in stars} | {(1, 1), (40, 40)})
    assert written == ["links"]
    chain = neardup.components(edges([(i, i + 1) for i in range(100, 160)])).collect()
    assert sorted(map(tuple, chain)) == [(i, 100) for i in range(100, 161)]
    assert neardup.components(edges([])).count() == 0
    more = neardup.extended(roots, edges([(59, 29), (7, 7), (70, 71), (30, 58)])).collect()
    want = [(i, 1) for i in range(1, 30)] + [(30, 1)] + [(i, 1) for i in range(40, 60)] + [(70, 70), (71, 70)]
    assert sorted(map(tuple, more)) == want


def test_near_dedup_uses_no_more_tasks_than_its_rows_need(spark, monkeypatch):
    files = {}

    def counted(df, name):
        out = stash(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out
    monkeypatch.setattr(neardup, "stash", counted)
    rng = random.Random(9)
    texts = []
    for i in range(100):  # a text, one near copy and a third that is near only to the second
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(80)]
        texts += [" ".join(words), " ".join(words[2:]), " ".join(words[4:])]
    docs = docs_of(spark, texts)
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = neardup.link(docs, 3, 95)
        parts = got.rdd.getNumPartitions()
        rows = {r["doc_id"]: r["component_id"] for r in got.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert rows == {i: i - i % 3 for i in range(300)}
    assert parts <= 8 and max(files.values()) <= 16, files  # 16: two parts in one table
