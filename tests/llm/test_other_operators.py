"""Packing, sharding, top-k, WARC audit, language model and classifiers."""

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamsift.llm import kdtree, ngram, packing, quality, topk, toxicity, warc
from loamsift.llm.common import held_out
from tests.llm.conftest import DOCS

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path():
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


# --- packing ---
def check_sequences(rows, max_len):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= max_len
    return len(by)


def test_ids_equal_whole_text_encoding():
    from tokenizers import Tokenizer
    whole, words = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path())
    rng = random.Random(3)
    parts = ["a", "B", "H̱", "é", "É", "Å", "'s", "'LL", "!", "***", ".", ",", "<|endoftext|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "1",
             "\u212a", "\u1100\u1161", "A\u030a", "\u2003", "The", "THE", "the", "The,", "ß",
             "ΣΑΣ", "İ", " ", " ", "　", "\x1c", "\n", "\t", "漢字", "😀", "don't", "#tag", "Word.", "É!", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    got = [x.tolist() for lo in range(0, 3000, 300) for x in words([t.encode() for t in texts[lo:lo + 300]])]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json
    from tokenizers import Tokenizer
    with open(tokenizer_path(), encoding="utf-8") as f:
        config = json.load(f)
    config["normalizer"]["normalizers"].pop()  # case counts now
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f)
    tokens = packing.WordTokenizer(path)
    texts = ["The the THE, ΣΑΣ", "", "a  b\n<|endoftext|>"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert not tokens.word_wise and [x.tolist() for x in tokens([t.encode() for t in texts])] == want
    assert packing.WordTokenizer(tokenizer_path()).word_wise


@pytest.mark.parametrize("n,max_len", [(1, 4096), (500, 4096), (40_000, 4096), (300, 100)])
def test_plan_is_valid_and_tight(n, max_len):
    lengths = np.clip(np.random.default_rng(n).lognormal(math.log(max_len / 5), 1, n).astype(int), 1, max_len)
    counts = Counter(lengths.tolist())
    plan = packing.Plan(dict(counts), max_len)
    placed, rows = Counter(), []
    ends = {}
    for length, rank, sequence, offset in plan.rows:
        ends.setdefault(length, []).append((rank, sequence, offset))
    for length, own in ends.items():
        own.sort()
        for i, (rank, sequence, offset) in enumerate(own):
            until = own[i + 1][0] if i + 1 < len(own) else counts[length]
            placed[length] += until - rank
            rows += [{"sequence_id": sequence + j, "offset": offset, "length": length} for j in range(until - rank)]
    assert placed == counts
    used = check_sequences(rows, max_len)
    assert used == plan.n_sequences <= 1.01 * -(-int(lengths.sum()) // max_len) + 2


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    a, b = rng.random((20, 60)), rng.random(20) * 10
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max() < 1e-6


def test_pack_odd_rows(spark, odd_docs, no_docs):
    cut = packing.pieces(odd_docs, tokenizer_path(), 1, 64, with_ids=True)
    rows = packing.pack(cut, 64).collect()
    check_sequences(rows, 64)
    one = [r for r in rows if r["doc_id"] == 1]
    assert len(one) == 1 and one[0]["ids"] == [1] and one[0]["length"] == 1
    assert len([r for r in rows if r["doc_id"] == 7]) == 2
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["start"] == 64 * r["piece"]
    assert packing.pack(packing.pieces(no_docs, tokenizer_path(), 1, 64), 64).count() == 0


# --- sharding ---
def check_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(n))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return by


@pytest.mark.parametrize("hot", [0.0, 0.34])
def test_shards_have_nearly_equal_bytes(spark, hot):
    rng = random.Random(9)
    rows = [(i, "the hot copy " * 9 if rng.random() < hot else "x" * rng.randint(0, 300) + "\n" * rng.randint(0, 3), "en", "s", 0)
            for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    got = kdtree.shard(df, 40).collect()
    assert len(got) == 4000
    by = check_shards(got, 40)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    mean = sum(sizes) / 40
    assert len(by) == 40 and max(sizes) - min(sizes) < 0.1 * mean + 2 * 316
    for r in got:
        text = rows[r["doc_id"]][1].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))


def test_shard_plan_has_no_python(spark):
    df = spark.createDataFrame([(i, "x" * i, "en", "s", 0) for i in range(50)], DOCS)
    df.write.mode("overwrite").parquet(path := f"{__import__('tempfile').mkdtemp()}/d")
    plan = kdtree.shard(spark.read.parquet(path), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shards_odd_rows(spark, odd_docs, no_docs):
    for n in (1, 3, 40):
        rows = kdtree.shard(odd_docs, n).collect()
        check_shards(rows, n)
        assert len(rows) == odd_docs.count() and min(r["size"] for r in rows) == 16
    assert kdtree.shard(no_docs, 40).count() == 0
    assert kdtree.shard(odd_docs, target_bytes=200_000).agg(F.max("shard")).first()[0] >= 3


# --- exact top-k ---
def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 16)]) for i in range(700)]
    rows += [(700 + i, rows[i % 5][1]) for i in range(60)]  # ties
    rows += [(900, None), (920, [1.0] * 15 + [None]), (940, [float("nan")] * 16), (960, [float("inf")] * 16), (980, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20, 64).collect()}
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v and i < 900}
    want = {}
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
        want.update({(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)})
    assert got == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4  # fewer than k


def test_blocks_are_skipped_and_large_values_exact():
    rng = np.random.default_rng(5)
    centres = rng.integers(-90, 90, (40, 16))
    matrix = np.concatenate([c + rng.integers(-3, 4, (256, 16)) for c in centres])
    blocks = topk._blocks_of(np.arange(len(matrix)), matrix)
    work = []
    at, name, score = topk.search_blocks(blocks, np.array([3]), matrix[3:4], 10, work)
    s = matrix @ matrix[3]
    assert score.tolist() == sorted((s[i] for i in range(len(s)) if i != 3), reverse=True)[:10]
    assert work[0][0] < work[0][1] / 2
    big = (matrix * 10**6)[:20]  # sums above 2^53
    _, name, exact = topk.search_blocks(topk._blocks_of(np.arange(20), big), np.array([-1]), big[:1], 3)
    assert sorted(exact.tolist()) == sorted(sum(int(x) * int(y) for x, y in zip(r, big[0])) for r in big)[-3:]


# --- WARC audit ---
def test_audit_finds_each_kind_of_damage(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(600)], "page_id long, url string, html string")
    a = warc.archive(pages, 200).cache()
    assert a.where("segment = 1").agg(F.min("offset")).first()[0] == 0
    record = a.where("page_id = 5").first()["record"].tobytes() if hasattr(a.first()["record"], "tobytes") else bytes(a.where("page_id = 5").first()["record"])
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    for size, fanout in ((1000, 2), (1 << 18, 16), (64, 3)):
        assert warc.audit(a, a.drop("page_id"), size, fanout).count() == 0
        b = a.where("page_id <> 77").withColumn("record", F.when(F.col("page_id") == 301, F.lit(b"bad")).otherwise(F.col("record")))
        b = b.unionByName(a.where("page_id = 450").withColumn("segment", F.lit(9).cast("long")))
        got = {(r["segment"], r["offset"], r["finding"]) for r in warc.audit(a, b, size, fanout).collect()}
        at = {r["page_id"]: (r["segment"], r["offset"]) for r in a.collect()}
        assert got == {(*at[77], "missing"), (*at[301], "changed"), (9, at[450][1], "extra")}
    empty = a.where("false")
    assert warc.audit(a, empty).where("finding = 'missing'").count() == 600
    assert warc.audit(empty, a).where("finding = 'extra'").count() == 600 and warc.audit(empty, empty).count() == 0


def test_archive_and_replica_are_stored_in_less_than_the_pages(spark, tmp_path):
    from loamsift.llm import queries
    from loamsift.session import app_folder
    html = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.hex(F.xxhash64("id", i))))
    spark.range(1000).select(F.col("id").alias("page_id"), F.lit("http://a.com/").alias("url"),
                             html.alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    room = lambda top, name: sum(p.stat().st_size for p in Path(top).glob(f"{name}*/*.parquet"))
    before = {n: room(app_folder(spark), n) for n in ("archive", "replica")}
    assert queries.QUERIES["op6_warc_fixity"](spark, str(tmp_path)).count() == 60
    for name, had in before.items():
        assert 0 < room(app_folder(spark), name) - had < 0.8 * room(tmp_path, "pages")


def test_audit_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "h"), (2, "u", ""), (2, "u", ""), (3, "ü", "é" * 3)],
                                  "page_id long, url string, html string")
    a = warc.archive(pages, 10)
    assert a.count() == 4 and warc.audit(a, a).count() == 0
    assert warc.audit(a, a.withColumn("record", F.lit(None).cast("binary"))).where("finding = 'changed'").count() == 4


# --- language model ---
@pytest.mark.parametrize("small", [True, False])
def test_scores_equal_a_plain_bigram_model(spark, monkeypatch, small):
    if small:
        for name, value in (("BATCH_BYTES", 3000), ("SHARD_WORDS", 200), ("SHARD_TOKENS", 900)):
            monkeypatch.setattr(ngram, name, value)
    rng = random.Random(8)
    words = ["the", "The", "of"] + [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(250)] + ["", None, "never seen words", "hot pair " * 400]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in ngram.score(df, ~held_out(10, 0)).collect()}
    tokens = {i: [w.lower() for w in (t or "").split()] + ["\n"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    uni, bi = Counter(), Counter()
    for i, w in tokens.items():
        if not held[i]:
            uni.update(w)
            bi.update(zip(["\n", *w], w))
    n, v = sum(uni.values()), len(uni)
    for i, w in tokens.items():
        p = [(uni[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        s = sum(math.log10((bi[a, x] + ngram.MU * q) / (uni[a] + ngram.MU)) for a, x, q in zip(["\n", *w], w, p))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["trained"]) == (len(w), sum(uni[x] > 0 for x in w), n, not held[i])
        assert abs(r["base_score"] - sum(map(math.log10, p))) < 1e-6 and abs(r["score"] - s) <= 1.6e-4 * len(w)
    assert sum(r["score"] for i, r in got.items() if held[i]) > sum(r["base_score"] for i, r in got.items() if held[i])


def test_elias_fano_round_trip_and_successors():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (1000, 50), (5000, 10**13)):
        values = np.sort(rng.integers(0, top + 1, n))
        parts, size, bits = ngram.EliasFano.encode(values)
        ef = ngram.EliasFano(parts, size, bits)
        assert (ef[np.arange(n)] == values).all()
        asked = np.concatenate([values, values + 1, rng.integers(0, 2 * top + 2, 200)])
        assert (ef.successor(asked) == np.searchsorted(values, asked)).all()


def test_language_model_odd_rows(spark, odd_docs, no_docs):
    rows = ngram.score(odd_docs, ~held_out(10, 0)).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert ngram.score(no_docs, ~held_out(10, 0)).count() == 0
    none = ngram.score(odd_docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0}


# --- classifiers ---
@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_held_out_labels(spark, module, label, least):
    """On sf0.1: at sf0.01 a dozen toxic documents are held out, too few to measure by."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = module.fit(docs, labels, ~held_out(4, 2))
    rows = module.score(docs, model).where(held_out(4, 2)).join(labels, "doc_id").collect()
    one, zero = ([r["score"] for r in rows if r[label] == y] for y in (1, 0))
    better = sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero))
    assert better > least


def test_misspelling_shares_the_words_vectors():
    texts = [b"you are an idiot today friend", b"what a nice day for a walk", b"such an idiot indeed", b"we saw the nice garden"] * 10
    y = np.array([1, 0, 1, 0] * 10)
    scores, bias = toxicity.bucket_scores(toxicity.train([toxicity.bag(t) for t in texts], y, np.ones(40), epochs=10))
    table = toxicity.WordScores(scores)
    table.learn({b"idiot", b"idiott", b"garden"})
    assert table[b"idiot"] > table[b"idiott"] > 0 > table[b"garden"]


def test_attention_gradients():
    rng = np.random.default_rng(1)
    x, first = quality.passages([b"Some plain text. " * 80, b"!!! $$$ ###", b"", b"mixed WORDS *** here " * 60])
    y, w = np.array([1, 0, 0, 1]), np.array([1.0, 2.0, 1.0, 0.5])
    p = {k: np.asarray(v, float) for k, v in quality.train(
        [x[a:b] for a, b in zip(first[:-1], first[1:])], y, w, epochs=1).items()}

    def loss():
        q = quality.forward(p, x, first)["p"]
        return -(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).mean()
    g = quality.gradients(p, x, first, y, w)
    for name in ("encode", "u", "v", "w", "out"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        decay = quality.DECAY * p[name][at] if name in ("encode", "u", "v", "out") else 0
        p[name][at] += 1e-5
        up = loss()
        p[name][at] -= 2e-5
        down = loss()
        p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - (g[name][at] - decay)) < 1e-6
    assert np.allclose(np.add.reduceat(quality.forward(p, x, first)["a"], first[:-1]), 1)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_odd_rows(spark, odd_docs, no_docs, module, label):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 1), (5, 0, 0), (7, 1, 1), (8, None, None), (None, 1, 1), (99, 1, 1)], schema)
    model = module.fit(odd_docs, labels, F.lit(True))
    rows = module.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(no_docs, model).count() == 0
    nothing = module.score(odd_docs, module.fit(odd_docs, labels.where("false"), F.lit(True))).collect()
    assert max(r["score"] for r in nothing) < 1e-9
    only = module.score(odd_docs, module.fit(odd_docs, labels.where(f"{label} = 1"), F.lit(True))).collect()
    assert min(r["score"] for r in only) > 1 - 1e-9
