"""Embedding whitening and hard-negative mining against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamsift.llm import hardneg, whitening

ODD = [None, [], [1.0, None, 2.0], [float("nan")] * 3, [float("inf"), 0.0, 0.0]]


def frame(spark, rows, schema="vec_id long, embedding array<float>"):
    df = spark.createDataFrame(rows, schema)
    for name in ("x", "n", "component", "deviation", "whitened", "v", "cell", "rank", "score", "anchor_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def plain_whitening(rows, k, scale=256):
    """numpy: eigenvectors of the covariance of the distinct integer vectors."""
    x = {i: [int(np.floor(scale * float(np.float32(c)))) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, float) - np.array(sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, v in x.items():
        w = (np.array(v, float) - np.array(sums) / n) @ u / np.sqrt(e)
        out[i] = (n, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), w, e / (y * y).sum() * n)
    return out


def test_whitening_equals_plain_eigenvectors(spark):
    rng = np.random.default_rng(5)
    spread = rng.standard_normal((40, 40))
    rows = [(i, (spread @ rng.standard_normal(40) + 3).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a hot copy counts once in the fit
    df = frame(spark, rows + [(2000 + i, v) for i, v in enumerate(ODD)]).repartition(40)
    got = whitening.whiten(df, 4).collect()
    want = plain_whitening(rows, 4)
    assert len(got) == 4 * len(rows)
    own, other = np.zeros((2, len(rows), 4))
    place = {i: j for j, (i, _) in enumerate(rows)}
    for r in got:
        n, deviation, w, share = want[r["vec_id"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation) and r["identity_error"] < 1e-10
        assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-10
        own[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        other[place[r["vec_id"]], r["component"] - 1] = w[r["component"] - 1]
    other *= np.sign((own * other).sum(axis=0))  # either sign, one for all rows
    assert abs(own - other).max() < 1e-9


def test_filter_damps_the_interval_and_keeps_the_top():
    values = np.array([9.0, 6.0, 3.0, 2.5, 2.0, 1.5, 1.0])
    q = whitening.chebyshev_filter(lambda x: values[:, None] * x, np.eye(7), 9, 1.0, 3.0, 9.0)
    size = np.abs(np.diag(q))
    assert abs(size[0] - 1) < 1e-9 and 1e-5 < size[1] < 1 and size[2:].max() <= 1.0001 * size[2]
    assert size[2] < 1e-7


@pytest.mark.parametrize("spectrum", [
    [1.0] * 50, [5.0] * 6 + [1.0] * 44, [3.0, 2.0] + [0.0] * 48, [1e8, 1, 0.5, 0.4, 0.3] + [0.1] * 45,
    list(np.linspace(1, 2, 300)), [2.0, 1.0, 0.5]])
def test_subspace_is_certified(spectrum):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    v = turn * spectrum @ turn.T
    got = whitening.subspace(lambda q: (v @ q, float(sum(spectrum))), len(spectrum), 4)
    want = sorted((e for e in spectrum if e > 0), reverse=True)[:4]
    assert np.allclose(got["values"], want, rtol=1e-10, atol=1e-12 * max(spectrum))
    assert np.abs(v @ got["vectors"] - got["vectors"] * got["values"]).max() < 1e-13 * max(spectrum)


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(frame(spark, []), 4).count() == 0
    assert whitening.whiten(frame(spark, list(enumerate(ODD))), 4).count() == 0
    same = [(i, [1.0, 2.0]) for i in range(9)]
    assert whitening.whiten(frame(spark, same), 4).count() == 0  # no variance, no components
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [2.0, 4.0]), (1, [2.0, 4.0])], schema), 4)
    rows = line.collect()
    assert sorted(round(abs(r["whitened"]), 9) for r in rows) == [1.0, 1.0, 1.0] and {r["n"] for r in rows} == {2}
    assert [r["vec_id"] for r in rows].count(None) == 1
    mixed = whitening.whiten(spark.createDataFrame(
        [(i, [float(i), 1.0][:1 + i % 2]) for i in range(8)], schema), 4).collect()
    assert len(mixed) == 8 and {r["n"] for r in mixed} == {4}
    far = [(i, [1e12 + 2.0 ** 17 * i, float(i % 2)]) for i in range(6)]  # entries that need whole numbers
    out = whitening.whiten(spark.createDataFrame(far, schema), 1).collect()
    x = [int(np.float32(v[0])) * 256 for _, v in far]
    for r in out:
        assert int(r["deviation"]) == (6 * x[r["vec_id"]] - sum(x)) ** 2 + (6 * 256 * (r["vec_id"] % 2) - 768) ** 2
    assert max(r["identity_error"] for r in out) < 1e-9


# --- hard negatives ---
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, is_anchor, scale=256):
    """Every pair, by the wording."""
    rows = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v], y) for i, v, y in rows]
    out = []
    for a, v, y in rows:
        if not is_anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, w, z in rows
                  if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == y)[:5]:
            fits = sorted(x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fits)]
    return sorted(out)


def mined(df, **options):
    got = hardneg.mine(df, F.col("vec_id") % 50 == 0, **options)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                       "negative_score")) for r in got.collect())


def clustered(n, dim, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim)) * 2
    return [(i, (centres[i % clusters] + rng.standard_normal(dim) * 0.5).tolist(), int(rng.integers(0, 4)))
            for i in range(n)]


@pytest.mark.parametrize("waves", [1, 3])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, waves):
    if waves > 1:  # small parts and portions: several waves, parts and portions
        monkeypatch.setattr(hardneg, "PART", 20)
        monkeypatch.setattr(hardneg, "ANCHORS", 7)
    rows = clustered(900, 12, 3)
    rows += [(2000 + i, rows[50][1], i % 2) for i in range(300)]  # a hot vector: ties in plenty
    odd = [(5000 + 50 * i, v, 1) for i, v in enumerate(ODD)] + [(5050, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    got = mined(frame(spark, rows + odd, SCHEMA))
    assert got == plain_negatives(rows, lambda i: i % 50 == 0) and len(got) > 100


def test_hard_negatives_odd_rows(spark):
    assert mined(frame(spark, [], SCHEMA)) == []
    assert mined(frame(spark, [(50 * i, v, 1) for i, v in enumerate(ODD)], SCHEMA)) == []
    one = [(50, [1.0, 2.0], 1)]
    assert mined(frame(spark, one, SCHEMA)) == []
    # repeated ids count as rows, an anchor's own id never; other lengths stay apart; negative scores open no window
    rows = one + [(3, [1.0, 2.0], 1)] * 2 + [(4, [0.5, 1.5], 2)] * 2 + [(5, [1.0], 1), (100, [-1.0, -1.0], 3),
                                                                       (101, [1.0, 0.0], 3), (150, [2.0], 1)]
    assert mined(frame(spark, rows, SCHEMA)) == plain_negatives(rows, lambda i: i % 50 == 0) != []
    rows = [(i, [float(2 ** 20 + i), float(2 ** 19 - 7 * i)], i % 2) for i in range(120)]  # sums beyond 2^53
    assert mined(frame(spark, rows, SCHEMA)) == plain_negatives(rows, lambda i: i % 50 == 0)


def test_walk_visits_in_falling_order_and_stops():
    sums = list(hardneg.multi_sequence([5.0, 3.0, 1.0], [4.0, 0.0]))
    assert [s for s, _, _ in sums] == sorted((a + b for a in (5.0, 3.0, 1.0) for b in (4.0, 0.0)), reverse=True)
    assert len({(i, j) for _, i, j in sums}) == 6
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16)) * 1000
    x = np.floor(centres[np.arange(6000) % 30] + rng.standard_normal((6000, 16)) * 20).astype(np.int64)
    ids, labels = np.arange(6000), np.arange(6000) // 30 % 3
    books = [hardneg.codebook(x[:, :8], 30), hardneg.codebook(x[:, 8:], 30)]
    index = hardneg.MultiIndex(ids, labels, x, [hardneg.nearest(x[:, :8], books[0]), hardneg.nearest(x[:, 8:], books[1])], books)
    a = np.arange(0, 6000, 100)
    best, work = hardneg.Best(np.full(len(a), -np.inf), 5), []
    hardneg.find_positives(index, (ids[a], labels[a], x[a]), best, work)
    visited, cells = work[0]
    assert visited < 0.2 * cells  # tight cells: most are never visited
    scores = x[a] @ x.T
    for slot, score, name in zip(best.slot, best.score, best.name, strict=True):
        assert scores[slot, name] == score and labels[name] == labels[a[slot]]
    want = np.where((labels[a][:, None] == labels) & (a[:, None] != ids), scores, -10 ** 12)
    assert np.array_equal(np.sort(best.score.reshape(len(a), 5)), np.sort(want)[:, -5:])
