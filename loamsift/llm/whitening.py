"""PCA whitening by Chebyshev-filtered subspace iteration over distributed passes.

The covariance V of the distinct integer vectors is never formed. A pass over the stored fit list
returns VQ for a block Q of some more columns than components are wanted: every task centres its
vectors, multiplies, and returns one matrix of that size, and matrices are added in a tree of
tasks. A three-term Chebyshev recurrence over such passes damps the interval of the unwanted
eigenvalues; QR and Rayleigh-Ritz follow. The lower end of that interval comes from a few Lanczos
steps, the upper end from the smallest settled Ritz value of the block. The last columns of the
block are drawn anew before every filter, so a strong direction that the start missed would show
up among the Ritz values.

The result is certified: the iteration ends when the residuals ``|Vq - eq|``, measured by a pass,
bound the angle of each component by ``ANGLE`` or have reached the rounding of a pass, after at
least one filter over fresh columns; it fails loudly after ``MAX_PASSES``.

Defined cases: vectors that are null or hold null or non-finite entries, or entries outside 64
bits after scaling, take no part. Vectors of each length are fitted on their own; empty ones have
no components. A vector counts once in the fit however often it is repeated, every row gets its
values, null ids included. Components without variance (relative to the trace) are left out, so
equal vectors or an empty table give no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.common import arrow_map
from loamsift.session import stash

GUARD = 12  # columns of the block beyond the wanted components
FRESH = 3  # of these, columns that are drawn anew before every filter
GROWTH = 1e9  # largest growth of a component over the damped interval within one filter
LANCZOS = 8  # steps that look for the lower end of the spectrum
ANGLE = 1e-12  # a component's certified angle
ROUNDING = 64 * np.finfo(float).eps  # residual, relative to the largest eigenvalue
NO_VARIANCE = 1e-13  # eigenvalue, relative to the trace
MAX_PASSES = 3000
FAN_IN = 32  # matrices added by one task, and at last by the driver


@dataclass
class Whitening:
    """A fitted model: everything is of the size of ``dim`` x components."""

    dim: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dim x components
    residuals: np.ndarray
    degrees: list[int]  # of the filters
    passes: int
    identity_error: float


def integer_vectors(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * c) of every entry, whole vectors only."""
    fits = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < 2.0 ** 62))
    return df.where(F.col("embedding").isNotNull() & fits).select("vec_id", F.transform(
        "embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class _Centred:
    """Passes over the fit list, centred at the exact mean."""

    def __init__(self, fit_list: DataFrame, dim: int):
        self.rows, self.dim, self.passes = fit_list, dim, 0
        hi, lo, n = 0, 0, 0
        for r in self._added(fit_list, _split_sums(dim), "v array<long>"):
            n, hi, lo = n + r[0], hi + r[1:dim + 1].astype(object), lo + r[dim + 1:].astype(object)
        self.n = int(n)
        self.sums = [int(s) for s in hi * 2 ** 32 + lo] if n else []
        if n:
            self.centre = mean_of(self.sums, self.n)

    def _added(self, df: DataFrame, fn, schema: str) -> Iterator[np.ndarray]:
        """Partial sums of all tasks, at most ``FAN_IN`` of them."""
        partial = arrow_map(df, fn, schema)
        many = df.rdd.getNumPartitions()
        while many > FAN_IN:
            many = -(-many // FAN_IN)
            partial = arrow_map(partial.repartition(many), _add_up, schema)
        return (np.array(r["v"]) for r in partial.collect())

    def summed(self, fn) -> np.ndarray:
        """The sum over all tasks of ``fn``(centred vectors), a flat array."""
        dim, centre = self.dim, self.centre

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            total = None
            for b in batches:
                out = fn(centred(_matrix(b["x"], dim), centre))
                total = out if total is None else total + out
            if total is not None:
                yield {"v": pa.array([total.tolist()])}
        self.passes += 1
        return sum(self._added(self.rows, run, "v array<double>"))

    def times(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """Vq, and the trace of V."""
        out = self.summed(lambda y: np.append((y.T @ (y @ q)).ravel(), (y * y).sum())) / self.n
        return out[:-1].reshape(q.shape), float(out[-1])


def mean_of(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and the rest below one."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])


def centred(x: np.ndarray, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """x minus the mean, given as whole number and rest, so large offsets lose no digits."""
    return (x - centre[0]).astype(np.float64) - centre[1]


def _split_sums(dim: int):
    """Exact sums of 64-bit entries: upper and lower halves apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(1 + 2 * dim, np.int64)
        for b in batches:
            x = _matrix(b["x"], dim)
            total += np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
        yield {"v": pa.array([total.tolist()])}
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    total = None
    for b in batches:
        for v in b["v"]:
            v = v.values.to_numpy(zero_copy_only=False)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield {"v": pa.array([total.tolist()])}


def chebyshev_filter(times, q: np.ndarray, degree: int, low: float, high: float,
                     top: float) -> np.ndarray:
    """p(V)q for the Chebyshev polynomial that is small on [low, high], scaled to 1 at ``top``."""
    half, mid = (high - low) / 2, (high + low) / 2
    s = first = half / (mid - top)
    old, new = q, (times(q) - mid * q) * (first / half)
    for _ in range(degree - 1):
        nxt = 1 / (2 / first - s)
        old, new = new, (times(new) - mid * new) * (2 * nxt / half) - s * nxt * old
        s = nxt
    return new


def degree_for(low: float, high: float, top: float) -> int:
    """Passes of one filter: what grows most grows at most ``GROWTH`` times, so no column drowns."""
    t = 2 * (top - low) / (high - low) - 1
    rise = t + np.sqrt(max(t * t - 1, 0.0))
    return int(np.clip(np.log(GROWTH) / np.log(max(rise, 1.001)), 2, 12))


def lowest_eigenvalue(times, start: np.ndarray) -> float:
    """An estimate from below by a few Lanczos steps with full orthogonalisation."""
    basis, images = [], []
    v = start / np.linalg.norm(start)
    for _ in range(min(LANCZOS, len(start))):
        basis.append(v)
        images.append(image := times(v[:, None])[:, 0])
        b = np.stack(basis, axis=1)
        v = image - b @ (b.T @ image)
        v -= b @ (b.T @ v)
        norm = np.linalg.norm(v)
        if norm <= 1e-10 * np.linalg.norm(image):
            break
        v /= norm
    a = np.stack(images, axis=1)
    h = b.T @ a
    values, u = np.linalg.eigh((h + h.T) / 2)
    return max(0.0, float(values[0] - np.linalg.norm(a @ u[:, 0] - values[0] * (b @ u[:, 0]))))


def subspace(product, dim: int, k: int, seed: int = 11) -> dict:
    """The ``k`` largest eigenpairs of the operator whose ``product``(Q) is (VQ, trace of V)."""
    rng = np.random.default_rng(seed)
    block = min(dim, k + GUARD)
    state = {"passes": 0, "trace": 0.0}

    def times(q: np.ndarray) -> np.ndarray:
        state["passes"] += 1
        if state["passes"] > MAX_PASSES:
            raise RuntimeError(f"eigenvectors not certified after {MAX_PASSES} passes")
        out, state["trace"] = product(q)
        return out

    q, degrees, low = np.linalg.qr(rng.standard_normal((dim, block)))[0], [], None
    while True:
        vq = times(q)
        h = q.T @ vq
        values, u = np.linalg.eigh((h + h.T) / 2)  # Rayleigh-Ritz
        values, u = values[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        residuals = np.linalg.norm(vq - q * values, axis=0)
        trace = state["trace"]
        wanted = min(k, int((values > NO_VARIANCE * trace).sum()))
        if block == dim or trace == 0:  # the block is the whole space
            break
        steps = values[:wanted] - values[1:wanted + 1]
        gaps = np.minimum(steps, np.append(np.inf, steps[:-1]))
        if degrees and (residuals[:wanted] <= np.maximum(ANGLE * gaps, ROUNDING * values[0])).all():
            break
        if low is None:
            low = lowest_eigenvalue(times, rng.standard_normal(dim))
        # before the first filter the block is random: only the mean eigenvalue is a safe bound
        high = max(values[-1 - FRESH] if degrees else trace / dim, NO_VARIANCE * trace)
        low = min(low, 0.9 * high)
        q[:, block - FRESH:] = rng.standard_normal((dim, FRESH))
        q = np.linalg.qr(q)[0]
        degrees.append(degree_for(low, high, top := max(values[0], 1.01 * high)))
        q = chebyshev_filter(times, q, degrees[-1], low, high, top)
        q = np.linalg.qr(q / np.linalg.norm(q, axis=0))[0]
    vectors = q[:, :wanted]
    leading = vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)]
    return {"values": values[:wanted], "vectors": vectors * np.where(leading < 0, -1.0, 1.0),
            "residuals": residuals[:wanted], "degrees": degrees, "trace": trace}


def fit(vectors: DataFrame, k: int = 4) -> Whitening | None:
    """Fit on the distinct vectors ``x`` of one length; None for an empty table."""
    first = vectors.select("x").first()
    if first is None:
        return None
    dim = len(first["x"])
    rows = _Centred(stash(vectors.select("x").distinct(), "fit_list"), dim)
    found = subspace(rows.times, dim, k)
    turn = found["vectors"] / np.sqrt(found["values"])
    own = turn.shape[1]
    error = 0.0
    if own:
        second = rows.summed(lambda y: np.append(((w := y @ turn).T @ w).ravel(), w.sum(axis=0))) / rows.n
        mean = second[own * own:]
        error = float(np.abs(second[:own * own].reshape(own, own) - np.outer(mean, mean)
                             - np.eye(own)).max())
    return Whitening(dim=dim, n=rows.n, sums=rows.sums, passes=rows.passes, identity_error=error, **found)


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n * x - S)^2, in whole numbers of any size."""
    reach = max((n * int(max(x.max(), -x.min())) + max(abs(s) for s in sums)) if x.size else 0, 1)
    if reach * reach * len(sums) < 2 ** 63:
        return [int(v) for v in ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)]
    return [int(v) for v in ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)]


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) of every row."""
    dim, n, sums, error = model.dim, model.n, model.sums, model.identity_error
    turn, share = model.vectors / np.sqrt(model.values), model.values / (model.trace or 1.0)
    centre = mean_of(sums, n)
    own = turn.shape[1]
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for lo in range(0, b.num_rows if own else 0, 2048):
                part = b.slice(lo, 2048)
                x = _matrix(part["x"], dim)
                rows = np.repeat(np.arange(len(x)), own)
                sizes = pa.array([str(v) for v in exact_deviation(x, n, sums)])
                yield {"vec_id": part["vec_id"].take(pa.array(rows)),
                       "component": np.tile(np.arange(1, own + 1), len(x)),
                       "n": np.full(len(rows), n), "deviation": sizes.take(pa.array(rows)),
                       "whitened": (centred(x, centre) @ turn).ravel(),
                       "explained": np.tile(share, len(x)), "identity_error": np.full(len(rows), error)}
    out = arrow_map(vectors.select("vec_id", "x"), run, f"vec_id {kind}, component int, n long, "
                    "deviation string, whitened double, explained double, identity_error double")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(df: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """The ``k`` whitened components of every usable row of (vec_id, embedding)."""
    vectors = stash(integer_vectors(df.select("vec_id", "embedding"), scale), "integer_vectors")
    out = None
    lengths = vectors.groupBy(F.size("x").alias("dim")).count().where("dim > 0").orderBy("dim")
    for row in lengths.collect():  # a row for each vector length
        own = vectors.where(F.size("x") == row["dim"])
        part = transform(own, fit(own, k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation "
                                               "decimal(38,0), whitened double, explained double, "
                                               "identity_error double")
    return out
