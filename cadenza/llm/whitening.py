"""Whitening of vectors: principal components by block Jacobi-Davidson over distributed centred products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stored

#: x = floor(64 c) + 1000000.
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no x that sums exactly over many rows.
MOST = float(1 << 33)
EPS = float(np.finfo(np.float64).eps)


def usable(vector: Column, dimension: Column) -> Column:
    """Whether a vector has that many entries, all of them finite numbers under MOST."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < MOST), F.lit(False)))
    return F.coalesce((F.size(vector) == dimension) & fine, F.lit(False))


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """A stored table of vec_id and x (array of long) of the vectors that remain, and their number of entries.

    Null vectors and those with null, non-finite or very large entries (MOST) are dropped, empty ones too. All others must
    have one length, which is the most frequent one (ties: the larger); others are dropped.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v"), F.size("v")) & (F.size("v") > 0))
    kept = stored(rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x")), "whitening-vectors")
    top = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (kept.where(F.size("x") == top["d"]), top["d"]) if top else (kept, 0)


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, work: Callable[[Iterator[np.ndarray]], np.ndarray | None], d: int) -> np.ndarray:
    """The sum over all tasks of the matrices that work makes of a task's vectors (an iterator of blocks), each a line of the matrix by a key.

    So a task sends its lines to those that add them up, and only the sum, whose size is a model's, comes to the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = work(_matrix(b.slice(k, 8192), d) for b in batches for k in range(0, len(b), 8192))
        if out is not None:
            lines = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), lines], ["line", "v"])

    parts = rows.select("x").mapInArrow(task, "line int, v array<double>")
    width = work(iter([np.zeros((1, d), np.int64)])).shape[1]
    lines = parts.groupBy("line").agg(F.array(*(F.sum(F.get("v", F.lit(k))) for k in range(width))).alias("v")).collect()
    return np.array([r["v"] for r in sorted(lines, key=lambda r: r["line"])])


@dataclass
class Centre:
    """The number of vectors and their exact sums."""

    n: int
    sums: list[int]
    square_sum: int = 0  # of all n * x - S

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole part and rest, so that differences keep all digits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return whole, np.array([(s % self.n) / self.n for s in self.sums])


def centre(rows: DataFrame) -> Centre:
    """Exact sums by decimals: of each dimension one, after a partial sum in each task."""
    sums = rows.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).orderBy("k").collect()
    return Centre(sums[0]["n"], [int(r["s"]) for r in sums])


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest


def products(rows: DataFrame, c: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance as an operator: a block of columns times it, by one pass over the centred vectors. The covariance itself is never made."""
    whole, rest = c.mean()
    d, n = len(c.sums), c.n

    def times(block: np.ndarray) -> np.ndarray:
        def work(parts: Iterator[np.ndarray]) -> np.ndarray | None:
            out = None
            for x in parts:
                y = _centred(x, whole, rest)
                out = y.T @ (y @ block) + (0 if out is None else out)
            return out

        return _summed(rows, work, d) / n

    return times


def minres(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """MINRES for several symmetric systems at once, each of its own: times maps a block of columns to a block, b has a right side a column.

    Lanczos vectors, rotations and solutions are kept a column; each step makes one product of the whole block. A column rests once its residual is reduced so far.
    """
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    start = beta.copy()
    live = beta > 0
    safe = lambda a: np.where(np.abs(a) > 0, a, 1.0)
    v, before = b / safe(beta), np.zeros_like(b)
    w, w_before = np.zeros_like(b), np.zeros_like(b)
    cos, cos_before, sin, sin_before = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta = beta.copy()
    last = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = times(v) - last * before
        alpha = np.sum(v * p, axis=0)
        p = p - alpha * v
        after = np.linalg.norm(p, axis=0)
        delta = cos * alpha - cos_before * sin * last
        long = np.hypot(delta, after)
        middle = sin * alpha + cos_before * cos * last
        far = sin_before * last
        live = live & (long > 0)
        c, s = np.where(long > 0, delta / safe(long), 1.0), np.where(long > 0, after / safe(long), 0.0)
        turn = (v - far * w_before - middle * w) / safe(long)
        x = x + np.where(live, c * eta, 0.0) * turn
        eta = np.where(live, -s * eta, eta)
        live = live & (np.abs(eta) > reduce * start) & (after > 0)
        w_before, w = w, turn
        before, v = v, p / safe(after)
        cos_before, cos, sin_before, sin = cos, c, sin, s
        last = after
    return x


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what a block adds to others; columns that add nothing are left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(3):
        for q in against:
            block = block - q @ (q.T @ block)
    q, r, _ = _pivoted(block)
    q = q[:, r > 1e-8]
    for q2 in against:
        q = q - q2 @ (q2.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def _pivoted(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not block.shape[1]:
        return block, np.zeros(0), np.zeros((0, 0))
    u, s, vt = np.linalg.svd(block, full_matrices=False)
    return u, s, vt


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, inner_steps: int = 6, inner_reduce: float = 0.05, most_basis: int | None = None, most_rounds: int = 200, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues (falling) of a symmetric positive operator of d dimensions, and their unit eigenvectors, to double precision.

    The subspace grows by corrections t of all open Ritz pairs (theta, u) at once: (I - QQ')(A - theta I)(I - QQ') t = -r, in which Q holds the locked vectors and the open u, solved by
    some steps of MINRES a column. Rayleigh-Ritz on the subspace uses the kept products, so a round costs inner_steps + 1 products, each of a block and one pass over the data.
    A pair is locked, in order from the largest, once its residual, measured by a product of its own, is within a small multiple of the rounding of A's norm; then it is taken out of the subspace.
    A subspace beyond most_basis columns is restarted with its best Ritz vectors.
    """
    wanted = min(wanted, d)
    rng = np.random.default_rng(seed)
    block = min(d, wanted + 4)
    most_basis = min(d, most_basis or max(3 * wanted + 8, 48))
    locked, values = np.zeros((d, 0)), []
    basis = _orthonormal(rng.standard_normal((d, block)))
    image = times(basis)
    norm, best = 0.0, np.inf
    still = 0
    for _ in range(most_rounds):
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        norm = max([norm, *np.abs(theta[:1]).tolist(), *values[:1]])
        need = wanted - len(values)
        ritz, ritz_image = basis @ s, image @ s
        r = ritz_image[:, :need] - ritz[:, :need] * theta[:need]
        r = r - locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        within = 8 * EPS * np.sqrt(d) * max(norm, np.finfo(np.float64).tiny)
        # The kept products carry the rounding of the rotations, so a pair near its goal is measured anew.
        near = np.flatnonzero(size <= 64 * within)
        ready = 0
        if len(near) and near[0] == 0:
            ready = int(np.argmin(np.r_[size <= 64 * within, False]))
            fresh = times(ritz[:, :ready])
            ritz_image[:, :ready] = fresh
            theta[:ready] = np.sum(ritz[:, :ready] * fresh, axis=0)
            exact = fresh - ritz[:, :ready] * theta[:ready]
            size[:ready] = np.linalg.norm(exact - locked @ (locked.T @ exact), axis=0)
            still = 0 if size[0] < 0.5 * best else still + 1
            best = min(best, float(size[0]))
            # Rounding of a pass may lie above the goal; what no longer falls, and is small, is as exact as products are.
            goal = within if still < 3 else 64 * within
            ready = int(np.argmin(np.r_[size[:ready] <= goal, False]))
        if ready or basis.shape[1] + locked.shape[1] >= d and len(size) and (size <= 64 * within).all():
            ready = ready or need
            locked = np.hstack([locked, ritz[:, :ready]])
            values += theta[:ready].tolist()
            best, still = np.inf, 0
            if len(values) >= wanted:
                break
            basis, image, r, need = ritz[:, ready:], ritz_image[:, ready:], r[:, ready:], need - ready
            ritz, ritz_image, theta = basis, image, theta[ready:]
        if basis.shape[1] + len(values) >= d:
            # The whole space: only rounding is left, so the products are made anew.
            basis = _orthonormal(ritz, locked)
            image = times(basis)
            continue
        if basis.shape[1] + need > most_basis:
            keep = min(need + 8, basis.shape[1])
            basis, image = ritz[:, :keep], ritz_image[:, :keep]
        open_, shift = ritz[:, :need], theta[:need]
        frame = np.hstack([locked, open_])
        out = lambda y: y - frame @ (frame.T @ y)
        t = minres(lambda y: out(times(out(y)) - out(y) * shift), -out(r), inner_steps, inner_reduce)  # noqa: B023
        added = _orthonormal(np.hstack([t, rng.standard_normal((d, 1))]), locked, basis)
        basis, image = np.hstack([basis, added]), np.hstack([image, times(added)])
    else:
        raise RuntimeError(f"{len(values)} of {wanted} pairs after {most_rounds} rounds")
    # Close pairs may be locked out of order.
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.linalg.qr(locked[:, order])[0]


@dataclass
class Whitener:
    """centre, eigenvalues e and unit eigenvectors, and what of the variance each explains."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def _trace(rows: DataFrame, c: Centre) -> float:
    whole, rest = c.mean()

    def work(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        out = [float(np.square(_centred(x, whole, rest)).sum()) for x in parts]
        return np.array([[sum(out)]]) if out else None

    return float(_summed(rows, work, len(c.sums))[0, 0]) / c.n


def fit(rows: DataFrame, components: int, **how) -> Whitener:
    """The first components of the covariance of x over all rows. Those whose eigenvalue is 0 but for rounding can't be whitened and are left out."""
    c = centre(rows)
    total = _trace(rows, c)
    if not total > 0:
        return Whitener(c, np.zeros(0), np.zeros((len(c.sums), 0)), np.zeros(0))
    values, vectors = jacobi_davidson(products(rows, c), len(c.sums), components, **how)
    real = values > 64 * EPS * len(c.sums) * values[0]
    return Whitener(c, values[real], vectors[:, real], values[real] / total)


def identity_error(rows: DataFrame, w: Whitener) -> float:
    """The largest entry, in size, of the whitened vectors' covariance (centred, then multiplied) less the identity."""
    whole, rest = w.centre.mean()
    turn = w.vectors / np.sqrt(w.values)
    d, n, k = len(whole), w.centre.n, len(w.values)
    total = lambda parts, f: sum((f(_centred(x, whole, rest) @ turn) for x in parts), np.zeros((1, 1)))
    mean = _summed(rows, lambda parts: total(parts, lambda y: y.sum(axis=0, keepdims=True)), d) / n
    square = _summed(rows, lambda parts: total(parts, lambda y: (y - mean).T @ (y - mean)), d)[:k, :k] / n
    return float(np.abs(square - np.eye(k)).max())


def whiten(rows: DataFrame, w: Whitener, id_type: str = "long") -> DataFrame:
    """vec_id, deviation (exact: the sum over dimensions of (n x - S) squared; null beyond a long) and whitened (array of a double a component) of each row."""
    whole, rest = w.centre.mean()
    turn = w.vectors / np.sqrt(w.values)
    n, sums = w.centre.n, w.centre.sums
    d, k = len(sums), len(w.values)

    def deviations(x: np.ndarray) -> list:
        # n x - S = n (x - whole) - S mod n; exact in 64 bits where the bound says so, else in integers of any size.
        rest_sums = [s % n for s in sums]
        off = x - whole
        if (int(np.abs(off).max(initial=0)) + 1) ** 2 * n * n * d < 1 << 62:
            y = off * n - np.array(rest_sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = off.astype(object) * n - np.array(rest_sums, object)
        return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(j, 2048) for j in range(0, len(batch), 2048)):
                x = _matrix(part, d)
                lines = pa.FixedSizeListArray.from_arrays(pa.array((_centred(x, whole, rest) @ turn).ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviations(x), pa.int64()), lines], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(work, f"vec_id {id_type}, deviation long, whitened array<double>")


def whitened_components(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component (numbered from 1 by falling eigenvalue): vec_id, component, n, deviation, whitened, explained, identity_error.

    All remaining vectors are fitted and whitened; see quantised for those that are dropped. Null and repeated ids keep their rows, other columns
    are ignored. There are as many components as dimensions at most, and none with an eigenvalue of zero; equal vectors only, or none, give no rows.
    """
    spark = vectors.sparkSession
    rows, d = quantised(vectors, id_col, vector_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    none = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(rows, components) if d else None
    if w is None or not len(w.values):
        return spark.createDataFrame([], none)
    error = identity_error(rows, w)
    out = whiten(rows, w, id_type).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*(F.lit(float(e)) for e in w.explained))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(w.centre.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
