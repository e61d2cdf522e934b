"""Embedding near-duplicates by counting collisions in many sorted one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, erf, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import components, roots, stored


class Plan:
    """Cells, projections, window and count threshold for a similarity, calibrated for recall.

    Unit vectors of at least this cosine are at most apart = sqrt(2 - 2 cos) from each other. Along one of
    many random orthonormal directions their difference is about normal with deviation
    apart / sqrt(dimensions).

    window is two deviations; a pair must collide in at least threshold of the projections, which a
    pair at the very limit of the similarity does with the probability 1 - miss. Cells group rows by
    cell_directions projections, each rounded to cell_width; so many shifted tables are taken that such a
    pair shares a cell of one of them with the probability 1 - miss.
    """

    def __init__(self, dimensions: int, least_cosine: float, rows: int, projections: int = 24, miss: float = 5e-4, cell_rows: int = 256, seed: int = 5):
        rng = np.random.default_rng(seed)
        deviation = sqrt(max(2 - 2 * least_cosine, 1e-12) / dimensions)
        self.window = 2 * deviation
        self.projections = min(projections, dimensions)
        hit = erf(self.window / deviation / sqrt(2))
        tail = lambda k: sum(comb(self.projections, j) * hit**j * (1 - hit) ** (self.projections - j) for j in range(k, self.projections + 1))
        self.threshold = max(k for k in range(self.projections + 1) if tail(k) >= 1 - miss)
        self.cell_width = 6 * deviation
        stay = 1 - sqrt(2 / pi) * deviation / self.cell_width
        # A direction of unit vectors spreads with deviation 1 / sqrt(dimensions): into about so many cells.
        spread = max(1.5, 2 * sqrt(pi) / sqrt(dimensions) / self.cell_width)
        self.cell_directions = min(max(0, round(log(max(1, rows / cell_rows)) / log(spread))), max(1, dimensions // 2))
        self.tables = max(1, ceil(log(miss) / log(max(1 - stay**self.cell_directions, 1e-9)))) if self.cell_directions else 1
        basis = lambda: np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0]
        self.directions = basis()[:, : self.projections]
        self.cell_axes = [basis()[:, : self.cell_directions] for _ in range(self.tables)]
        self.shifts = [rng.random(self.cell_directions) * self.cell_width for _ in range(self.tables)]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables): a hash of each row's cell in each table."""
        out = np.zeros((len(unit), self.tables), np.uint64)
        for t in range(self.tables):
            grid = np.floor((unit @ self.cell_axes[t] + self.shifts[t]) / self.cell_width).astype(np.int64)
            h = np.full(len(unit), t + 1, np.uint64)
            for k in range(grid.shape[1]):
                h = (h ^ grid[:, k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, t] = h
        return out


def collisions(p: np.ndarray, q: np.ndarray, window: float, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of p, row of q) with at least threshold projections within the window.

    Each projection of q is sorted; the window around each query of p is a run of that order, whose members
    get a collision more. Queries go in strips, so that the counters stay small.
    """
    n, m = len(q), p.shape[1]
    order = np.argsort(q, 0, kind="stable")
    in_order = np.take_along_axis(q, order, 0)
    left, right = [], []
    strip = max(1, 2_000_000 // max(n, 1))
    for s in range(0, len(p), strip):
        part = p[s : s + strip]
        count = np.zeros(len(part) * n, np.int16)
        for k in range(m):
            lo = np.searchsorted(in_order[:, k], part[:, k] - window, "left")
            size = np.searchsorted(in_order[:, k], part[:, k] + window, "right") - lo
            query = np.repeat(np.arange(len(part)), size)
            at = np.arange(len(query)) - np.repeat(np.cumsum(size) - size - lo, size)
            count[query * n + order[at, k]] += 1  # a query meets a row once in each projection
        hit = np.flatnonzero(count >= threshold)
        left.append(hit // n + s)
        right.append(hit % n)
    return np.concatenate(left), np.concatenate(right)


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by a power of two near their largest entry first, so that squares stay in range and no digit is lost."""
    values = np.ldexp(values, -np.frexp(np.abs(values).max(axis=1))[1][:, None])
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def _cell_links(plans: dict[int, Plan], least_cosine: float, kind: str):
    """For the rows (id, copies, vector, block, ...) of a cell's two blocks: links and numbers of links."""

    def work(table: pa.Table) -> pa.Table:
        t, plan = table.column("t")[0].as_py(), plans[table.column("d")[0].as_py()]
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
        unit = _unit(np.frombuffer(b"".join(table.column("raw").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
        cells = plan.cells(unit)
        p = unit @ plan.directions
        first, second = np.flatnonzero(block == one), np.flatnonzero(block == two)
        if not len(first) or not len(second):
            x = y = np.zeros(0, np.int64)
        else:
            x, y = collisions(p[first], p[second], plan.window, plan.threshold)
            x, y = first[x], second[y]
        keep = ids[x] < ids[y] if one == two else ids[x] != ids[y]
        x, y = x[keep], y[keep]
        keep = ~(cells[x, :t] == cells[y, :t]).any(1)  # found in an earlier table already
        x, y = x[keep], y[keep]
        near = np.zeros(len(x), bool)
        for a in range(0, len(x), 100_000):
            near[a : a + 100_000] = np.einsum("ij,ij->i", unit[x[a : a + 100_000]], unit[y[a : a + 100_000]]) >= least_cosine
        x, y = x[near], y[near]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        by = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by] = np.arange(len(ids))
        root = by[roots(place[x], place[y], len(ids))][place] if len(x) else np.arange(len(ids))
        out = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[out]), "root": pa.array(ids[root[out]]), "links": pa.array(links[out])})

    return work


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = 500) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: vectors of equal label and high cosine are linked.

    Cosines are in double precision. Equal vectors of a label are one entry with a number of copies.
    Entries are dealt out by label and cell of several shifted tables; in a cell, collisions of
    query-centred windows in sorted projections are counted, and pairs with enough of them are verified.
    A pair is counted in the first table in which it shares a cell, so numbers of links add up without a
    row per pair. A cell of more than about block_rows entries is cut into blocks and each two blocks
    are compared by a task of their own.

    Vectors of each length are compared among themselves. Rows carry their vector as it is in the table, 4 bytes a number of single precision.

    A vector that is null, empty, zero, or holds nulls or non-finite values,
    and one with a null label, has no links and is its own component. Null ids are kept, alone.
    Repeated rows count as copies of each other. An empty table gives no rows.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    # By the entries and not by a sum of squares, which leaves the range of doubles long before they do.
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine
    source = source.select("vec_id", "label", "v", F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64("v").alias("h"), F.size("v").alias("d"))
    base = stored(source, "vectors")
    alone = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    entries = stored(base.where("usable").groupBy("label", "d", "h", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-entries")
    most = entries.groupBy("label", "d").count().groupBy("d").agg(F.max("count").alias("n")).collect()  # a row a length
    if not most:
        return alone
    plans = {r["d"]: Plan(r["d"], least_cosine, r["n"]) for r in most}

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(4).to_numpy()
            for d in np.unique(lengths).tolist():
                part, plan = batch.filter(pa.array(lengths == d)), plans[d]
                values = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                cells = plan.cells(_unit(values)).view(np.int64)
                raw = pa.array([x.tobytes() for x in values.astype(kind)], pa.binary())
                for t in range(plan.tables):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), raw, part.column(4), pa.array(np.full(len(part), t, np.int32)), pa.array(cells[:, t])], ["label", "id", "copies", "raw", "d", "t", "cell"])

    placed = entries.select("label", "id", "copies", "v", "d").mapInArrow(celled, "label string, id long, copies long, raw binary, d int, t int, cell long")
    sizes = placed.groupBy("label", "d", "t", "cell").agg(F.count("*").alias("n")).where("n > 1")
    placed = placed.join(stored(sizes, "cells"), ["label", "d", "t", "cell"])
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    keys = ["label", "d", "t", "cell", "one", "two"]
    dealt = paired.select(*keys, "id", "copies", "raw", "block").repartition(*keys)  # else all blocks of a cell stay in its task
    found = stored(dealt.groupBy(*keys).applyInArrow(_cell_links(plans, least_cosine, kind), "id long, root long, links long"), "vector-links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    entry = entries.join(linked, "id", "left").join(member, F.col("id") == F.col("node"), "left").select(F.col("label").alias("_label"), F.col("h").alias("_h"), F.col("v").alias("_v"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "id").alias("component_id"))
    joined = base.join(entry, F.col("usable") & (F.col("label") == F.col("_label")) & (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
