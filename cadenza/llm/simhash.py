"""SimHash near-duplicates by a Gray-ordered hierarchical index of fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, log, log2, pi
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import KeySet, components, grouped_links, roots, stored, with_anchors

ONES = (1 << 64) - 1


def row_key(doc_id: Column, h: Column) -> Column:
    """16 bytes for a row's id (long) and the hash of its text; without an id, the hash and its complement."""
    return F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (F.coalesce(doc_id, F.bitwise_not(h)), h))))


def shingle_hashes(text: str | None, width: int, seeds: tuple[int, ...]) -> np.ndarray:
    """XXH64 of each word shingle, a column for each seed.

    A-Z are lower-cased; words are what spaces, tabs and line ends part; words are joined by one space.
    Fewer words than width make one shingle; no word makes none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros((0, len(seeds)), np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[width - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.stack([np.fromiter((digest(joined[a:b], s) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends)) for s in seeds], 1)


def fingerprint(hashes: np.ndarray) -> list[int]:
    """A bit of each column's fingerprint is 1 if it is set in over half of the hashes; none: zero."""
    n, k = hashes.shape
    if not n:
        return [0] * k
    out = []
    for c in range(k):
        count = np.zeros(64, np.int64)
        column = np.ascontiguousarray(hashes[:, c].astype("<u8"))
        for a in range(0, n, 1 << 15):  # long texts in parts
            count += np.unpackbits(column[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, width: int = 4, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and f0, f1, ... (a 64-bit word of the fingerprint for each seed, as signed long)."""
    names = [f"f{k}" for k in range(len(seeds))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(shingle_hashes(x.as_py(), width, seeds)) for x in batch.column(1)], np.uint64).reshape(-1, len(seeds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[:, k]) for k in range(len(seeds)))], ["doc_id", *names])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(work, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def pigeonhole_masks(most_differing: int, rows: int) -> list[tuple[int]]:
    """Masks of 64 bits one of which shows two fingerprints equal if at most so many bits differ.

    The bits are cut into blocks; of most_differing + r blocks, r at least are equal, and each r of
    them make a mask. r grows with the rows, so that a masked pattern is shared by few of them.
    """
    for r in range(1, 64 - most_differing + 1):
        blocks = most_differing + r
        if rows <= 2000 << (64 * r // blocks) or blocks >= most_differing + 4:
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in range(blocks)]
    return [(sum(c),) for c in combinations(parts, r)]


def gray_rank(f: np.ndarray) -> np.ndarray:
    """The rank of 64-bit words in reflected Gray order: neighbours in it differ in one bit."""
    f = f.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        f = f ^ (f >> np.uint64(s))
    return f


def budgets(most_differing: int | tuple[int, ...], words: int) -> tuple[int, ...]:
    """How many bits may differ up to the end of each word: one number is for all of the fingerprint."""
    return tuple(most_differing) if isinstance(most_differing, tuple) else (most_differing,) * words


def near_pairs(group: np.ndarray, f: np.ndarray, most_differing: int | tuple[int, ...], step: int = 16, chunk: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a < b) of equal group whose fingerprints f (n, words) differ in few enough bits (see budgets).

    Rows are ordered by group and Gray rank, so that rows which share a pattern of leading bits lie
    together: groups are the top nodes, patterns of the first 16, 32, ... bits those below. Pairs of
    nodes descend with the differences of the bits so far; a pair of nodes over the budget goes with
    everything below it. Pairs of nodes are expanded chunk by chunk, so memory stays bounded.
    """
    n, words = f.shape
    most = budgets(most_differing, words)
    order = np.lexsort([gray_rank(f[:, w]) for w in reversed(range(words))] + [group])
    f, group = f[order], group[order]
    change = np.ones(n + 1, bool)
    change[1:n] = group[1:] != group[:-1]
    levels = [np.flatnonzero(change)]
    masks = []
    for w in range(words):
        for b in range(64 - step, -1, -step):
            mask = np.uint64(((1 << step) - 1) << b)
            seen = np.uint64(ONES & ~((1 << b) - 1))
            change[1:n] |= (f[1:, w] & seen) != (f[:-1, w] & seen)
            levels.append(np.flatnonzero(change))
            masks.append((w, mask))
    below = [np.searchsorted(low, up) for up, low in zip(levels, levels[1:], strict=False)]  # a node's first child
    top = np.arange(len(levels[0]) - 1)
    top = top[np.diff(levels[0]) > 1]
    work = [(0, top, top, np.zeros(len(top), np.int64))]
    while work:
        level, a, b, acc = work.pop()
        if level == len(masks):
            apart = a != b
            x, y = order[levels[level][a[apart]]], order[levels[level][b[apart]]]
            if len(x):
                yield np.minimum(x, y), np.maximum(x, y)
            # rows of equal fingerprint in one group are one node; they are linked to its first row
            same = a[~apart]
            lo, hi = levels[level][same], levels[level][same + 1]
            many = np.flatnonzero(hi - lo > 1)
            for k in many:
                rest = order[lo[k] + 1 : hi[k]]
                first = np.full(len(rest), order[lo[k]])
                yield np.minimum(first, rest), np.maximum(first, rest)
            continue
        first = below[level]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        cost = np.cumsum(na * nb)
        if len(a) > 1 and cost[-1] > chunk:
            for part in np.split(np.arange(len(a)), np.unique(np.searchsorted(cost, np.arange(chunk, cost[-1], chunk)))):
                if len(part) == len(a):  # no cut found: halve
                    half = len(a) // 2
                    work += [(level, a[:half], b[:half], acc[:half]), (level, a[half:], b[half:], acc[half:])]
                    break
                if len(part):
                    work.append((level, a[part], b[part], acc[part]))
            continue
        w, mask = masks[level]
        for i0, i1 in _slices(na, nb, chunk):
            if i0 is None:  # one pair of large nodes: by rows of the first
                (k, r0, r1) = i1
                ca = np.repeat(np.arange(first[a[k]] + r0, first[a[k]] + r1), nb[k])
                cb = np.tile(np.arange(first[b[k]], first[b[k]] + nb[k]), r1 - r0)
                parent = np.full(len(ca), k)
            else:
                parent = np.repeat(np.arange(i0, i1), (na * nb)[i0:i1])
                at = np.arange(len(parent)) - np.repeat(np.cumsum((na * nb)[i0:i1]) - (na * nb)[i0:i1], (na * nb)[i0:i1])
                ca = first[a[parent]] + at // nb[parent]
                cb = first[b[parent]] + at % nb[parent]
            keep = (a[parent] != b[parent]) | (ca <= cb)
            ca, cb, parent = ca[keep], cb[keep], parent[keep]
            low = levels[level + 1]
            diff = acc[parent] + np.bitwise_count((f[low[ca], w] ^ f[low[cb], w]) & mask)
            keep = diff <= most[w]
            if keep.any():
                work.append((level + 1, ca[keep], cb[keep], diff[keep]))


def _slices(na: np.ndarray, nb: np.ndarray, chunk: int) -> Iterator[tuple]:
    if len(na) == 1 and na[0] * nb[0] > chunk:
        rows = max(1, chunk // int(nb[0]))
        for r in range(0, int(na[0]), rows):
            yield None, (0, r, min(r + rows, int(na[0])))
    else:
        yield 0, len(na)


class NestedMask(NamedTuple):
    """A mask of few bits, by which rows are dealt out, and masks of more bits that hold it, by which a task tells nodes in what it gets."""

    base: tuple
    finer: tuple


def mask_plan(
    rows: int, words: int, differing: float, miss: float = 2e-4, node_rows: int = 16, least_bits: int = 14, group_rows: int = 32_768, least_base: int = 5, finer_miss: float = 0.2, seed: int = 11
) -> list[NestedMask]:
    """Random masks for so many rows: bits for about node_rows unrelated rows a node, masks so that a pair whose fingerprints differ in so many bits is missed by all with a probability of miss.

    A row moves once for each base mask, whose bits make groups of at most about group_rows unrelated rows; of a pair in one group
    the finer masks miss at most the share finer_miss, and there are the more base masks for it.
    """
    bits = max(least_bits, ceil(log2(max(rows, 1) / node_rows)))
    base = max(least_base, ceil(log2(max(rows, 1) / group_rows)))
    same = 1 - differing / (64 * words)
    finer = ceil(log(finer_miss) / log(1 - same ** (bits - base)))
    found = same**base * (1 - (1 - same ** (bits - base)) ** finer)
    rng = np.random.default_rng(seed)
    mask = lambda drawn: tuple(sum(1 << (b % 64) for b in drawn if b // 64 == w) for w in range(words))
    out = []
    for _ in range(ceil(log(miss) / log(1 - found))):
        drawn = [int(b) for b in rng.permutation(64 * words)]
        own, rest = drawn[:base], drawn[base:]
        out.append(NestedMask(mask(own), tuple(mask([*own, *(rest[int(k)] for k in rng.permutation(len(rest))[: bits - base])]) for _ in range(finer))))
    return out


def finer_nodes(node: np.ndarray, f: np.ndarray, masks: np.ndarray, k: int) -> np.ndarray:
    """A hash for each row of its group (node), of k and of its fingerprint's bits under its mask."""
    h = node.view(np.uint64) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & ONES)
    for w in range(f.shape[1]):
        h = (h ^ (f[:, w] & masks[:, w])) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0x94D049BB133111EB)).view(np.int64)


class FinerNodes:
    """Deals rows of groups out to the nodes of the finer masks: takes and gives rows with node, a row for each mask."""

    def __init__(self, words: int, finer: list[tuple]):
        self.words, self.finer = words, np.array(finer, np.uint64)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            f = np.stack([batch.column(f"f{w}").to_numpy() for w in range(self.words)], 1).view(np.uint64)
            for k in range(self.finer.shape[1]):
                yield batch.set_column(batch.schema.get_field_index("node"), "node", pa.array(finer_nodes(node, f, self.finer[node & 0xFFFF, k], k)))


def near_links(distinct: DataFrame, masks: list[tuple], most_differing: int | tuple[int, ...], words: int, least: float | None = None, node_rows: int = 4096, group_rows: int = 262_144) -> DataFrame:
    """Links (a, b) between the labels of distinct fingerprints (id, f0, ...) with few differing bits.

    A column label, if there, says which rows are linked already; else id is the label. With least, distinct has the
    size n of each row's set; sets whose sizes rule out that Jaccard similarity aren't linked.

    Every mask's bit pattern is an upper node. Rows are dealt out by mask and pattern and sorted by
    them and by Gray rank; a task walks its nodes in turn. Of the pairs found in a node only a spanning
    forest goes out, so a large group of copies gives a link per row. A node of more than node_rows rows is left to a
    second step, which deals its rows out over many tasks (grouped_links).

    With nested masks rows are dealt out by the base masks, and tasks tell the nodes in each group. A group of more
    than group_rows rows, or with a node of too many unlike rows, is dealt out by the finer masks after.
    """
    names = [f"f{w}" for w in range(words)]
    kept = ["id", "label", *names, *(["n"] if least else [])]
    label = F.col("label") if "label" in distinct.columns else F.col("id").alias("label")
    rows = distinct.select("id", label, *kept[2:])
    under = lambda m: [F.col(n).bitwiseAND(F.lit(_signed(m[w]))) for w, n in enumerate(names)]
    further = [*names, *(["n"] if least else [])]
    before = None
    if isinstance(masks[0], NestedMask):
        finer = [m.finer for m in masks]
        groups = rows.select(*kept, F.explode(F.array(*(F.shiftleft(F.xxhash64(*under(m.base)), 16).bitwiseOR(F.lit(k).cast("long")) for k, m in enumerate(masks)))).alias("node"))
        before, hot = _walked(groups, NodeWalk(words, most_differing, rows=group_rows, least=least, node_rows=node_rows, finer=finer))
        if hot.isEmpty():
            return before
        entries = groups.join(hot, F.col("node") == F.col("_node")).select(groups.columns).mapInArrow(FinerNodes(words, finer), groups.schema)
    else:
        entries = rows.select(*kept, F.explode(F.array(*(F.struct(F.lit(k).alias("m"), *(p.alias(f"p{w}") for w, p in enumerate(under(m)))) for k, m in enumerate(masks)))).alias("node")).select(*kept, F.xxhash64("node").alias("node"))
    found, hot = _walked(entries, NodeWalk(words, most_differing, least=least, node_rows=node_rows))
    if before is not None:
        found = before.unionAll(found)
    if hot.isEmpty():
        return found
    rows = stored(entries.join(hot, F.col("node") == F.col("_node")).select(F.col("node").alias("g"), "id", F.col("label").alias("k"), F.lit(1).alias("w"), *further), "node-rows")
    apart, near = F.lit(0), F.lit(True)
    for n, most in zip(names, budgets(most_differing, words), strict=True):
        apart = apart + F.bit_count(F.col(n).bitwiseXOR(F.col(f"_{n}")))
        near = near & (apart <= most)
    if least:
        near = near & (F.least("n", "_n") >= F.greatest("n", "_n") * F.lit(least) - 1e-6)
    return found.unionAll(grouped_links(stored(with_anchors(rows), "group-rows"), near, CellCompare(words, most_differing, least), node_rows // 2))


def _walked(entries: DataFrame, walk: NodeWalk) -> tuple[DataFrame, DataFrame]:
    """The links that a walk of all nodes finds, and the nodes (_node) that it leaves to others."""
    found = stored(entries.repartition("node").sortWithinPartitions("node").mapInArrow(walk, "a long, b long"), "node-links")
    return found.where("b is not null"), stored(found.where("b is null").select(F.col("a").alias("_node")).distinct(), "nodes-hot")


class ByCell:
    """Takes rows sorted by the first column and hands on whole runs of equal ones, many at a time."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            cell = batch.column(0).to_numpy()
            if not len(cell):
                continue
            if held and cell[0] != last:
                yield from self.cells(pa.Table.from_batches(held).combine_chunks())
                held = []
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:  # the last cell may go on in the next batch
                yield from self.cells(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
            last = cell[-1]
        if held:
            yield from self.cells(pa.Table.from_batches(held).combine_chunks())

    def cells(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The links between the two sides of each cell, thinned to a forest."""
        cell, side, key = (table.column(c).to_numpy() for c in ("cell", "side", "k"))
        edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            half = lo + int(np.searchsorted(side[lo:hi], 1))
            if lo < half < hi:
                x, y = self.linked(table, lo, half, hi)
                if len(x):
                    yield _forest(key, x, y)


def _forest(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the links key[x]-key[y]."""
    ends, at = np.unique(np.r_[key[x], key[y]], return_inverse=True)
    root = roots(at[: len(x)], at[len(x) :], len(ends))
    leaf = np.flatnonzero(root != np.arange(len(ends)))
    return pa.RecordBatch.from_arrays([pa.array(ends[leaf]), pa.array(ends[root[leaf]])], ["a", "b"])


def joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs of a boolean matrix that connect what all its true cells connect."""
    left, rows, columns = near.any(1), [], []
    while left.any():
        first = int(left.argmax())
        group, reached = np.zeros(len(near), bool), near[first].copy()
        group[first] = True
        fresh = reached
        while True:
            more = near[:, fresh].any(1) & ~group
            if not more.any():
                break
            group |= more
            fresh = near[more].any(0) & ~reached
            reached |= fresh
        members, ends = np.flatnonzero(group), np.flatnonzero(reached)
        rows += [members, np.full(len(ends), first)]
        columns += [near[members].argmax(1), ends]
        left &= ~group
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


def near_matrix(f: np.ndarray, g: np.ndarray, most_differing: int | tuple[int, ...], n: np.ndarray | None = None, m: np.ndarray | None = None, least: float | None = None) -> np.ndarray:
    """Which rows of f are near which of g: by differing bits, and by what the sizes n and m of their sets allow."""
    apart, near = np.zeros((len(f), len(g)), np.int16), np.ones((len(f), len(g)), bool)
    for w, most in enumerate(budgets(most_differing, f.shape[1])):
        apart += np.bitwise_count(f[:, w][:, None] ^ g[:, w][None, :])
        near &= apart <= most
    if least:
        near &= np.minimum(n[:, None], m[None, :]) >= least * np.maximum(n[:, None], m[None, :]) - 1e-6
    return near


class CellCompare(ByCell):
    """Links of the near fingerprints of two blocks of a node."""

    def __init__(self, words: int, most_differing: int | tuple[int, ...], least: float | None, strip: int = 512):
        self.words, self.most, self.least, self.strip = words, most_differing, least, strip

    def linked(self, table: pa.Table, lo: int, half: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        f = np.stack([table.column(f"f{w}").to_numpy() for w in range(self.words)], 1).view(np.uint64)
        n = table.column("n").to_numpy() if self.least else None
        size = lambda a, b: n[a:b] if self.least else None
        x, y = [], []
        for a in range(lo, half, self.strip):
            b = min(a + self.strip, half)
            r, c = joined(near_matrix(f[a:b], f[half:hi], self.most, size(a, b), size(half, hi), self.least))
            x.append(r + a)
            y.append(c + half)
        return np.concatenate(x), np.concatenate(y)


class NodeWalk:
    """The task side of near_links: takes rows sorted by node, many nodes at a time.

    Gives links (a, b), and (node, null) for a node of too many rows. With finer masks (those of mask k for a node
    whose last 16 bits are k) the nodes are groups, in which the masks tell nodes.
    """

    def __init__(self, words: int, most_differing: int | tuple[int, ...], rows: int = 100_000, least: float | None = None, node_rows: int = 4096, dense: int = 128, finer: list[tuple] | None = None):
        self.words, self.most, self.rows, self.least, self.node_rows, self.dense = words, most_differing, rows, least, node_rows, dense
        self.finer = None if finer is None else np.array(finer, np.uint64)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, hot = 0, None
        for batch in batches:
            if hot is not None:
                batch = batch.filter(pa.array(batch.column("node").to_numpy() != hot))
            held.append(batch)
            count += len(batch)
            if count >= self.rows:
                table = pa.Table.from_batches(held)
                node = table.column("node").to_numpy()
                cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0
                if cut:  # the last node may go on in the next batch
                    yield from self.links(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                else:
                    hot, held = node[0], []
                    yield self._hot(node[:1])
                count = len(table) - cut if cut else 0
        if count:
            yield from self.links(pa.Table.from_batches(held))

    @staticmethod
    def _hot(nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64())], ["a", "b"])

    def near(self, f: np.ndarray, n: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of rows x, y that are near."""
        apart = np.zeros(len(x), np.int16)
        for w, most in enumerate(budgets(self.most, self.words)):
            apart = apart + np.bitwise_count(f[x, w] ^ f[y, w])
            keep = apart <= most
            x, y, apart = x[keep], y[keep], apart[keep]
        if self.least:
            keep = np.minimum(n[x], n[y]) >= self.least * np.maximum(n[x], n[y]) - 1e-6
            x, y = x[keep], y[keep]
        return x, y

    def grouped(self, node: np.ndarray, label: np.ndarray, f: np.ndarray, n: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """The links in groups, mask by mask; what one mask has linked, the next ones needn't."""
        ends, own = np.unique(label, return_inverse=True)
        root = np.arange(len(ends))
        rows, hot = np.arange(len(node)), []

        def link(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal root
            a, b = root[own[x]], root[own[y]]
            root = roots(a[a != b], b[a != b], len(ends))[root]

        for k in range(self.finer.shape[1]):
            key = finer_nodes(node[rows], f[rows], self.finer[node[rows] & 0xFFFF, k], k)
            order = np.argsort(key, kind="stable")
            at, key = rows[order], key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[starts, len(key)])
            now = root[own[at]]
            mixed = np.minimum.reduceat(now, starts) != np.maximum.reduceat(now, starts)
            left = []
            for lo, m in zip(starts[mixed & (size > self.dense)].tolist(), size[mixed & (size > self.dense)].tolist(), strict=True):
                if not self.crowd(at[lo : lo + m], f, n, lambda: root[own], link):
                    left.append(node[at[lo]])
            few = np.repeat(mixed & (size <= self.dense), size)
            at, key = at[few], key[few]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(key)])
            after = np.repeat(first + size, size)  # where each row's node ends
            g = np.ascontiguousarray(f[at, 0])
            most, here, found, pending = budgets(self.most, self.words)[0], np.arange(len(at)), [], 0
            for step in range(1, int(size.max(initial=1))):
                here = here[here + step < after[here]]
                hit = here[np.bitwise_count(g[here] ^ g[here + step]) <= most]
                x, y = at[hit], at[hit + step]
                apart = root[own[x]] != root[own[y]]
                found.append(self.near(f, n, x[apart], y[apart]))
                pending += len(found[-1][0])
                if pending > 500_000:
                    link(*(np.concatenate(z) for z in zip(*found, strict=True)))
                    found, pending = [], 0
            if pending:
                link(*(np.concatenate(z) for z in zip(*found, strict=True)))
            if left:
                hot += left
                rows = rows[~np.isin(node[rows], left)]
                if not len(rows):
                    break
        if hot:
            yield self._hot(np.unique(hot))
        leaf = np.flatnonzero(root != np.arange(len(ends)))
        yield pa.RecordBatch.from_arrays([pa.array(ends[leaf]), pa.array(ends[root[leaf]])], ["a", "b"])

    def crowd(self, at: np.ndarray, f: np.ndarray, n: np.ndarray | None, labels: Callable, link: Callable, anchors: int = 8, cells: int = 1 << 21) -> bool:
        """Link the rows of a large node: all with some anchors, then those outside the largest class with all. False if these are too many."""
        some = at[np.linspace(0, len(at) - 1, anchors).astype(np.int64)]
        link(*self.near(f, n, np.repeat(at, anchors), np.tile(some, len(at))))
        now = labels()[at]
        kinds, times = np.unique(now, return_counts=True)
        apart = at[now != kinds[times.argmax()]]
        if len(apart) * len(at) > 16 * self.node_rows**2:
            return False
        strip = max(1, cells // len(at))
        for a in range(0, len(apart), strip):
            part = apart[a : a + strip]
            x, y = np.nonzero(np.bitwise_count(f[part, 0][:, None] ^ f[at, 0][None, :]) <= budgets(self.most, self.words)[0])
            link(*self.near(f, n, part[x], at[y]))
        return True

    def links(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = [f"f{w}" for w in range(self.words)]
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        # Nodes in which all have one label have nothing to link.
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[starts, len(node)])
        mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        hot = mixed & (size > (self.rows if self.finer is not None else self.node_rows))
        if hot.any():
            yield self._hot(node[starts[hot]])
        keep = np.repeat(mixed & ~hot, size)
        if not keep.any():
            return
        node, label = node[keep], label[keep]
        f = np.stack([table.column(n).to_numpy() for n in names], 1)[keep].view(np.uint64)
        n = table.column("n").to_numpy()[keep] if self.least else None
        if self.finer is not None:
            yield from self.grouped(node, label, f, n)
            return
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[starts, len(node)])
        x, y, pending = [], [], 0
        few = np.repeat(size <= self.dense, size)
        for lo, m in zip(starts[size > self.dense].tolist(), size[size > self.dense].tolist(), strict=True):
            for a in range(lo, lo + m, 512):
                b = min(a + 512, lo + m)
                part = lambda v, i, j: v[i:j] if self.least else None
                r, c = joined(near_matrix(f[a:b], f[lo : lo + m], self.most, part(n, a, b), part(n, lo, lo + m), self.least))
                x.append(r + a)
                y.append(c + lo)
        at = np.flatnonzero(few)
        for r, c in near_pairs(node[at], f[at], self.most):
            r, c = at[r], at[c]
            fit = label[r] != label[c]
            if self.least:
                fit &= np.minimum(n[r], n[c]) >= self.least * np.maximum(n[r], n[c]) - 1e-6
            x.append(r[fit])
            y.append(c[fit])
            pending += len(x[-1])
            if pending > 500_000:
                yield _forest(label, np.concatenate(x), np.concatenate(y))
                x, y, pending = [], [], 0
        if sum(map(len, x)):
            yield _forest(label, np.concatenate(x), np.concatenate(y))


def near_groups(distinct: DataFrame, masks: list[tuple], most_differing: int | tuple[int, ...], words: int, least: float | None = None, first: int = 12) -> DataFrame:
    """(node, component_id) of the fingerprints linked by near_links, also through others; those without a link are left out.

    Many masks are taken in two steps: what the first ones have linked is labelled, and the others only link labels. So a large group of near copies
    doesn't give a link for each row and mask.
    """
    member = None
    for part in [masks] if len(masks) <= 2 * first else [masks[:first], masks[first:]]:
        rows, known = distinct, None
        if member is not None:
            known = member.select(F.col("node").alias("a"), F.col("component_id").alias("b"))
            rows = stored(distinct.join(member, F.col("id") == F.col("node"), "left").select(*distinct.columns, F.coalesce("component_id", "id").alias("label")), "fingerprints-labelled")
        links = near_links(rows, part, most_differing, words, least)
        member = components(links if known is None else links.unionAll(known))
    return member


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, width: int = 4, most_differing: int = 4, seeds: tuple[int, ...] = (42,), masks: list[tuple] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f0, ... and component_id of every row: near-duplicate groups of whole texts.

    Rows are linked if their SimHash fingerprints (see fingerprints) differ in at most most_differing
    bits; component_id is the smallest doc_id reachable. Without masks the index is exact (pigeonhole,
    one 64-bit word); with random masks it finds a pair with the probability that one mask shows it equal.

    Equal fingerprints are one entry of the index, so copies cost nothing more. A null or empty text or
    one without words has fingerprint zero and is linked like any other. A row with a null id keeps its
    row and gets the component of its fingerprint (null if all ids of the component are null). Repeated
    rows each keep a row. An empty table gives no rows. Other columns are ignored.
    """
    words = len(seeds)
    names = [f"f{w}" for w in range(words)]
    base = stored(fingerprints(docs, width, seeds, id_col, text_col), "fingerprints")
    distinct = stored(base.groupBy(*names).agg(F.min("doc_id").alias("id")), "fingerprints-distinct")
    known = distinct.where("id is not null")
    masks = masks or pigeonhole_masks(most_differing, known.count())
    member = near_groups(known, masks, most_differing, words)
    labelled = distinct.join(member, F.col("id") == F.col("node"), "left").select(*names, F.coalesce("component_id", "id").alias("component_id"))
    return base.join(labelled, names).select("doc_id", *names, "component_id")


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """Words columns of hashes from one: itself, then each mixed with a multiple of a fixed odd number."""
    out = [hashes.astype(np.uint64)]
    for k in range(1, words):
        x = out[0] + np.uint64((k * 0x9E3779B97F4A7C15) & ONES)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, 1)


def shingle_sets(docs: DataFrame, width: int, seed: int, words: int) -> DataFrame:
    """doc_id, h (hash of the text), s (hash of the set of its shingles), n (the set's size) and the set's fingerprint f0, ..."""
    names = [f"f{k}" for k in range(words)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n, f = [], [], []
            for x in batch.column(2):
                one = np.unique(shingle_hashes(x.as_py(), width, (seed,))[:, 0])
                s.append(xxhash.xxh64_intdigest(one.tobytes(), 1))
                n.append(len(one))
                f.append(fingerprint(widened(one, words)))
            f = np.array(f, np.uint64).reshape(-1, words).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(s, np.uint64).astype(np.int64)), pa.array(n, pa.int32()), *(pa.array(f[:, k]) for k in range(words))], ["doc_id", "h", "s", "n", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(work, "doc_id long, h long, s long, n int, " + ", ".join(f"{x} long" for x in names))


def alike(values: np.ndarray, own: np.ndarray, side: np.ndarray, least: float, columns: int = 2048) -> np.ndarray:
    """Which sets of side 0 have a Jaccard similarity of at least least with which of side 1, as a boolean matrix.

    Set own[k] has values[k], each once. The intersections of all pairs are counted by products of membership matrices.
    """
    size = np.bincount(own, minlength=len(side))
    order = np.argsort(values, kind="stable")
    values, own = values[order], own[order]
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    times = np.diff(np.r_[start, len(values)])
    shared = np.repeat(times > 1, times)
    column = np.repeat(np.cumsum(times > 1) - 1, times)[shared]
    own = own[shared]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    place = np.zeros(len(side), np.int64)
    place[one], place[two] = np.arange(len(one)), np.arange(len(two))
    first = side[own] == 0
    both = np.zeros((len(one), len(two)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, (c, c + columns))
        width = int(column[hi - 1]) - c + 1
        at, left = column[lo:hi] - c, first[lo:hi]
        a, b = np.zeros((len(one), width), np.float32), np.zeros((len(two), width), np.float32)
        a[place[own[lo:hi][left]], at[left]] = 1
        b[place[own[lo:hi][~left]], at[~left]] = 1
        both += a @ b.T
    return both >= least * (size[one][:, None] + size[two][None, :] - both) - 1e-4


class BlockCompare(ByCell):
    """Links of the alike sets (hashes) of two blocks of a group."""

    def __init__(self, least: float):
        self.least = least

    def linked(self, table: pa.Table, lo: int, half: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = table.column("hashes").chunk(0).slice(lo, hi - lo)
        own = np.repeat(np.arange(hi - lo), hashes.value_lengths().to_numpy())
        r, c = joined(alike(hashes.flatten().to_numpy(), own, table.column("side").to_numpy()[lo:hi], self.least))
        return r + lo, c + half


def alike_links(docs: DataFrame, distinct: DataFrame, candidates: DataFrame, width: int, seed: int, least: float, shingles: int = 200_000) -> DataFrame:
    """Links (a, b) between the sets s of distinct whose texts have a Jaccard similarity of at least least, exactly.

    candidates (node, component_id) are groups of sets; what all pairs of a group would link is linked (grouped_links).
    distinct has for each s the row (first: doc_id and h) whose text stands for it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), width, (seed,))[:, 0]).astype(np.int64) for x in batch.column(0)]
            ends = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], ["g", "id", "m", "anchor", "hashes"])

    member = stored(candidates.join(distinct, F.col("node") == F.col("s")).select(F.col("component_id").alias("g"), F.col("s").alias("id"), F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h")), "near-candidates")
    member = stored(with_anchors(member), "near-candidates")
    # Texts that are no candidates stay where they are; only the others are moved to be joined.
    keys = KeySet.of(member.select(row_key(F.col("_id"), F.col("_h")).alias("key")), "near-keys", member.count(), file_rows=250_000)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    own = own.where(keys.having(row_key(F.col("doc_id"), F.col("h"))))
    # Stored, as a task that asks for keys and hashes texts, too, has two Python processes, and both stay for the tasks after it.
    rows = stored(own.join(member, own["doc_id"].eqNullSafe(member["_id"]) & (own["h"] == member["_h"])).select("text", "g", "id", "m", "anchor"), "near-texts")
    sets = rows.mapInArrow(work, "g long, id long, m long, anchor boolean, hashes array<long>").select("g", "id", F.col("id").alias("k"), F.greatest(F.size("hashes"), F.lit(shingles // 1024)).alias("w"), "m", "anchor", "hashes")
    n, m, shared = F.size("hashes"), F.size("_hashes"), F.size(F.array_intersect("hashes", "_hashes"))
    near = (F.least(n, m) >= F.greatest(n, m) * F.lit(least) - 1e-6) & (shared >= (n + m - shared) * F.lit(least) - 1e-6)
    return grouped_links(stored(sets, "near-sets"), near, BlockCompare(least), shingles)


def near_copies(docs: DataFrame, width: int, least: float, most_differing: tuple[int, ...], seed: int = 42) -> DataFrame:
    """doc_id and h (xxhash64 of the text) of the rows that are a near copy of another row which stays.

    Two texts are near copies if the sets of their word shingles have a Jaccard similarity of at least least. The index of
    SimHash fingerprints (a word of 64 bits for each number of most_differing) only finds groups of candidates (see mask_plan); a pair is a candidate if
    its bits differ in few enough places up to the end of each word. All links are checked exactly. Of each group of rows
    linked, also through others, the one with the smallest doc_id (then h; null ids last) stays. Texts without
    a word are equal. No two rows may have both doc_id and text equal.
    """
    words = len(most_differing)
    names = [f"f{w}" for w in range(words)]
    base = stored(shingle_sets(docs, width, seed, words), "shingle-sets")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    distinct = stored(base.groupBy("s").agg(F.min(row).alias("first"), *(F.min(x).alias(x) for x in ("n", *names))), "shingle-sets-distinct")
    differing = 64 * words * acos(2 * least / (1 + least)) / pi  # of sets of equal size with just this similarity
    masks = mask_plan(distinct.count(), words, differing)
    groups = near_groups(distinct.select(F.col("s").alias("id"), *names, "n"), masks, most_differing, words, least)
    member = components(alike_links(docs, distinct, groups, width, seed, least))
    labelled = distinct.join(member, F.col("s") == F.col("node"), "left").select("s", "first", F.coalesce("component_id", "s").alias("c"))
    stays = labelled.groupBy(F.col("c").alias("_c")).agg(F.min("first").alias("stays"))
    labelled = stored(labelled.join(stays, F.col("c") == F.col("_c")).select(F.col("s").alias("_s"), "stays"), "shingle-sets-stay")
    return base.join(labelled, F.col("s") == F.col("_s")).where(row != F.col("stays")).select("doc_id", "h")
