"""Sharding: a minimax contiguous partition of atomic document groups, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import stored

LOWEST = -(1 << 63)
CELLS = 4096


def greedy(sizes: list[int], capacity: int) -> list[int]:
    """Where shards start when each takes as many whole groups, in order, as fit (a larger one alone)."""
    starts, room = [], 0
    for i, size in enumerate(sizes):
        if not starts or size > room:
            starts.append(i)
            room = capacity
        room -= size
    return starts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which the greedy pass needs at most so many shards."""
    low, high = max([*sizes, -(-sum(sizes) // shards)]), max(sum(sizes), 1)
    low = min(low, high)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(greedy(sizes, mid)) <= shards else (mid + 1, high)
    return low


def _poured(segments: list[tuple], capacity: int, most: int) -> list[int]:
    """The segment in which each shard ends if segments of several groups could be cut anywhere."""
    ends, i, into = [], 0, 0
    while i < len(segments) and len(ends) <= most:
        room = capacity
        while i < len(segments):
            lo, hi, size, _ = segments[i]
            left = size - into
            if left <= room:
                room, i, into = room - left, i + 1, 0
            elif lo == hi:  # one group: whole or not at all
                break
            else:
                into += room
                break
        ends.append(min(i, len(segments) - 1))
        if i < len(segments) and room == capacity and segments[i][0] == segments[i][1]:
            return [*ends, *[len(segments)] * (most + 1)]  # never fits
    return ends


def _bounds(segments: list[tuple], shards: int) -> tuple[int, int, set[int]]:
    """The least capacity's lower and upper bound, and the segments in which a cut may lie."""
    sizes = [s[2] for s in segments]
    upper = smallest_capacity(sizes, shards)
    low, high = max([1, -(-sum(sizes) // shards), *(s[2] for s in segments if s[0] == s[1])]), upper
    low = min(low, high)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(_poured(segments, mid, shards)) <= shards else (mid + 1, high)
    open_ = set()
    if low < upper:
        # A shard never ends before it would with whole segments and the lower bound,
        # nor after it would with divisible segments and the upper bound.
        first, at = [], 0
        for _ in range(shards):
            room = low
            while at < len(sizes) and sizes[at] <= room:
                room -= sizes[at]
                at += 1
            first.append(min(at, len(sizes) - 1))
        last = _poured(segments, upper, shards)
        last += [len(sizes) - 1] * (shards - len(last))
        for a, b in zip(first, last, strict=False):
            open_.update(i for i in range(a, b + 1) if segments[i][0] < segments[i][1])
    return low, upper, open_


def _cells(groups: DataFrame, runs: list[list[tuple]]) -> list[tuple]:
    """The segments of the groups in equal cells of each run of segments: least and greatest key, size, cell width.

    A run gets its share of CELLS; its cells are at most half as wide as those before, so that every
    round makes progress. Empty cells cost nothing.
    """
    each = max(2, CELLS // len(runs))
    key, cell, where, first = F.col("key"), None, None, 0
    widths = []
    for run in runs:
        lo, hi = run[0][0], run[-1][1]
        width = max(1, min(-(-(hi - lo + 1) // each), min(s[3] for s in run) // 2))
        step = F.expr(f"cast((cast(key as decimal(20,0)) - {lo}) div {width} as bigint)") if hi - lo >= 1 << 62 else F.expr(f"(key - ({lo}L)) div {width}L")
        inside = key.between(lo, hi)
        cell = F.when(inside, step + first) if cell is None else cell.when(inside, step + first)
        where = inside if where is None else where | inside
        first += (hi - lo) // width + 1
        widths.append((first, width))
    found = groups.where(where).groupBy(cell.alias("cell")).agg(F.min("key"), F.max("key"), F.sum("size")).collect()
    return sorted((r[1], r[2], int(r[3]), next(w for end, w in widths if r[0] < end)) for r in found)


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """The first key of each shard in the minimax contiguous partition of groups (key, size) by key.

    The greedy check and the binary search run on the driver over at most some thousand segments of the
    key order, each with its total size. Bounds of the best capacity tell in which segments a cut may
    lie; only those are split further, by one aggregation each round, until the result is exact.
    """
    lo, hi, size = groups.agg(F.min("key"), F.max("key"), F.sum("size")).first()
    if lo is None:
        return []
    segments = [(lo, hi, int(size), hi - lo + 1)]
    while True:
        _, upper, open_ = _bounds(segments, shards)
        if not open_:
            break
        runs: list[list[int]] = []
        for i in sorted(open_):
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        finer = _cells(groups, [segments[a : b + 1] for a, b in runs])
        segments = sorted([s for i, s in enumerate(segments) if not any(a <= i <= b for a, b in runs)] + finer)
    return [segments[i][0] for i in greedy([s[2] for s in segments], upper)]


def _place(key: Column, cuts: list[int], first: int) -> Column:
    """first plus the number of cuts after the first that are at or before the key."""
    out = F.lit(first)
    for c in cuts[1:]:
        out = out + (key >= F.lit(c)).cast("int")
    return out


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 20_000) -> DataFrame:
    """Put every document into one of so many shards of nearly equal bytes; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, shard and slot (gapless from 0 in a shard) per row.

    Groups of equal texts are ordered by their smallest id. A group above an equal share gets a shard of
    its own (the share is then taken anew without it); the others are cut, in order, into the remaining
    shards so that the largest is as small as can be. Slots follow a hash of the id, counted in blocks of
    about block_rows rows, so that no task numbers a whole shard.

    Null texts are one group of size 8 (CRC of the empty text), apart from empty texts. Null ids come
    first in the order. Repeated rows each keep a row. An empty table gives no rows. Fewer groups than
    shards leave shards empty. Other columns of docs are ignored.
    """
    text = F.col(text_col)
    base = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("digest"),
        ),
        "shard-base",
    )
    groups = stored(base.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(LOWEST)).cast("long").alias("key"), F.sum("size").alias("size"), F.count("*").alias("copies")), "shard-groups")
    rows, total = groups.agg(F.sum("copies"), F.sum("size")).first()
    own: list[bytes] = []
    left = total or 0
    for g in groups.orderBy(F.desc("size"), "key", "digest").limit(shards - 1).collect():
        if g["size"] * (shards - len(own)) <= left:
            break
        own.append(bytes(g["digest"]))
        left -= g["size"]
    rest = groups.where(~F.col("digest").isin(own)) if own else groups
    shard = _place(F.col("key"), cut_keys(rest.select("key", "size"), shards - len(own)), len(own))
    for i, d in enumerate(own):
        shard = F.when(F.col("digest") == F.lit(d), F.lit(i)).otherwise(shard)
    blocks = max(1, -(-(rows or 0) // (shards * block_rows)))
    placed = stored(
        base.join(groups.select("digest", shard.cast("int").alias("shard")), "digest").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).alias("block")),
        "shard-placed",
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")))
    return numbered.join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
