"""Overlays as stretches: one row for each stretch in which the same overlays are active, not one a frame.

In and out points of overlays are a sequence of change points; between two of them nothing changes. Which overlays are active in a stretch is a
question of a point in intervals, answered by an equi-join: every interval is cut into its dyadic nodes (at most two of each power of two), and every stretch asks for the node of
each power that holds its start. Nodes of an interval don't overlap, so the join makes each active pair once and no other row, whatever the lengths are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.windows import last_seen, previous, running_sum


def change_points(overlays: DataFrame) -> DataFrame:
    """position: where overlays (start, duration) begin or end, once each. Overlays without a duration have none."""
    own = overlays.where("duration > 0").select(F.explode(F.array(F.col("start").cast("long"), (F.col("start") + F.col("duration")).cast("long"))).alias("position"))
    return own.distinct()


def stretches(points: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """start and end of the stretches between neighbouring points (column position)."""
    return previous(points, "start", bucket).where("start is not null").select("start", F.col("position").alias("end"))


def dyadic(start: Column, end: Column, powers: int) -> Column:
    """[start, end) as an array of (power, node): the node k of a power p stands for [k 2^p, (k + 1) 2^p). Starts may be negative."""

    def of(p: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), p)
        first, last = F.call_function("shiftright", start + size - 1, p), F.call_function("shiftright", end, p)
        node = lambda keep, k: F.when(keep & (first < last), F.struct(p.alias("power"), k.alias("node")))
        return F.array(node(first % 2 != 0, first), node(last % 2 != 0, last - 1))

    nodes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(powers)), of))
    return F.filter(nodes, lambda n: n.isNotNull())


def active_in(stretch: DataFrame, overlays: DataFrame) -> DataFrame:
    """Each stretch (start, end) with the columns of each overlay (slot, z, start, duration, ...) that is active in it: pairs, from which anything can be aggregated.

    The overlay's own start and duration are begin and duration.
    """
    spans = overlays.where("duration > 0")
    longest = spans.agg(F.max("duration")).first()[0]
    if longest is None:
        return stretch.join(spans.withColumnRenamed("start", "begin"), F.lit(False))
    powers = int(longest).bit_length()
    begin = F.col("begin").cast("long")
    cut = spans.withColumnRenamed("start", "begin").withColumn("_n", F.explode(dyadic(begin, begin + F.col("duration"), powers)))
    asked = F.transform(F.sequence(F.lit(0), F.lit(powers)), lambda p: F.struct(p.alias("power"), F.call_function("shiftright", F.col("start"), p).alias("node")))
    probes = stretch.withColumn("_a", F.explode(asked))
    same = (F.col("_a.power") == F.col("_n.power")) & (F.col("_a.node") == F.col("_n.node"))
    return probes.join(cut, same).drop("_a", "_n")


def composed(overlays: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """start, end, n and layers of each stretch from the first in-point to the last out-point: the active overlays by z (missing: 0), ties by slot; none in a gap.

    A stretch's layers are one row, so use active_in where very many overlays are active at once.
    """
    all_ = stretches(change_points(overlays))
    layer = F.struct(F.coalesce("z", F.lit(0)).alias("z"), "slot", *(fields or []))
    held = active_in(all_, overlays).groupBy("start", "end").agg(F.sort_array(F.collect_list(layer)).alias("layers"))
    empty = all_.join(held.select("start"), "start", "left_anti").select("start", "end", F.lit(0).cast("long").alias("n"))
    return held.select("start", "end", F.size("layers").cast("long").alias("n"), "layers").unionByName(empty, allowMissingColumns=True).withColumn("layers", F.coalesce("layers", F.array().cast(held.schema["layers"].dataType)))


def depth(overlays: DataFrame) -> DataFrame:
    """start, end and n: how many overlays are active in each stretch, by a running sum of in and out points; no pair is made."""
    spans = overlays.where("duration > 0")
    moves = spans.select(F.explode(F.array(F.struct(F.col("start").cast("long").alias("position"), F.lit(1).cast("long").alias("by")), F.struct((F.col("start") + F.col("duration")).cast("long").alias("position"), F.lit(-1).cast("long").alias("by")))).alias("m"))
    points = moves.groupBy("m.position").agg(F.sum("m.by").alias("by"))
    counted = running_sum(points, "by", "after")
    ended = previous(counted.select("position", "after"), "n", carry="after")
    return ended.where("start is not null").select("start", F.col("position").alias("end"), "n")


def frames_of(rows: DataFrame) -> DataFrame:
    """The rows of stretches, one a position again."""
    return rows.withColumn("position", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))


def events_in(df: DataFrame, points: DataFrame) -> DataFrame:
    """df, a clip's rows, with event: how many in-points (a table: position) have begun at the row's position; event_start: the latest one (null before the first).

    Points may be any number, and repeat; those where the clip has no row count at the next one it has.
    """
    marks = points.select("position").distinct().select("position", F.col("position").alias("_mark"), F.lit(1).alias("_one"))
    rows = df.withColumn("_own", F.lit(True))
    both = rows.join(marks, "position", "full")
    counted = running_sum(both.withColumn("_one", F.coalesce("_one", F.lit(0))), "_one", "event")
    return last_seen(counted, "_mark", "event_start").where("_own").select(*df.columns, F.col("event").cast("int").alias("event"), "event_start")
