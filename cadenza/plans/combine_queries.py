"""Queries of the operators that combine clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import combine as C
from cadenza.operators import reindex as R
from cadenza.operators import segments as S
from cadenza.plans.base import events, orders, registers, scratch, table
from cadenza.sources.datasource import read_frames, write_frames
from cadenza.sources.sinks import index_of, index_rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registers(QUERIES, ORACLE_SQL)
_N = "WITH n AS (SELECT (SELECT count(*) FROM events) AS a, (SELECT count(*) FROM orders) AS b)"
_WINDOWS = "w AS (SELECT n_nationkey AS slot, n_regionkey AS z, CAST(n_nationkey * 100 AS BIGINT) AS f, CAST(250 AS BIGINT) AS dur FROM nation)"


@query(f"{_N}, p AS (SELECT unnest(range((SELECT greatest(a, b) FROM n))) AS p) SELECT p AS position, value, o_totalprice FROM p, n JOIN events ON event_id = least(p, a - 1) JOIN orders ON o_orderkey = least(p, b - 1)")
def muxer_longest(spark, d):
    return C.muxer(events(spark, d), orders(spark, d)).df.select("position", "value", "o_totalprice")


@query("SELECT event_id AS position, value, o_totalprice FROM events JOIN orders ON event_id = o_orderkey")
def muxer_shortest(spark, d):
    return C.muxer(events(spark, d), orders(spark, d), use_longest=False).df.select("position", "value", "o_totalprice")


@query("SELECT event_id + 5 AS position, value FROM events UNION ALL SELECT x, 0.0 FROM (SELECT unnest(range(5)) AS x)")
def conform_fill(spark, d):
    return C.conform(R.offset(events(spark, d), 5).df, {"value": 0.0})


def _overlays(spark, d):
    key = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(key.alias("slot"), F.col("n_regionkey").alias("z"), (key * 100).alias("start"), F.lit(250).cast("long").alias("duration"), (F.col("n_regionkey") == 3).alias("opaque"))


@query(f"WITH {_WINDOWS} SELECT event_id AS position, count(*) AS n, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY z, slot) AS layers FROM events JOIN w ON event_id >= f AND event_id < f + dur GROUP BY 1")
def compositor_active(spark, d):
    layered = C.composite_order(C.active(events(spark, d).df, _overlays(spark, d)), [])
    return layered.select("position", F.size("layers").cast("long").alias("n"), F.array_join(F.transform("layers", lambda x: x["slot"].cast("string")), ",").alias("layers"))


@query(f"""WITH {_WINDOWS}, j AS (SELECT event_id AS p, z, slot, CASE WHEN z = 3 THEN z * 1000 + slot END AS o FROM events JOIN w ON event_id >= f AND event_id < f + dur),
t AS (SELECT *, max(o) OVER (PARTITION BY p) AS top FROM j)
SELECT p AS position, CAST(slot AS BIGINT) AS slot FROM t WHERE top IS NULL OR z * 1000 + slot >= top""")
def compositor_occlusion(spark, d):
    return C.visible(C.active(events(spark, d).df, _overlays(spark, d)), F.col("opaque")).select("position", "slot")


def _spread(spark, d):
    """An overlay per order, over the whole clip."""
    k = F.col("position")
    return orders(spark, d).df.select(k.alias("slot"), (k % 7).alias("z"), k.alias("start"), (k % 11).alias("duration"), (k % 7 == 3).alias("opaque"))


_SPREAD = "w AS (SELECT o_orderkey AS slot, o_orderkey % 7 AS z, o_orderkey AS f, o_orderkey % 11 AS dur FROM orders)"


@query(f"WITH {_SPREAD} SELECT event_id AS position, count(*) AS n, CAST(sum(slot) AS BIGINT) AS slots, max(z) AS top FROM events JOIN w ON f BETWEEN event_id - 10 AND event_id AND event_id < f + dur GROUP BY 1")
def compositor_spread(spark, d):
    return C.active(events(spark, d).df, _spread(spark, d)).groupBy("position").agg(F.count("*").alias("n"), F.sum("slot").alias("slots"), F.max("z").alias("top"))


@query(f"""WITH {_SPREAD}, j AS (SELECT event_id AS p, z, slot, CASE WHEN z = 3 THEN (z, slot) END AS o FROM events JOIN w ON f BETWEEN event_id - 10 AND event_id AND event_id < f + dur),
t AS (SELECT *, max(o) OVER (PARTITION BY p) AS top FROM j)
SELECT p AS position, slot FROM t WHERE top IS NULL OR (z, slot) >= top""")
def occlusion_spread(spark, d):
    return C.visible(C.active(events(spark, d).df, _spread(spark, d)), F.col("opaque")).select("position", "slot")


_POINTS = "p AS (SELECT DISTINCT unnest([f, f + dur]) AS p FROM w WHERE dur > 0), s AS (SELECT p AS \"start\", lead(p) OVER (ORDER BY p) AS \"end\" FROM p)"


@query(f"WITH {_SPREAD}, {_POINTS} SELECT \"start\", \"end\", count(slot) AS n, coalesce(string_agg(slot, ',' ORDER BY z, slot), '') AS slots FROM s LEFT JOIN w ON f BETWEEN \"start\" - 10 AND \"start\" AND \"start\" < f + dur WHERE \"end\" IS NOT NULL GROUP BY 1, 2")
def compositor_segments(spark, d):
    """A row for each stretch of the clip in which the same overlays are active, in their order."""
    slots = F.array_join(F.transform("layers", lambda x: x["slot"].cast("string")), ",")
    return S.composed(_spread(spark, d)).select("start", "end", "n", slots.alias("slots"))


_MIXED = "w AS (SELECT o_orderkey AS slot, o_orderkey % 7 AS z, o_orderkey AS f, 1 << (o_orderkey % 8) AS dur FROM orders)"


def _mixed(spark, d):
    """An overlay per order, of 1 to 128 positions."""
    k = F.col("position")
    return orders(spark, d).df.select(k.alias("slot"), (k % 7).alias("z"), k.alias("start"), F.expr("shiftleft(1L, cast(position % 8 as int))").alias("duration"))


@query(f"WITH {_MIXED}, {_POINTS} SELECT \"start\", \"end\", count(*) AS n, max(z) AS top, CAST(sum(slot) AS BIGINT) AS slots FROM s JOIN w ON f BETWEEN \"start\" - 128 AND \"start\" AND \"start\" < f + dur WHERE \"end\" IS NOT NULL GROUP BY 1, 2")
def segment_pairs(spark, d):
    """What is active in each stretch, aggregated from pairs."""
    overlays = _mixed(spark, d)
    pairs = S.active_in(S.stretches(S.change_points(overlays)), overlays)
    return pairs.groupBy("start", "end").agg(F.count("*").alias("n"), F.max("z").alias("top"), F.sum("slot").alias("slots"))


@query(f"WITH {_MIXED}, {_POINTS} SELECT \"start\", \"end\", count(slot) AS n FROM s LEFT JOIN w ON f BETWEEN \"start\" - 128 AND \"start\" AND \"start\" < f + dur WHERE \"end\" IS NOT NULL GROUP BY 1, 2")
def segment_depth(spark, d):
    """How many overlays are active in each stretch."""
    return S.depth(_mixed(spark, d))


@query("WITH p AS (SELECT DISTINCT o_orderkey AS p FROM orders WHERE o_orderpriority = '1-URGENT') SELECT event_id AS position, CAST(count(p) AS INTEGER) AS event, max(p) AS event_start FROM events LEFT JOIN p ON p <= event_id GROUP BY 1")
def event_table(spark, d):
    """Which in-point, of a table of them, began last at each position, and how many have."""
    urgent = orders(spark, d, "o_orderpriority").df.where("o_orderpriority = '1-URGENT'")
    return S.events_in(events(spark, d).df.select("position"), urgent).select("position", "event", "event_start")


def _index(spark, d):
    c = events(spark, d, "event_type", "value")
    return index_of(c.df, F.col("event_type") == "purchase", F.ceil("value"))


_KEYS = "k AS (SELECT event_id, ceil(value) AS size, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (ORDER BY event_id) AS frame FROM events), g AS (SELECT frame, count(*) AS frames, CAST(sum(size) AS BIGINT) AS length FROM k WHERE frame IS NOT NULL GROUP BY 1), i AS (SELECT frame, frames, CAST(coalesce(sum(length) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", length FROM g)"


@query(f"WITH {_KEYS} SELECT frame, frames, \"offset\", length FROM i")
def awi_index(spark, d):
    return _index(spark, d)


@query("WITH k AS (SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (ORDER BY event_id) AS f, (SELECT min(event_id) FROM events WHERE event_type = 'purchase') AS g FROM events) SELECT event_id AS position, coalesce(f, g, -1) AS key_frame FROM k")
def awi_asof(spark, d):
    c = events(spark, d, "event_type")
    return C.key_frame_of(c.df.select("position"), c.df.where("event_type = 'purchase'").select(F.col("position").alias("frame")))


@query(f"WITH {_KEYS}, s(size) AS (VALUES (0), (500), (20000), (100000000)) SELECT CAST(size AS BIGINT) AS size, CAST(coalesce((SELECT max(frame + frames) FROM i WHERE \"offset\" + length <= size), 0) AS BIGINT) AS frames FROM s")
def awi_available(spark, d):
    return C.available_at(_index(spark, d), [0, 500, 20000, 100000000])


@query("""SELECT e.event_id AS position, round(sum(s.value), 6) AS total, count(*) AS n FROM events e JOIN events s ON s.event_id % 3 = 0 AND s.event_id >= e.event_id // 3 * 3 - 6 AND s.event_id < e.event_id // 3 * 3 + 9 GROUP BY 1""")
def montage_sliding(spark, d):
    out = C.montage_window(events(spark, d), "value", 4, 3)
    return out.df.select("position", F.round(F.aggregate("window", F.lit(0.0), lambda s, x: s + x["value"]), 6).alias("total"), F.size("window").cast("long").alias("n"))


@query("""WITH n AS (SELECT CAST(ceil(sqrt((count(*) + 9) // 10)) AS BIGINT) AS c FROM events)
SELECT event_id // 10 AS cell, (event_id // 10) % c AS col, (event_id // 10) // c AS "row", value FROM events, n WHERE event_id % 10 = 0""")
def montage_grid(spark, d):
    out = C.montage_sheet(events(spark, d), "value", 10)
    return out.select("cell", F.col("col").cast("long").alias("col"), "row", "value")


@query("SELECT event_id AS position, value * 2 AS value, upper(event_type) AS event_type FROM events")
def voodoo_split(spark, d):
    c = events(spark, d, "value", "event_type")
    out = C.voodoo(c, lambda v: v.with_df(v.df.withColumn("value", F.col("value") * 2)), lambda a: a.with_df(a.df.withColumn("event_type", F.upper("event_type"))), ["value"], ["event_type"])
    return out.df.select("position", "value", "event_type")


@query(f"WITH {_KEYS} SELECT CAST(v AS INT) AS version, true AS closed, frame, frames, \"offset\", length FROM i, (VALUES (2), (3), (4)) AS t(v)")
def awi_files(spark, d):
    """The index as binary files of each version, some thousand positions a file, and read again."""
    index = _index(spark, d).withColumn("file", F.concat(F.expr("frame div 4096"), F.lit(".awi")))
    out = None
    for version in (2, 3, 4):
        folder = scratch(spark, f"index-{version}")
        rows, foot = index_rows(index, "file", version)
        write_frames(rows, folder, foot)
        items = read_frames(spark, folder, "awi").select("version", "closed", "frame", "frames", "offset", "length")
        out = items if out is None else out.unionAll(items)
    return out


@query("SELECT event_id AS position, CAST((event_id >= 10) + (event_id >= 500) + (event_id >= 5000) AS INT) AS event, CASE WHEN event_id >= 5000 THEN 5000 WHEN event_id >= 500 THEN 500 WHEN event_id >= 10 THEN 10 END AS event_start FROM events".replace("(event_id >= 10) + (event_id >= 500) + (event_id >= 5000)", " + ".join(f"CAST(event_id >= {k} AS INT)" for k in (10, 500, 5000))))
def compositor_events(spark, d):
    return C.events_at(events(spark, d).df, [500, 10, 5000, 10]).select("position", "event", "event_start")


@query("SELECT event_id AS position, value, sink FROM events, (VALUES (0), (1)) AS s(sink)")
def tee_rows(spark, d):
    path = scratch(spark, "tee")
    sinks = [lambda df, k=k: df.write.parquet(f"{path}/sinks/sink={k}") for k in (0, 1)]
    C.tee(events(spark, d).df, f"{path}/rows", *sinks)
    return spark.read.parquet(f"{path}/sinks").select("position", "value", F.col("sink").cast("int").alias("sink"))


@query("SELECT event_id AS position, value * 2 AS v FROM events UNION ALL SELECT event_id, -value FROM events WHERE event_id % 2 = 0")
def fork_branches(spark, d):
    a, b = C.fork(events(spark, d).df, scratch(spark, "fork"), lambda df: df.select("position", (F.col("value") * 2).alias("v")), lambda df: df.where("position % 2 = 0").select("position", (-F.col("value")).alias("v")))
    return a.unionAll(b)


@query("SELECT event_id AS position, value * 2 AS value, upper(event_type) AS event_type FROM events")
def voodoo_columns(spark, d):
    """voodoo_split for operators that keep positions: no join."""
    c = events(spark, d, "value", "event_type")
    return C.of_columns(c, lambda df: df.withColumn("value", F.col("value") * 2), lambda df: df.withColumn("event_type", F.upper("event_type"))).df


@query("""WITH k AS (SELECT event_id, value, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (ORDER BY event_id) AS key FROM events)
SELECT key, count(*) AS frames, round(sum(value), 6) AS total FROM k WHERE key IS NOT NULL GROUP BY 1""")
def gop_sessions(spark, d):
    from cadenza.operators.windows import last_seen

    c = events(spark, d, "event_type", "value")
    marked = last_seen(c.df.withColumn("_k", F.when(F.col("event_type") == "purchase", F.col("position"))), "_k", "key")
    return marked.where("key is not null").groupBy("key").agg(F.count("*").alias("frames"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT a.event_id AS position, a.value AS value, b.value AS previous FROM events a LEFT JOIN events b ON b.event_id = a.event_id - 1")
def field_order(spark, d):
    from cadenza.operators.windows import lagged

    return lagged(events(spark, d).df, "value", "previous", 1).select("position", "value", "previous")
