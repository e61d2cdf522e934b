"""Queries of the re-indexing operators over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import reindex as R
from cadenza.plans.base import events, orders, registers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registers(QUERIES, ORACLE_SQL)


@query("""
WITH c AS (SELECT event_id - 100 AS p, event_type, value FROM events WHERE event_id BETWEEN 100 AND 599),
     s AS (SELECT p // 5 AS p, event_type, value FROM c WHERE p % 5 = 0),
     r AS (SELECT 50 - event_id AS p, event_type, value FROM events WHERE event_id BETWEEN 1 AND 50),
     a AS (SELECT * FROM s UNION ALL SELECT p + 100, event_type, value FROM r)
SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, max(p) AS last_position FROM a GROUP BY event_type""")
def scan_clip(spark, d):
    c = events(spark, d, "event_type", "value")
    cut = R.step(R.clip(c, 100, 600), 5)
    back = R.clip(c, 50, 0)
    joined = R.playlist([cut, back])
    return joined.df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("position").alias("last_position"))


@query("SELECT event_id - 100 AS position, value FROM events WHERE event_id BETWEEN 100 AND 599")
def clip_forward(spark, d):
    return R.clip(events(spark, d), 100, 600).df


@query("SELECT 500 - event_id AS position, value FROM events WHERE event_id BETWEEN 21 AND 500")
def clip_reverse(spark, d):
    return R.clip(events(spark, d), 500, 20).df


@query("WITH n AS (SELECT count(*) AS L FROM events) SELECT event_id - (L - 300) AS position, value FROM events, n WHERE event_id >= L - 300 AND event_id < L - 99")
def clip_negative_bounds(spark, d):
    return R.clip(events(spark, d), -300, -100).df


@query("SELECT event_id + 25 AS position, value FROM events UNION ALL SELECT x, NULL FROM (SELECT unnest(range(25)) AS x)")
def offset_pad(spark, d):
    return R.offset(events(spark, d), 25).df


@query("WITH n AS (SELECT count(*) AS L FROM events) SELECT event_id // 7 AS position, value FROM events, n WHERE event_id % 7 = 0 AND event_id // 7 < L // 7")
def step_n(spark, d):
    return R.step(events(spark, d), 7).df


@query("WITH n AS (SELECT count(*) AS L FROM events), p AS (SELECT unnest(range(180)) AS p) SELECT p AS position, value FROM p, n JOIN events ON event_id = least(CAST(floor(CAST(p AS DOUBLE) / 179 * L) AS BIGINT), L - 1)")
def extract_n(spark, d):
    return R.extract(events(spark, d), 180).df


@query("WITH w(position, f) AS (VALUES (0, 1), (1, 3), (2, 3), (3, 7), (4, 999), (5, 0)) SELECT position, value FROM w JOIN events ON event_id = f")
def frame_list_gather(spark, d):
    return R.frame_list(events(spark, d), [1, 3, 3, 7, 999, 0]).df


@query("""WITH p AS (SELECT unnest(range((SELECT count(*) FROM events) + 25)) AS p)
SELECT p AS position, value, p >= 40 AND p < 65 AS silent FROM p JOIN events ON event_id = CASE WHEN p < 40 THEN p WHEN p < 65 THEN 40 ELSE p - 25 END""")
def hold_frame(spark, d):
    return R.hold(events(spark, d), 40, 25).df


def _repeated(kind: str, count: int) -> str:
    back = {"repeat": "false", "pingpong": "q % 2 = 1", "pongping": "q % 2 = 0"}[kind]
    return f"""WITH n AS (SELECT count(*) AS L FROM events), q AS (SELECT unnest(range({count})) AS q)
SELECT q * L + CASE WHEN {back} THEN L - 1 - event_id ELSE event_id END AS position, value, {back} AS reversed FROM events, n, q"""


@query(_repeated("repeat", 3))
def repeat_forward(spark, d):
    return R.repeat(events(spark, d), "repeat", 3).df


@query(_repeated("pingpong", 3))
def repeat_pingpong(spark, d):
    return R.repeat(events(spark, d), "pingpong", 3).df


@query(_repeated("pongping", 2))
def repeat_pongping(spark, d):
    return R.repeat(events(spark, d), "pongping", 2).df


@query("WITH n AS (SELECT count(*) AS L FROM events), p AS (SELECT unnest(range((SELECT count(*) * 5 // 2 FROM events))) AS p) SELECT p AS position, value FROM p, n JOIN events ON event_id = p % L")
def loop_mod(spark, d):
    c = events(spark, d)
    return R.loop(c, c.length * 5 // 2).df


@query("""WITH n AS (SELECT count(*) AS L FROM events), p AS (SELECT unnest(range((SELECT count(*) * 5 // 4 FROM events))) AS p),
s AS (SELECT p, L, (p * 4 // 5) - (p * 4 // 5) % 4 AS b, p % 5 AS k FROM p, n),
m AS (SELECT p, least(L - 1, b + CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS s1,
             least(L - 1, b + CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 3 END) AS s2 FROM s)
SELECT p AS position, a.value AS value_top, z.value AS value_bottom FROM m JOIN events a ON a.event_id = s1 JOIN events z ON z.event_id = s2""")
def pulldown_map(spark, d):
    return R.pulldown(events(spark, d), ["value"]).df


@query("""SELECT event_id // 2 AS position, max(CASE WHEN event_id % 2 = 0 THEN value END) AS value_bottom, max(CASE WHEN event_id % 2 = 1 THEN value END) AS value_top
FROM events WHERE event_id < (SELECT count(*) // 2 * 2 FROM events) GROUP BY 1""")
def interlace_pairs(spark, d):
    return R.interlace(events(spark, d, fps=(50, 1)), ["value"]).df


@query("""WITH n AS (SELECT count(*) AS L FROM events), p AS (SELECT unnest(range((SELECT (count(*) * 60000 + 25024) // 25025 FROM events))) AS p)
SELECT p AS position, event_id AS source, value FROM p, n JOIN events ON event_id = (p * 25025) // 60000""")
def frame_rate_up(spark, d):
    return R.frame_rate(events(spark, d), 60000, 1001).df.select("position", "source", "value")


@query("""WITH p AS (SELECT unnest(range((SELECT (count(*) * 24 + 24) // 25 FROM events))) AS p)
SELECT p AS position, event_id AS source, value FROM p JOIN events ON event_id = (p * 25) // 24""")
def frame_rate_down(spark, d):
    return R.frame_rate(events(spark, d), 24, 1).df.select("position", "source", "value")


@query("WITH n AS (SELECT count(*) AS L FROM events), p AS (SELECT unnest(range(400)) AS p) SELECT p AS position, value FROM p, n JOIN events ON event_id = ((7 - 3 * p) % L + L) % L")
def transport_speed(spark, d):
    return R.transport(events(spark, d), 7, -3, 400).df


@query("""WITH a AS (SELECT (n_nationkey * 5) AS f, n_nationkey AS k FROM nation WHERE n_nationkey BETWEEN 3 AND 5)
SELECT (5 - k) * 5 + event_id - f AS position, CAST(5 - k AS INT) AS slot, value FROM a JOIN events ON event_id >= f AND event_id < f + 5""")
def slots_slice(spark, d):
    c = events(spark, d)
    return R.playlist(R.slots([R.clip(c, 5 * k, 5 * k + 5) for k in range(10)], 5, 3)).df.select("position", "slot", "value")


@query("SELECT event_id AS position, value, NULL AS o_totalprice, 0 AS slot FROM events UNION ALL SELECT o_orderkey + (SELECT count(*) FROM events), NULL, o_totalprice, 1 FROM orders")
def playlist_concat(spark, d):
    return R.playlist([events(spark, d), orders(spark, d)]).df.select("position", "value", "o_totalprice", "slot")


@query("""WITH p AS (SELECT unnest(range((SELECT (count(*) * 24 + 24) // 25 FROM events))) AS p), n AS (SELECT count(*) AS L FROM events)
SELECT p AS position, event_id AS source, value FROM p, n JOIN events ON event_id = ((p + 1) * 25 + 23) // 24 - 1""")
def frame_rate_reverse(spark, d):
    return R.frame_rate(events(spark, d), 24, 1, reverse=True).df.select("position", "source", "value")


@query("""WITH n AS (SELECT count(*) AS L FROM events), s AS (SELECT L, L // 10 AS w FROM n), a AS (SELECT CAST(k AS INT) AS k, k * w AS f, w FROM s, (SELECT unnest(range(3, 6)) AS k))
SELECT (5 - k) * w + event_id - f AS position, CAST(5 - k AS INT) AS slot, value FROM a JOIN events ON event_id >= f AND event_id < f + w""")
def slots_whole(spark, d):
    """Tenths of the clip as slots, some of them in reverse order."""
    c = events(spark, d)
    w = c.length // 10
    return R.playlist(R.slots([R.clip(c, k * w, (k + 1) * w) for k in range(10)], 5, 3)).df.select("position", "slot", "value")


@query("WITH n AS (SELECT count(*) AS L FROM events), p AS (SELECT unnest(range((SELECT L FROM n))) AS p) SELECT p AS position, value FROM p, n JOIN events ON event_id = ((7 - 3 * p) % L + L) % L")
def transport_whole(spark, d):
    """As many rows as the clip has, from a cursor that goes back three a row."""
    return R.transport(events(spark, d), 7, -3).df


@query("WITH n AS (SELECT count(*) AS L FROM events), p AS (SELECT unnest(range((SELECT L FROM n))) AS p) SELECT p AS position, value FROM p, n JOIN events ON event_id = least(p * 2 + 3, L - 1)")
def transport_clamped(spark, d):
    """A cursor that stops at the last row."""
    return R.transport(events(spark, d), 3, 2, looping=False).df
