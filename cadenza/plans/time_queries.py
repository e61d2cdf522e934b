"""Queries of timecode, span and cadence functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import span as S
from cadenza.functions import text as X
from cadenza.functions import timecode as T
from cadenza.operators.windows import running_sum
from cadenza.plans.base import events, orders, registers, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registers(QUERIES, ORACLE_SQL)


def _timecode(spark, d, rate, drop, stride):
    c = events(spark, d)
    return c.df.select((F.col("position") * stride).alias("frame")).select("frame", *(v.cast("long").alias(k) for k, v in T.to_timecode(F.col("frame"), rate, drop).items()))


@query("SELECT event_id * 211 AS frame, event_id * 211 % 2160000 // 90000 AS h, event_id * 211 // 1500 % 60 AS m, event_id * 211 // 25 % 60 AS s, event_id * 211 % 25 AS f FROM events")
def timecode_ndf(spark, d):
    return _timecode(spark, d, "pal", False, 211)


_DROP = """WITH a AS (SELECT event_id * 211 AS frame, event_id * 211 % (144 * 17982) AS n FROM events), b AS (SELECT *, n // 17982 AS q, n % 17982 AS x FROM a),
c AS (SELECT frame, n + (9 * q + CASE WHEN x < 2 THEN 0 ELSE (x - 2) // 1798 END) * 2 AS n FROM b)
SELECT frame, n // 108000 AS h, n // 1800 % 60 AS m, n // 30 % 60 AS s, n % 30 AS f FROM c"""


@query(_DROP)
def timecode_df(spark, d):
    return _timecode(spark, d, "ntsc", True, 211)


@query("SELECT event_id * 97 AS frame, event_id * 97 % (144 * 35964) AS again FROM events")
def tc_roundtrip(spark, d):
    df = _timecode(spark, d, "ntsc_60", True, 97)
    return df.select("frame", T.from_timecode(*(F.col(k) for k in "hmsf"), "ntsc_60", True).alias("again"))


@query("SELECT event_id AS frame, event_id * 30000 // 25025 AS ntsc, event_id * 1 AS num, 25 AS den FROM events")
def rate_convert(spark, d):
    s = T.seconds(F.col("position"), (25, 1))
    return events(spark, d).df.select(F.col("position").alias("frame"), T.convert_frames(F.col("position"), (25, 1), (30000, 1001)).alias("ntsc"), s["num"].alias("num"), s["den"].alias("den"))


_SPANS = "s AS (SELECT o_orderkey AS k, o_orderkey % 100 AS a, o_orderkey % 37 + 1 AS ad, o_orderkey % 61 AS b, o_orderkey % 23 + 1 AS bd FROM orders)"


def _spans(spark, d):
    k = F.col("position")
    return orders(spark, d).df.select(k.alias("k"), *((x).alias(n) for n, x in (("a", k % 100), ("ad", k % 37 + 1), ("b", k % 61), ("bd", k % 23 + 1))))


def _pair():
    return (F.col("a"), F.col("ad")), (F.col("b"), F.col("bd"))


@query(f"WITH {_SPANS} SELECT k, greatest(a, b) AS start, least(a + ad, b + bd) - greatest(a, b) AS duration FROM s WHERE least(a + ad, b + bd) > greatest(a, b)")
def span_intersect(spark, d):
    return _spans(spark, d).withColumn("x", S.intersection(*_pair())).where("x is not null").select("k", "x.start", "x.duration")


@query(f"WITH {_SPANS} SELECT k, least(a, b) AS start, greatest(a + ad, b + bd) - least(a, b) AS duration FROM s WHERE greatest(a, b) <= least(a + ad, b + bd)")
def span_union(spark, d):
    return _spans(spark, d).withColumn("x", S.union(*_pair())).where("x is not null").select("k", "x.start", "x.duration")


@query(f"WITH {_SPANS} SELECT k, a AS start, least(a + ad, b) - a AS duration FROM s WHERE least(a + ad, b) > a UNION ALL SELECT k, greatest(a, b + bd), a + ad - greatest(a, b + bd) FROM s WHERE a + ad > greatest(a, b + bd)")
def span_subtract(spark, d):
    return _spans(spark, d).select("k", F.explode(S.subtraction(*_pair())).alias("x")).select("k", "x.start", "x.duration")


@query(f"WITH {_SPANS}, t AS (SELECT *, least(greatest(a, b), b + bd) AS st FROM s) SELECT k, a + ad <= b AS before, a < b + bd AS starts, 50 >= a AND 50 < a + ad AS has50, st AS start, greatest(least(a + ad, b + bd), st) - st AS duration FROM t")
def span_predicates(spark, d):
    a, b = _pair()
    return _spans(spark, d).withColumn("x", S.trim(a, b)).select("k", S.out_before_in(a, b).alias("before"), S.in_before_out(a, b).alias("starts"), S.holds(a, F.lit(50)).alias("has50"), "x.start", "x.duration")


@query("""SELECT event_id AS frame, CASE event_id % 5 WHEN 1 THEN 1601 WHEN 3 THEN 1601 ELSE 1602 END AS mpeg, (event_id % 30000 + 1) * 44144100 // 30000 - event_id % 30000 * 44144100 // 30000 AS plain,
event_id // 30000 * 44144100 + event_id % 30000 * 44144100 // 30000 AS start FROM events""")
def samples_cadence(spark, d):
    p, ntsc = F.col("position"), (30000, 1001)
    return events(spark, d).df.select(p.alias("frame"), T.samples_for_frame(p, 48000, ntsc, "mpeg").alias("mpeg"), T.samples_for_frame(p, 44100, ntsc).alias("plain"), T.samples_to_frame(p, 44100, ntsc).alias("start"))


@query("SELECT event_id // 5 AS run, CAST(sum(CASE event_id % 5 WHEN 0 THEN 1600 ELSE 1602 END) AS BIGINT) AS samples FROM events GROUP BY 1")
def silence_sum(spark, d):
    """Any five NTSC frames of silence that begin a cycle have 8008 samples."""
    p = F.col("position")
    return events(spark, d).df.groupBy(F.expr("position div 5").alias("run")).agg(F.sum(T.samples_for_frame(p, 48000, (30000, 1001), "dv")).alias("samples"))


@query("SELECT o_orderkey AS k, base64(encode(o_orderpriority)) AS b64, o_orderpriority AS back, split_part(o_orderpriority, '-', 1) AS head FROM orders")
def text_helpers(spark, d):
    o = table(spark, d, "orders")
    b64 = X.to_base64(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("k"), b64.alias("b64"), X.from_base64(b64).alias("back"), F.split("o_orderpriority", "-")[0].alias("head"))


@query("SELECT o_orderkey AS k, (o_orderkey * 12 - 60000) // gcd(abs(o_orderkey * 12 - 60000), o_orderkey % 90 + 6) AS num, (o_orderkey % 90 + 6) // gcd(abs(o_orderkey * 12 - 60000), o_orderkey % 90 + 6) AS den, gcd(o_orderkey * 30, o_orderkey % 84) AS divisor FROM orders WHERE o_orderkey > 0")
def time_reduced(spark, d):
    """Exact times in lowest terms, negative ones too, and common divisors."""
    k = F.col("position")
    num, den = T.reduced(k * 12 - 60000, k % 90 + 6)
    return orders(spark, d).df.where("position > 0").select(k.alias("k"), num.alias("num"), den.alias("den"), T.common_divisor(k * 30, k % 84).alias("divisor"))


@query("SELECT o_orderkey AS k, o_orderkey * 1001 * 25 < (o_orderkey + 3) * 30000 AS earlier, o_orderkey * 1001 * 25 > (o_orderkey + 3) * 30000 AS later FROM orders")
def time_order(spark, d):
    """Frames of two rates by the time at which they begin."""
    k = F.col("position")
    a, b = ((s["num"], s["den"]) for s in (T.seconds(k, (30000, 1001)), T.seconds(k + 3, (25, 1))))
    return orders(spark, d).df.select(k.alias("k"), T.time_less(a, b).alias("earlier"), T.time_less(b, a).alias("later"))


@query("""WITH s AS (SELECT event_id AS k, event_id * 397 AS sample FROM events), f AS (SELECT unnest(range((SELECT max(sample) // 1471 + 2 FROM s))) AS frame)
SELECT k, sample, max(frame) AS frame FROM s JOIN f ON frame BETWEEN sample // 1471 - sample // 1000000 - 2 AND sample // 1471 + 2 WHERE frame // 30000 * 44144100 + frame % 30000 * 44144100 // 30000 <= sample GROUP BY 1, 2""")
def sample_frames(spark, d):
    """The frame in which every 397th sample lies."""
    sample = F.col("position") * 397
    return events(spark, d).df.select(F.col("position").alias("k"), sample.alias("sample"), T.frame_of_sample(sample, 44100, (30000, 1001)).alias("frame"))


@query("SELECT event_id AS position, CAST(sum(event_id % 13) OVER (ORDER BY event_id) AS BIGINT) AS total, CAST(coalesce(sum(event_id % 13) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM events")
def running_totals(spark, d):
    rows = events(spark, d).df.select("position", (F.col("position") % 13).alias("x"))
    return running_sum(running_sum(rows, "x", "total", bucket=1024), "x", "before", True, bucket=1024).select("position", "total", "before")


@query("""SELECT o_orderkey AS k, CAST(string_split(t, ':')[1] AS INT) AS first, CAST(string_split(t, ':')[3] AS INT) AS third, TRY_CAST(string_split(t, ':')[4] AS INT) AS fourth, string_split(t, ':')[2] AS second, CAST(len(string_split(t, ':')) AS INT) AS n, contains(t, 'true') AS flag
FROM (SELECT o_orderkey, concat(o_orderkey, ':', CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE '' END, ':', o_orderkey % 7, ':x') AS t FROM orders)""")
def text_lists(spark, d):
    """Typed lists in a text: what isn't of the type is null."""
    k = F.col("position")
    t = F.concat_ws(":", k.cast("string"), F.when(k % 3 == 0, "true").otherwise(""), (k % 7).cast("string"), F.lit("x"))
    words, numbers = X.parse_list(t), X.parse_list(t, "int")
    return orders(spark, d).df.select(k.alias("k"), numbers[0].alias("first"), numbers[2].alias("third"), numbers[3].alias("fourth"), words[1].alias("second"), F.size(words).alias("n"), X.parse_bool(t).alias("flag"))


@query("""WITH c AS (SELECT event_id AS k, event_id % 256 AS r, event_id * 7 % 256 AS g, event_id * 31 % 256 AS b FROM events)
SELECT k, CAST(floor(16 + (65.738::DOUBLE * r + 129.057::DOUBLE * g + 25.064::DOUBLE * b) / 256) AS INT) AS y,
CAST(floor(128 + (-37.945::DOUBLE * r - 74.494::DOUBLE * g + 112.439::DOUBLE * b) / 256) AS INT) AS u, CAST(floor(128 + (112.439::DOUBLE * r - 94.154::DOUBLE * g - 18.285::DOUBLE * b) / 256) AS INT) AS v FROM c""")
def colour_yuv(spark, d):
    k = F.col("position")
    out = X.to_yuv(k % 256, k * 7 % 256, k * 31 % 256)
    return events(spark, d).df.select(k.alias("k"), *(out[n].alias(n) for n in "yuv"))


@query("""WITH c AS (SELECT event_id AS k, event_id % 256 AS r, event_id * 7 % 256 AS g, event_id * 31 % 256 AS b, event_id % 101 AS a FROM events)
SELECT k, CAST(b AS INT) AS b0, CAST(r AS INT) AS r2, CAST(a * 65535 // 255 AS INT) AS a0, CAST(g * 65535 // 255 AS INT) AS g2, CAST(3 AS INT) AS n FROM c""")
def colour_arranged(spark, d):
    """Pixels in the order and depth of two formats."""
    k = F.col("position")
    rgba = (k % 256, k * 7 % 256, k * 31 % 256, k % 101)
    small, deep = X.arrange_rgb("b8g8r8", *rgba), X.arrange_rgb("a16r16g16b16", *rgba)
    return events(spark, d).df.select(k.alias("k"), small[0].alias("b0"), small[2].alias("r2"), deep[0].alias("a0"), deep[2].alias("g2"), F.size(small).alias("n"))
