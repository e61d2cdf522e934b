"""Queries of property, geometry, audio and image operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import words as W
from cadenza.operators import audio as A
from cadenza.operators import image as I
from cadenza.operators import payload as P
from cadenza.plans.base import events, plane_sums, registers, stereo, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registers(QUERIES, ORACLE_SQL)
_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)"


def _sums(c, column="audio"):
    """Position, number of samples, and two rounded sums that tell order apart."""
    x = F.col(column)
    return c.select("position", F.size(x).alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 6).alias("weighted"))


def _sums_sql(ctes: str, source: str) -> str:
    return f"WITH {ctes} SELECT vec_id AS position, CAST(len(x) AS INT) AS n, round(list_sum(x), 6) AS total, round(list_sum([v * i FOR v, i IN x]), 6) AS weighted FROM {source}"


@query("""WITH n AS (SELECT count(*) AS L FROM events) SELECT event_id AS position, CASE WHEN event_id BETWEEN 100 AND L - 1 - 50 THEN round(1.5 + (event_id - 100) / CAST(L - 51 - 100 AS DOUBLE) * (9.0 - 1.5), 9) END AS v FROM events, n""")
def lerp_segment(spark, d):
    c = events(spark, d)
    return c.df.select("position", F.round(P.lerp(F.col("position"), c.length, "1.5:9:100:-51"), 9).alias("v"))


@query("""SELECT event_id AS position, CASE WHEN event_id BETWEEN 50 AND 149 THEN round(10 + (event_id - 50) / 99.0::DOUBLE * 10, 9) WHEN event_id BETWEEN 0 AND 99 THEN round(event_id / 99.0::DOUBLE * 5, 9) END AS v FROM events""")
def lerp_overlapping(spark, d):
    c = events(spark, d)
    return c.df.select("position", F.round(P.lerp_segments(F.col("position"), c.length, {"v:0": "0:5:0:99", "v:1": "10:20:50:149"}), 9).alias("v"))


@query("""WITH t AS (SELECT event_id AS p, event_id / CAST((SELECT count(*) FROM events) - 1 AS DOUBLE) AS t FROM events)
SELECT p AS position, round(3*(1-t)*t*t*1.0 + t*t*t + 3*(1-t)*(1-t)*t*0.25, 9) AS x, round(3*(1-t)*(1-t)*t*1.0 + t*t*t, 9) AS y FROM t""")
def bezier_xy(spark, d):
    c = events(spark, d)
    x, y = P.bezier(F.col("position"), c.length, [(0, 0), (0.25, 1), (1, 0), (1, 1)])
    return c.df.select("position", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


_SIZED = "s AS (SELECT p_partkey AS k, CAST(p_size * 16 AS BIGINT) AS sw, CAST(p_partkey % 50 * 9 + 9 AS BIGINT) AS sh FROM part), g AS (SELECT *, CAST(floor(640 * sh / CAST(sw AS DOUBLE)) AS BIGINT) AS lh, CAST(floor(360 * sw / CAST(sh AS DOUBLE)) AS BIGINT) AS pw FROM s)"


def _geometry(spark, d, mode, **options):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 16).cast("long").alias("sw"), (F.col("p_partkey") % 50 * 9 + 9).cast("long").alias("sh"))
    g = P.geometry(mode, (F.col("sw"), F.col("sh")), (640, 360), **options)
    return parts.select("k", g["w"].alias("w"), g["h"].alias("h"), g["x"].alias("x"), g["y"].alias("y"), g["cw"].alias("cw"), g["ch"].alias("ch"))


def _geometry_sql(w: str, h: str) -> str:
    return f"""WITH {_SIZED}, f AS (SELECT *, CAST({w} AS BIGINT) AS fw, CAST({h} AS BIGINT) AS fh FROM g)
SELECT k, least(fw, 640) AS w, least(fh, 360) AS h, CASE WHEN fw > 640 THEN 0 ELSE (640 - fw) // 2 END AS x, CASE WHEN fh > 360 THEN 0 ELSE (360 - fh) // 2 END AS y,
CASE WHEN fw > 640 THEN CAST(floor(sw * (1 - (fw - 640) / CAST(fw AS DOUBLE))) AS BIGINT) ELSE sw END AS cw, CASE WHEN fh > 360 THEN CAST(floor(sh * (1 - (fh - 360) / CAST(fh AS DOUBLE))) AS BIGINT) ELSE sh END AS ch FROM f"""


@query(_geometry_sql("CASE WHEN pw <= 640 THEN pw ELSE 640 END", "CASE WHEN pw <= 640 THEN 360 ELSE lh END"))
def geometry_fit(spark, d):
    return _geometry(spark, d, "fill")


@query(_geometry_sql("CASE WHEN pw >= 640 THEN pw ELSE 640 END", "CASE WHEN pw >= 640 THEN 360 ELSE lh END"))
def geometry_smart(spark, d):
    return _geometry(spark, d, "smart")


@query(_geometry_sql("640", "lh"))
def geometry_letter(spark, d):
    return _geometry(spark, d, "letter")


@query(_geometry_sql("pw", "360"))
def geometry_pillar(spark, d):
    return _geometry(spark, d, "pillar")


@query(_geometry_sql("sw", "sh"))
def geometry_native(spark, d):
    return _geometry(spark, d, "native")


@query(_geometry_sql("floor(sw * 59 / 54.0::DOUBLE + 0.5)", "sh"))
def geometry_corrected(spark, d):
    return _geometry(spark, d, "corrected", src_sar=(59, 54))


@query(_geometry_sql("640", "360"))
def geometry_distort(spark, d):
    return _geometry(spark, d, "distort")


@query("""WITH s AS (SELECT p_partkey AS k, CAST(p_size * 16 AS BIGINT) AS w, CAST(p_partkey % 50 * 9 + 9 AS BIGINT) AS h FROM part)
SELECT k, CAST(floor(w * 0.25::DOUBLE) AS BIGINT) AS x, CAST(floor(h * 0.5::DOUBLE) AS BIGINT) AS y, least(CAST(floor(w * 0.9::DOUBLE) AS BIGINT), w - CAST(floor(w * 0.25::DOUBLE) AS BIGINT)) AS cw, least(CAST(floor(h * 0.3::DOUBLE) AS BIGINT), h - CAST(floor(h * 0.5::DOUBLE) AS BIGINT)) AS ch FROM s""")
def crop_geometry(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 16).cast("long").alias("sw"), (F.col("p_partkey") % 50 * 9 + 9).cast("long").alias("sh"))
    g = P.crop(F.col("sw"), F.col("sh"), 0.25, 0.5, 0.9, 0.3)
    return parts.select("k", g["x"].alias("x"), g["y"].alias("y"), g["w"].alias("cw"), g["h"].alias("ch"))


@query("SELECT event_id AS position, NULL AS value, event_type, 59 AS sar_num, 54 AS sar_den FROM events")
def remove_and_sar(spark, d):
    c = events(spark, d, "value", "event_type")
    return P.sar(P.remove(c.df, "value"))


@query(_sums_sql(f"{_E}, m AS (SELECT x.vec_id, [CASE WHEN p < 0 AND q < 0 THEN p + q + p * q ELSE p + q - p * q END FOR p, i IN x.a FOR q, j IN y.a IF i = j] AS x FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)".replace("[CASE WHEN p < 0 AND q < 0 THEN p + q + p * q ELSE p + q - p * q END FOR p, i IN x.a FOR q, j IN y.a IF i = j]", "list_transform(list_zip(x.a, y.a), lambda z: CASE WHEN z[1] < 0 AND z[2] < 0 THEN z[1] + z[2] + z[1] * z[2] ELSE z[1] + z[2] - z[1] * z[2] END)"), "m"))
def audio_mix_fold(spark, d):
    c = stereo(spark, d)
    other = c.df.select((F.col("position") - 1).alias("position"), F.col("audio").alias("b"))
    return _sums(c.df.join(other, "position").select("position", A.mix(F.col("audio"), F.col("b")).alias("audio")))


@query(_sums_sql(f"{_E}, m AS (SELECT vec_id, list_transform(range(1, 33), lambda k: greatest(-1.0, least(1.0, greatest(-1.0, least(1.0, a[2*k-1] * 0.5)) + a[2*k] * 0.25))) AS x FROM e)", "m"))
def audio_mix_matrix(spark, d):
    c = stereo(spark, d)
    return _sums(c.df.select("position", A.mix_matrix(F.col("audio"), [[0.5], [0.25]]).alias("audio")))


_LOW = "0.04321391826377226"


@query(_sums_sql(f"{_E}, g AS (SELECT vec_id, list_transform(range(1, 65), lambda k: greatest(-1.0, least(1.0, a[k] * (1.0 + (0.25 - 1.0) * ((k - 1) // 2) / 32.0::DOUBLE)))) AS a FROM e), m AS (SELECT vec_id, list_transform(range(1, 65), lambda k: list_sum(list_transform(range(0, 13), lambda t: CASE WHEN k - 2 * t >= 1 THEN a[k - 2 * t] * (1 - {_LOW}) * pow({_LOW}, t) ELSE 0.0 END))) AS x FROM g)", "m"))
def audio_volume_ramp(spark, d):
    c = stereo(spark, d)
    return _sums(c.df.select("position", A.volume(F.col("audio"), 1.0, 0.25, 2).alias("audio")))


@query(_sums_sql(f"{_E}, m AS (SELECT vec_id, list_transform(range(0, 48), lambda k: CASE WHEN k // 2 = 23 THEN a[63 + k % 2] ELSE (a[CAST(floor((k // 2) * (32 / 24.0::DOUBLE)) AS BIGINT) * 2 + k % 2 + 1] + a[least(CAST(floor((k // 2) * (32 / 24.0::DOUBLE)) AS BIGINT) + 1, 31) * 2 + k % 2 + 1]) / 2 END) AS x FROM e)", "m"))
def audio_pitch(spark, d):
    c = stereo(spark, d)
    return _sums(c.df.select("position", A.pitch(F.col("audio"), 24, 2).alias("audio")))


@query(_sums_sql(f"{_E}, m AS (SELECT vec_id, list_transform(range(0, 64), lambda k: a[(31 - k // 2) * 2 + k % 2 + 1]) AS x FROM e)", "m"))
def audio_reverse(spark, d):
    c = stereo(spark, d)
    return _sums(c.df.select("position", A.reverse(F.col("audio"), 2).alias("audio")))


@query("""WITH u AS (SELECT vec_id * 64 + i - 1 AS s, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
f AS (SELECT ((s + 1) * 30000 + 1601600 - 1) // 1601600 - 1 AS p, s, x FROM u)
SELECT p AS position, CAST((p + 1) * 1601600 // 30000 - p * 1601600 // 30000 AS INT) AS n, round(sum(x), 6) AS total, round(sum(x * (s - p * 1601600 // 30000 + 1)), 6) AS weighted FROM f GROUP BY 1""")
def audio_reseat(spark, d):
    c = stereo(spark, d)
    return _sums(A.reseat(c.df, "audio", 64, 1600, (30000, 1001), c.length))


@query(_sums_sql(f"{_E}, m AS (SELECT x.vec_id, list_transform(range(1, 65), lambda k: greatest(-1.0, least(1.0, x.a[k] + CASE WHEN (k - 1) // 2 = 31 THEN y.a[64] ELSE (y.a[(k - 1) // 2 * 2 + 1] + y.a[(k - 1) // 2 * 2 + 2]) / 2 END * CASE WHEN k % 2 = 1 THEN 0.5 ELSE 0.25 END))) AS x FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)", "m"))
def audio_channel_mixer(spark, d):
    c = stereo(spark, d)
    other = c.df.select((F.col("position") - 1).alias("position"), F.col("audio").alias("b"))
    return _sums(c.df.join(other, "position").select("position", A.channel_mixer(F.col("audio"), F.col("b"), [0.5, 0.25], 2).alias("audio")))


@query(_sums_sql(f"{_E}, g AS (SELECT vec_id, list_transform(range(1, 33), lambda k: greatest(-1.0, least(1.0, a[2 * k - 1] + a[2 * k]))) AS a FROM e), m AS (SELECT vec_id, list_transform(range(1, 33), lambda k: list_sum(list_transform(range(0, 13), lambda t: CASE WHEN k - t >= 1 THEN a[k - t] * (1 - {_LOW}) * pow({_LOW}, t) ELSE 0.0 END))) AS x FROM g)", "m"))
def audio_channel_convert(spark, d):
    return _sums(stereo(spark, d).df.select("position", A.channel_convert(F.col("audio"), 2, 1).alias("audio")))


@query("SELECT vec_id AS position, round(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))), 9) AS level FROM embeddings")
def max_level(spark, d):
    return stereo(spark, d).df.select("position", F.round(A.level(F.col("audio")), 9).alias("level"))


@query(_sums_sql(f"{_E}, m AS (SELECT x.vec_id, list_transform(range(1, 65), lambda k: 0.625 * (x.a[k] + 0.8 * CASE WHEN k > 28 THEN x.a[k - 28] WHEN y.a IS NULL THEN 0.0 ELSE y.a[k + 36] END)) AS x FROM e x LEFT JOIN e y ON y.vec_id = x.vec_id - 1)", "m"))
def audio_lowpass(spark, d):
    c = stereo(spark, d)
    return _sums(A.lowpass(c.df, "audio", 14, 2, block=32))


@query(_sums_sql(f"{_E}, m AS (SELECT vec_id, list_transform(a, lambda v: CAST(greatest(-32768, least(32767, trunc(v * 32768))) AS DOUBLE) / 32768) AS x FROM e)", "m"))
def audio_convert(spark, d):
    c = stereo(spark, d)
    ints = A.convert(F.col("audio"), "float", "pcm16")
    return _sums(c.df.select("position", A.convert(ints, "pcm16", "float").alias("audio")))


@query(_sums_sql(f"{_E}, m AS (SELECT vec_id, list_transform(range(1, 33), lambda k: a[2 * k]) AS x FROM e)", "m"))
def audio_channel_extract(spark, d):
    return _sums(stereo(spark, d).df.select("position", A.channel_extract(F.col("audio"), 2, 1).alias("audio")))


@query("""WITH p AS (SELECT floor(o_orderkey / 10) AS g, o_orderkey, o_totalprice FROM orders)
SELECT CAST(g AS BIGINT) AS pack, round(avg(o_totalprice), 6) AS average, max(o_totalprice) AS highest, min(o_totalprice) AS lowest FROM p GROUP BY 1""")
def lang_average(spark, d):
    packs = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 10).alias("pack")).agg(F.collect_list("o_totalprice").alias("p"))
    return packs.select("pack", F.round(W.pack_average(F.col("p")), 6).alias("average"), F.array_max("p").alias("highest"), F.array_min("p").alias("lowest"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'inf' ELSE CAST(round(o_totalprice / (o_orderkey % 3), 6) AS VARCHAR) END = 'inf' AS infinite, o_totalprice % 7 AS m, CAST(o_orderpriority < '3' AS INT) AS urgent FROM orders""")
def lang_arithmetic(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), (W.div(F.col("o_totalprice"), F.col("o_orderkey") % 3) == float("inf")).alias("infinite"), W.mod(F.col("o_totalprice"), F.lit(7)).alias("m"), W.compare(F.col("o_orderpriority"), "<", F.lit("3")).alias("urgent"))


@query("SELECT event_type, CAST(bool_and(value > 0 AND user_id >= 0) AS INT) AS matches FROM events GROUP BY 1")
def prop_match(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(W.matches_all([F.col("value") > 0, F.col("user_id") >= 0]).alias("matches"))


@query("SELECT s_suppkey AS k, p.name AS name, p.value AS value FROM supplier, LATERAL (VALUES ('s_name', s_name), ('s_suppkey', CAST(s_suppkey AS VARCHAR))) AS p(name, value)")
def prop_unfold(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return s.select(F.col("s_suppkey").alias("k"), F.explode(W.unfold_properties(dict(s.dtypes))).alias("p")).select("k", "p.name", "p.value")


@query("""WITH g AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: 255 - greatest(0, least(255, floor(floor((x + 1) / 2 * 255 + 0.5))))) AS v FROM embeddings)
SELECT vec_id AS position, CAST(list_sum(v) AS BIGINT) AS total FROM g""")
def image_invert(spark, d):
    df = I.grey(stereo(spark, d).df, "audio", "image", 8, 8)
    return _plane_sum(I.apply(df, "image", I.invert(1)))


@query("""WITH g AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN floor((x + 1) / 2 * 255 + 0.5) < 128 THEN 16 ELSE 235 END) AS v FROM embeddings)
SELECT vec_id AS position, CAST(list_sum(v) AS BIGINT) AS total FROM g""")
def image_mono(spark, d):
    df = I.grey(stereo(spark, d).df, "audio", "image", 8, 8)
    return _plane_sum(I.apply(df, "image", I.mono(128)))


def _plane_sum(df):
    """The sum of the samples of the first plane."""
    return plane_sums(df, 1).select("position", F.col("total1").alias("total"))
