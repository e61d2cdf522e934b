"""Queries of folds in order, and queries written in SQL alone with the library's functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import properties as P
from cadenza.functions.sql import register_sql
from cadenza.operators import recurrence as N
from cadenza.plans.base import events, registers, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registers(QUERIES, ORACLE_SQL)


@query("SELECT k.event_id AS position, round(sum(0.1::DOUBLE * pow(0.9::DOUBLE, k.event_id - i.event_id) * i.value), 6) AS y FROM events k JOIN events i ON i.event_id BETWEEN k.event_id - 400 AND k.event_id GROUP BY 1")
def fold_filter(spark, d):
    """y = 0.9 y + 0.1 value over the whole clip in order. (What lies 400 rows back counts for less than 1e-17 in it.)"""
    c = events(spark, d)
    df = c.df.withColumn("part", F.col("value") * 0.1)
    return N.folded(df, c.length, N.affine(0.9, "part"), ["part"], "y", bucket=1024, wide=16).select("position", F.round("y", 6).alias("y"))


@query("SELECT event_id AS position, CAST(coalesce(last_value(CASE WHEN value > 80 THEN 1 WHEN value < 20 THEN 0 END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS open FROM events")
def fold_gate(spark, d):
    """A gate that opens above 80 and closes under 20, and stays as it is between."""
    c = events(spark, d)
    df = c.df.withColumn("move", F.when(F.col("value") > 80, 1).when(F.col("value") < 20, 0))
    return N.folded(df, c.length, N.machine(2, "move", [[0, 0], [1, 1]]), ["move"], "open", bucket=1024, wide=16).select("position", F.col("open").cast("int").alias("open"))


def _properties(spark, d):
    """Each event with properties of its own: k, one named by its type and, of every second, even."""
    c = events(spark, d, "event_type", "value", "props")
    text = F.concat(F.expr("rtrim('}', props)"), F.lit(', "'), "event_type", F.lit('": '), F.col("value").cast("string"), F.when(F.col("position") % 2 == 0, ', "even": true').otherwise(""), F.lit("}"))
    return c.df.select("position", P.parsed(text).alias("p"))


@query("SELECT event_id AS position, CAST(props->>'k' AS BIGINT) AS k, CASE WHEN event_type = 'purchase' THEN value END AS purchase, event_id % 2 = 0 AS even, CAST(NULL AS BIGINT) AS none FROM events")
def variant_values(spark, d):
    """Properties by name and type, though no row has them all."""
    p = F.col("p")
    return _properties(spark, d).select("position", P.value(p, "k", "long").alias("k"), P.value(p, "purchase", "double").alias("purchase"), P.has(p, "even").alias("even"), P.value(p, "none", "long").alias("none"))


@query("""SELECT name, count(*) AS n FROM (SELECT unnest(CASE WHEN event_id % 2 = 0 THEN [event_type, 'even'] ELSE [event_type] END) AS name FROM events) WHERE regexp_matches(name, '^(p|e)|n$') GROUP BY 1""")
def variant_names(spark, d):
    """How often the names that a pattern finds occur."""
    return P.unfolded(_properties(spark, d), "p", "^(p|e)|n$").groupBy("name").agg(F.count("*").alias("n"))


def _sql(spark, d, text: str, *tables: str):
    register_sql(spark)
    for name in tables:
        table(spark, d, name).createOrReplaceTempView(f"cz_{name}")
    return spark.sql(text)


@query("""SELECT event_id AS k, printf('%02d:%02d:%02d:%02d', event_id * 211 // 90000 % 24, event_id * 211 // 1500 % 60, event_id * 211 // 25 % 60, event_id * 211 % 25) AS tc, event_id % 7 AS m, greatest(10, least(90, value)) AS held,
CASE WHEN event_id BETWEEN 100 AND 200 THEN 5 + (event_id - 100) / 100.0::DOUBLE * 10 END AS gain, CASE event_id % 5 WHEN 1 THEN 1601 WHEN 3 THEN 1601 ELSE 1602 END AS mpeg, (event_id + 1) * 44144100 // 30000 - event_id * 44144100 // 30000 AS plain FROM events""")
def sql_words(spark, d):
    """Scalar words in SQL alone."""
    return _sql(spark, d, "SELECT event_id AS k, cz_tc_pal(event_id * 211) AS tc, cz_mod(event_id, 7) AS m, cz_clamp(value, 10, 90) AS held, cz_lerp(event_id, 100, 200, 5, 15) AS gain, cz_samples_mpeg_ntsc(event_id) AS mpeg, cz_samples(event_id, 44100, 30000, 1001) AS plain FROM cz_events", "events")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, p.name AS name, p.value AS value FROM supplier, LATERAL (VALUES ('s_name', s_name), ('s_nationkey', CAST(s_nationkey AS VARCHAR))) AS p(name, value)")
def sql_unfold(spark, d):
    """Columns unfolded to rows, from SQL over a TABLE argument."""
    return _sql(spark, d, "SELECT id, name, value FROM cz_unfold(TABLE(SELECT s_suppkey, s_name, s_nationkey FROM cz_supplier), id => 's_suppkey')", "supplier")


@query("""WITH s AS (SELECT user_id % 50 AS key, event_id % 3 = 0 AS cut, event_id * 10 AS a, event_id * 10 + 20 + event_id % 700 AS b FROM events),
p AS (SELECT DISTINCT key, unnest([a, b]) AS p FROM s), g AS (SELECT key, p AS a, lead(p) OVER (PARTITION BY key ORDER BY p) AS b FROM p)
SELECT g.key, CAST(sum(g.b - g.a) AS BIGINT) AS total FROM g JOIN s ON s.key = g.key AND NOT s.cut AND s.a <= g.a AND s.b >= g.b WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.key = g.key AND c.cut AND c.a < g.b AND c.b > g.a) GROUP BY 1""")
def sql_uncovered(spark, d):
    """How much of each key's spans is outside of its cuts, by a table function that goes through each partition in order."""
    return _sql(spark, d, """SELECT key, sum(duration) AS total FROM cz_uncovered(TABLE(SELECT user_id % 50 AS key, if(event_id % 3 = 0, 0, 1) AS kind, event_id * 10 AS start, 20 + event_id % 700 AS duration FROM cz_events)
PARTITION BY key ORDER BY start) GROUP BY key""", "events")  # fmt: skip
