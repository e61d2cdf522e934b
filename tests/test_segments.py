import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import combine as C
from cadenza.operators import segments as S
from cadenza.operators.windows import previous

SCHEMA = "slot long, z int, start long, duration long"


def brute(rows):
    points = sorted({p for _, _, a, n in rows if n > 0 for p in (a, a + n)})
    return {(a, b): sorted((z or 0, s) for s, z, f, n in rows if n > 0 and f <= a < f + n) for a, b in zip(points, points[1:], strict=False)}


@pytest.mark.parametrize("seed,span,longest", [(1, 200, 12), (2, 5000, 3000), (3, 1 << 40, 1 << 39), (4, 30, 1)])
def test_stretches_by_brute_force(spark, seed, span, longest):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, 0, 1, 5]), rng.randint(-span // 4, span), rng.randint(0, longest)) for k in range(120)]
    rows += [(500 + k, 1, 7, 9) for k in range(3)] + [(600, 2, 0, 0), (601, 2, 5, -3)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    out = S.composed(df).collect()
    assert {(r["start"], r["end"]): [(x["z"], x["slot"]) for x in r["layers"]] for r in out} == want and len(out) == len(want)
    assert all(r["n"] == len(r["layers"]) for r in out)
    assert {(r["start"], r["end"]): r["n"] for r in S.depth(df).collect()} == {k: len(v) for k, v in want.items()}


def test_no_overlays(spark):
    for rows in ([], [(1, 0, 5, 0)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert S.composed(df).count() == 0 and S.depth(df).count() == 0


def test_expands_to_the_rows_a_position(spark):
    k = F.col("id")
    overlays = spark.range(3000).select(k.alias("slot"), (k % 7).cast("int").alias("z"), (k * 3).alias("start"), (k % 11).alias("duration"))
    frames = spark.range(9100).withColumnRenamed("id", "position")
    want = {(r["position"], r["n"]) for r in C.active(frames, overlays).groupBy("position").agg(F.count("*").alias("n")).collect()}
    got = S.frames_of(S.composed(overlays).drop("layers")).where("n > 0")
    assert {(r["position"], r["n"]) for r in got.collect()} == want


def test_many_overlays(spark):
    """Half a million, some of them very long: stretches and depths agree."""
    k = F.col("id")
    overlays = spark.range(500_000).select(k.alias("slot"), F.lit(0).alias("z"), (k * 7919 % 1_000_003).alias("start"), F.when(k % 100_000 == 0, 900_000).otherwise(k % 5 + 1).alias("duration"))
    pairs = S.active_in(S.stretches(S.change_points(overlays)), overlays).groupBy("start", "end").agg(F.count("*").alias("n"))
    both = pairs.join(S.depth(overlays).withColumnRenamed("n", "m"), ["start", "end"], "full")
    assert both.where("not (coalesce(n, 0) <=> coalesce(m, 0))").isEmpty() and both.count() > 500_000


def test_events_of_a_table(spark):
    clip = spark.range(0, 50).where("id not in (20, 21)").select(F.col("id").alias("position"), (F.col("id") * 2).alias("v"))
    points = spark.createDataFrame([(3,), (3,), (20,), (49,), (70,)], "position long")
    got = {r["position"]: (r["event"], r["event_start"], r["v"]) for r in S.events_in(clip, points).collect()}
    assert got == {p: (sum(q <= p for q in (3, 20, 49)), max((q for q in (3, 20, 49) if q <= p), default=None), p * 2) for p in range(50) if p not in (20, 21)}


def test_previous_over_levels(spark):
    df = spark.range(0, 5000, 13).select(F.col("id").alias("position"))
    for few in (1, 100_000):
        got = {r["position"]: r["b"] for r in previous(df, "b", bucket=8, few=few).collect()}
        assert got == {p: p - 13 if p else None for p in range(0, 5000, 13)}
