import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions.sql import register_sql
from cadenza.operators import recurrence as N


@pytest.mark.parametrize("bucket,wide", [(7, 3), (64, 4096), (5000, 2)])
def test_affine_is_a_sequential_loop(spark, bucket, wide):
    rng = random.Random(bucket)
    rows = [(p, rng.choice([0.5, 0.99, 1.0, -0.3, 0.0, None]), rng.choice([rng.random(), None])) for p in range(700) if p % 11 and not 200 < p < 260]
    df = spark.createDataFrame(rows, "position long, a double, b double").repartition(5)
    y, want = 2.0, {}
    for p, a, b in rows:
        y = y if a is None or b is None else a * y + b
        want[p] = y
    got = {r["position"]: r["y"] for r in N.folded(df, 700, N.affine("a", "b", first=2.0), ["a", "b"], "y", bucket, wide).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_machine_is_a_sequential_loop(spark):
    rng = random.Random(2)
    table = [[1, 2, 0], [0, 0, 2], [2, 1, 1]]
    rows = [(p, rng.choice([0, 1, 2, 9, None])) for p in range(500)]
    df = spark.createDataFrame(rows, "position long, x int")
    at, want = 1, {}
    for p, x in rows:
        at = table[x][at] if x in (0, 1, 2) else at
        want[p] = at
    got = {r["position"]: r["s"] for r in N.folded(df, 500, N.machine(3, "x", table, first=1), ["x"], "s", 16, 3).collect()}
    assert got == want
    assert N.folded(df.limit(0), 0, N.affine(0.5, "x"), ["x"], "y").count() == 0


def test_sql_words_and_table_functions(spark):
    register_sql(spark)
    row = spark.sql("SELECT cz_tc_ntsc_df(1800) AS a, cz_tc_ntsc_df(17982) AS b, cz_tc_pal(90000 * 24) AS c, cz_mod(-1, 7) AS m, cz_mod(5, 0) AS z, cz_span_common(0, 10, 5, 10) AS s, cz_span_meets(0, 5, 5, 5) AS t, cz_has(map('a', '1'), 'b') AS h, cz_query(map('a', '1'), 'b', 'none') AS q").first()
    assert (row["a"], row["b"], row["c"], row["m"], row["z"], tuple(row["s"]), row["t"], row["h"], row["q"]) == ("00:01:00;02", "00:10:00;00", "00:00:00:00", 6, None, (5, 5), False, False, "none")
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), rng.choice([0, 1]), rng.randint(-50, 200), rng.choice([None, 0, *range(1, 40)])) for _ in range(150)]
    spark.createDataFrame(rows, "key string, kind int, start long, duration long").createOrReplaceTempView("cz_spans")
    got = spark.sql("SELECT * FROM cz_uncovered(TABLE(cz_spans) PARTITION BY key ORDER BY start)").collect()
    free = []
    for key, kind, start, n in rows:
        covered = {p for k, c, s, m in rows if k == key and c == 0 and m for p in range(s, s + m)}
        free += [(key, p) for p in range(start, start + (n or 0)) if kind == 1 and p not in covered]
    assert sorted((r["key"], p) for r in got for p in range(r["start"], r["start"] + r["duration"])) == sorted(free)
    out = spark.sql("SELECT * FROM cz_unfold(TABLE(SELECT 1 AS k, CAST(NULL AS STRING) AS a, 2.5D AS b), id => 'k')").collect()
    assert sorted(map(tuple, out)) == [("1", "a", None), ("1", "b", "2.5")]
    with pytest.raises(Exception, match="name of its id column"):
        spark.sql("SELECT * FROM cz_unfold(TABLE(cz_spans), id => 'no')").collect()
