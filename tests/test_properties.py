from pyspark.sql import functions as F

from cadenza.functions import properties as P


def test_rows_of_different_properties(spark):
    rows = [(1, '{"a": 1, "b.c": "x"}'), (2, '{"a": "two", "d": null}'), (3, "{}"), (4, "no json"), (5, None), (6, "[1, 2]")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", P.parsed(F.col("t")).alias("p"))
    p = F.col("p")
    got = {r["id"]: tuple(r)[1:] for r in df.select("id", P.value(p, "a", "long"), P.value(p, "b.c", "string"), P.has(p, "d"), P.has(p, "a")).collect()}
    assert got == {1: (1, "x", False, True), 2: (None, None, True, True), 3: (None, None, False, False), 4: (None, None, None, None), 5: (None, None, None, None), 6: (None, None, False, False)}
    names = sorted((r["id"], r["name"], r["text"]) for r in P.unfolded(df.where("id < 6"), "p").collect() if r["name"] != "d")
    assert names == [(1, "a", "1"), (1, "b.c", "x"), (2, "a", "two")]
    assert [r["name"] for r in P.unfolded(df.where("id = 1"), "p", r"\.").collect()] == ["b.c"]
