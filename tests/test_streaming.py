import time

import duckdb
import pytest
from pyspark.sql import functions as F

from cadenza.plans import registry
from cadenza.streaming import operators as O
from cadenza.streaming import ordered

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The events in 16 part files dealt by a hash, so that no file comes before another in time or number."""
    at = str(tmp_path_factory.mktemp("shuffled"))
    spark.read.parquet(f"{SF}/events.parquet").repartition(16, F.xxhash64("event_id")).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", ["stream_nudger", "stream_tumbling", "stream_sessions", "stream_lowpass", "stream_reseat", "stream_tee"])
def test_any_order_of_files(spark, shuffled, name):
    """Many files in no order, a few a batch: the rows are those of the SQL over the whole table."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{shuffled}/events.parquet/*.parquet')")
    rows = con.execute(registry.ORACLE_SQL[name])
    order = sorted(c[0] for c in rows.description)
    want = rows.df()[order]
    got = registry.QUERIES[name](spark, shuffled).toPandas()[order]
    key = [c for c in order if want[c].dtype.kind != "f"] or order
    want, got = (x.sort_values([*key, *(c for c in order if c not in key)]).reset_index(drop=True) for x in (want, got))
    assert len(got) == len(want)
    for c in order:
        if want[c].dtype.kind == "f":
            assert (abs(got[c] - want[c]) < 1e-6).all(), c
        else:
            assert (got[c].astype(str).str[:10] == want[c].astype(str).str[:10]).all(), c


def fed(spark, tmp_path, batches, schema, make, **how):
    """make's stream over one file a batch, and everything it gives, in the order of batches."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.01)
    stream = O.growing(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = []
    query = O.started(make(stream).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(**(how or {"availableNow": True})))
    return query, got


def test_order_and_duplicates(spark, tmp_path):
    batches = [[("a", 2, "x"), ("a", 0, "x"), ("b", 5, "x")], [("a", 2, "again"), ("a", 3, "x"), ("b", None, "x")], [("a", 1, "x"), ("a", 0, "late"), ("a", 1, "again")]]
    query, got = fed(spark, tmp_path, batches, "k string, p long, v string", lambda s: ordered.in_order(s, ["k"], "p"))
    query.awaitTermination()
    main = [(r["p"], r["v"]) for r in got if r["k"] == "a" and r["status"] == ordered.IN_ORDER]
    assert main == [(0, "x"), (1, "x"), (2, "x"), (3, "x")]
    assert [(r["p"], r["v"], r["status"], r["n_late"]) for r in got if r["k"] == "a" and r["status"] != ordered.IN_ORDER] == [(2, "again", "again", 0), (0, "late", "again", 0), (1, "again", "again", 0)]
    assert [(r["p"], r["status"]) for r in got if r["k"] == "b"] == [(None, "late")]  # 5 waits


def test_a_full_queue_moves_on_and_counts_what_comes_late(spark, tmp_path):
    batches = [[(0, p) for p in (9, 7, 5)], [(0, 3)], [(0, p) for p in (0, 1, 2, 1)], [(0, p) for p in (4, 6, 8, 3)]]
    query, got = fed(spark, tmp_path, batches, "k int, p long", lambda s: ordered.in_order(s, ["k"], "p", queue=3))
    query.awaitTermination()
    assert [r["p"] for r in got if r["status"] == ordered.IN_ORDER] == [3, 4, 5, 6, 7, 8, 9]
    assert [(r["p"], r["n_late"]) for r in got if r["status"] == ordered.LATE] == [(0, 1), (1, 2), (2, 3)]
    assert sorted(r["p"] for r in got if r["status"] == ordered.AGAIN) == [1, 3]


def test_a_timeout_releases(spark, tmp_path):
    query, got = fed(spark, tmp_path, [[("a", 0), ("a", 2), ("a", 3), ("a", 6)]], "k string, p long", lambda s: ordered.in_order(s, ["k"], "p", queue=None, timeout=1.0), processingTime="200 milliseconds")
    try:
        until = time.time() + 60
        while len(got) < 4 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert [r["p"] for r in got] == [0, 2, 3, 6]


def test_lowpass_of_few_and_odd_mags(spark, tmp_path):
    import numpy as np

    values = {u: np.random.default_rng(u).normal(size=23).round(3).tolist() for u in (1, 2)}
    rows = [(2 * k + u - 1, u, v) for u in values for k, v in enumerate(values[u])]
    for mag in (0, 1, 3, 30):
        at = tmp_path / str(mag)
        for k, part in enumerate((rows[30:], rows[10:20], rows[:10], rows[20:30])):
            spark.createDataFrame(part, "p long, u long, v double").coalesce(1).write.parquet(f"{at}/in/{k}")
        stream = O.growing(spark, f"{at}/in/*", spark.createDataFrame([], "p long, u long, v double").schema, files_per_trigger=1)
        blocks = ordered.blocks(stream, "p", "u", size=7, groups=2, length=46)
        O.drained(blocks, f"{at}/blocks", f"{at}/state")
        again = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/blocks")
        out = O.drained(ordered.folded(again, "u", ordered.lowpass_step("u", "p", "v", mag), "u long, p long, filtered double"), f"{at}/out", f"{at}/state2").collect()
        for u, x in values.items():
            want = [v if mag <= 1 else 0.625 * (v + 0.8 * (x[k - mag] if k >= mag else 0)) for k, v in enumerate(x)]
            assert np.allclose([r["filtered"] for r in sorted((r for r in out if r["u"] == u), key=lambda r: r["p"])], want), (u, mag)


def test_late_rows_are_counted_where_they_belong(spark, tmp_path):
    day = lambda d, v: (f"2024-01-{d:02d} 12:00:00", "k", v)
    for k, rows in enumerate([[day(1, 1.0), day(20, 2.0)], [day(1, 4.0), day(19, 8.0), day(20, 16.0)]]):
        spark.createDataFrame(rows, "ts string, k string, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = O.growing(spark, f"{tmp_path}/in/*", spark.createDataFrame([], "ts string, k string, v double").schema, files_per_trigger=1).withColumn("ts", F.col("ts").cast("timestamp"))
    out = O.tumbling(stream, "ts", "1 day", {"total": F.col("v")}, ["k"], f"{tmp_path}/parts", f"{tmp_path}/state", wait="2 days")
    got = {r["start"].day: (r["total"], r["late"], r["closed"]) for r in out.collect()}
    assert got == {1: (5.0, got[1][1], True), 19: (8.0, 0, False), 20: (18.0, 0, False)} and got[1][1] in (0, 1)
    assert O.tumbling(stream, "ts", "1 day", {"total": F.col("v")}, ["k"], f"{tmp_path}/parts", f"{tmp_path}/state", wait="2 days").count() == 3  # nothing new: nothing changes


def test_tee_isolates_a_branch_and_repeats_nothing(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(k, j) for j in range(3)], "file int, j int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.01)
    stream = O.growing(spark, f"{tmp_path}/in/*", spark.createDataFrame([], "file int, j int").schema, files_per_trigger=1)
    calls = []

    def sink(name, fails=()):
        def put(batch, number):
            calls.append((name, number))
            if number in fails and calls.count((name, number)) == 1:
                raise ValueError("no room")
            batch.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={number}")

        return put

    branches = {"main": sink("main"), "weak": sink("weak", fails=(1,)), "later": sink("later")}
    ledger = O.tee(stream, branches, f"{tmp_path}/spool", f"{tmp_path}/state", preroll={"later": 3})
    for name in branches:
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 12
    assert [(r["branch"], r["batch"]) for r in ledger.where("error is not null").collect()] == [("weak", 1)]
    assert [c for c in calls if c[0] == "later"] == [("later", k) for k in range(4)] and calls.index(("later", 0)) > calls.index(("main", 2))
    # The last batch again, as after a failure before its commit.
    (tmp_path / "state" / "commits" / "3").unlink()
    for crc in (tmp_path / "state" / "commits").glob(".3.crc"):
        crc.unlink()
    before = len(calls)
    again = O.tee(stream, branches, f"{tmp_path}/spool", f"{tmp_path}/state", preroll={"later": 3})
    assert len(calls) == before and again.where("error is null").select("branch", "batch").distinct().count() == 12
