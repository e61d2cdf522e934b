"""The re-indexing operators against loops over positions, for many small clips."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions.timecode import RATES
from cadenza.model import Clip
from cadenza.operators import combine as C
from cadenza.operators import reindex as R


def make(spark, n, fps=(25, 1)):
    return Clip(spark.range(n).select(F.col("id").alias("position"), F.col("id").alias("v")), n, fps)


def seen(c, col="v"):
    rows = sorted((r["position"], r[col]) for r in c.df.collect())
    assert [p for p, _ in rows] == list(range(c.length))
    return [v for _, v in rows]


@pytest.mark.parametrize("first,out,length", [(0, -1, 287), (300, 1000, 1), (-300, 1000, 287), (-1, 1000, 1), (0, 300, 287), (0, -300, 0), (5, 3, 2), (0, 0, 0), (20, 30, 10), (10, 0, 10)])
def test_clip_lengths(first, out, length):
    a, b = R._bound(first, 287, True), R._bound(out, 287, False)
    assert abs(b - a) == length


def test_clips(spark):
    c = make(spark, 12)
    for a, b in ((3, 9), (9, 3), (-4, -1), (11, 0), (5, 5)):
        x, y = R._bound(a, 12, True), R._bound(b, 12, False)
        assert seen(R.clip(c, a, b)) == (list(range(x, y)) if x < y else list(range(x, y, -1)))
    assert seen(R.clip(R.clip(c, 8, 2), 1, 4)) == [7, 6, 5]


def test_steps_and_pads(spark):
    c = make(spark, 11)
    assert seen(R.step(c, 3)) == [0, 3, 6] and R.step(c, -2).df.count() == 0 and R.step(c, 0) is c
    assert [r["v"] for r in R.offset(c, 2).df.orderBy("position").collect()] == [None, None, *range(11)]
    assert seen(R.extract(c, 5)) == [min(10, int(p / 4 * 11)) for p in range(5)]
    assert seen(R.frame_list(c, [3, 3, 0, 10])) == [3, 3, 0, 10]
    with pytest.raises(ValueError):
        R.frame_list(c, [11])


def test_holds_repeats_loops(spark):
    c = make(spark, 5)
    assert seen(R.hold(c, 2, 3)) == [0, 1, 2, 2, 2, 2, 3, 4]
    assert seen(R.hold(c, -1, 2)) == [0, 1, 2, 3, 4, 4, 4]
    f, b = list(range(5)), list(range(4, -1, -1))
    assert seen(R.repeat(c, "repeat", 2)) == f + f
    assert seen(R.repeat(c, "pingpong", 3)) == f + b + f
    assert seen(R.repeat(c, "pongping", 3)) == b + f + b
    assert seen(R.loop(c, 12)) == [p % 5 for p in range(12)]
    assert seen(R.transport(c, 1, 2, 7)) == [(1 + 2 * p) % 5 for p in range(7)]
    assert seen(R.transport(c, 1, 2, 7, looping=False)) == [min(4, 1 + 2 * p) for p in range(7)]


@pytest.mark.parametrize("n", [4, 5, 6, 7, 8, 9, 13])
def test_pulldown(spark, n):
    rows = R.pulldown(make(spark, n), ["v"])
    want = []
    for p in range(n * 5 // 4):
        b = p * 4 // 5 // 4 * 4
        top, bottom = ((0, 0), (1, 1), (1, 2), (2, 3), (3, 3))[p % 5]
        want.append((min(n - 1, b + top), min(n - 1, b + bottom)))
    assert [(r["v_top"], r["v_bottom"]) for r in rows.df.orderBy("position").collect()] == want


def test_interlace(spark):
    got = R.interlace(make(spark, 7, (50, 1)), ["v"])
    assert got.fps == (25, 1) and [(r["v_bottom"], r["v_top"]) for r in got.df.orderBy("position").collect()] == [(0, 1), (2, 3), (4, 5)]
    assert R.interlace(make(spark, 7), ["v"]).length == 7


def test_rates(spark):
    rates = [(24, 1), (25, 1), (50, 1), (30000, 1001), (60000, 1001)]
    for src in rates:
        for dst in rates:
            got = R.frame_rate(make(spark, 23, src), *dst)
            n = -(-23 * dst[0] * src[1] // (dst[1] * src[0]))
            assert got.length == n
            if src in rates[1:4:2]:
                assert seen(got) == [p * src[0] * dst[1] // (src[1] * dst[0]) for p in range(n)]


def test_playlists_and_slots(spark):
    a, b, none = make(spark, 3), make(spark, 2), make(spark, 0)
    assert seen(R.playlist([a, none, b])) == [0, 1, 2, 0, 1]
    assert R.slots(list(range(10))) == list(range(10))
    assert R.slots(list(range(10)), 5, 3) == [5, 4, 3]


def test_muxers(spark):
    a = make(spark, 3)
    b = Clip(make(spark, 5).df.withColumnRenamed("v", "w"), 5)
    longest = C.muxer(a, b)
    assert seen(longest) == [0, 1, 2, 2, 2] and seen(longest, "w") == [0, 1, 2, 3, 4]
    assert C.muxer(a, b, False).length == 3 and len(seen(C.muxer(a, b, False))) == 3
    assert C.muxer(Clip(a.df.limit(0), 0), b).length == 5


def test_index_lookup(spark):
    index = spark.createDataFrame([(5, 5, 0, 100), (10, 7, 100, 50)], "frame long, frames long, offset long, length long")
    got = {r["position"]: r["key_frame"] for r in C.key_frame_of(spark.range(14).select(F.col("id").alias("position")), index, bucket=4).collect()}
    assert got == {p: 5 if p < 10 else 10 for p in range(14)}
    assert {r["key_frame"] for r in C.key_frame_of(spark.range(2).select(F.col("id").alias("position")), index.limit(0)).collect()} == {-1}
    frames = [C.available_frames(index, s, f).first()[0] for s, f in ((0, False), (99, False), (100, False), (149, False), (150, True))]
    assert frames == [0, 0, 10, 10, 17]


def test_rate_table():
    assert {k: v[0] for k, v in RATES.items()} == {"movie": 24, "pal": 25, "ntsc": 30, "pal_50": 50, "ntsc_60": 60}
