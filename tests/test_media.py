"""Positions beyond 32 bits, files, carry-over at two levels, pictures: against plain Python."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import timecode as T
from cadenza.model import Clip
from cadenza.operators import audio as A
from cadenza.operators import combine as C
from cadenza.operators import image as I
from cadenza.operators import reindex as R
from cadenza.operators import windows as W
from cadenza.sources import files, sinks
from cadenza.sources.datasource import write_frames

FAR = 2_500_000_000


def test_positions_beyond_32_bits(spark):
    """A clip of 2.5 x 10^9 positions, of which only some rows are there."""
    rows = spark.createDataFrame([(5, 1), (FAR - 2, 2), (FAR - 1, 3)], "position long, v int")
    video, audio = Clip(rows, FAR), Clip(rows.withColumnRenamed("v", "w"), FAR)
    assert sorted(tuple(r) for r in C.muxer(video, audio).df.collect()) == [(5, 1, 1), (FAR - 2, 2, 2), (FAR - 1, 3, 3)]
    longer = Clip(spark.range(FAR, FAR + 5).select(F.col("id").alias("position"), F.col("id").alias("w")), FAR + 5)
    got = C.muxer(video, longer).df.orderBy("position").collect()
    assert [(r["position"], r["v"]) for r in got] == [(FAR + k, 3) for k in range(5)]
    held = R.hold(video, 5, 3_000_000_000)
    assert held.length == FAR + 3_000_000_000
    assert held.df.where(f"position > 5 and position < {3_000_000_005}").where("position % 1000000007 = 0").select("v", "silent").distinct().collect()[0][:] == (1, True)


def test_lowpass_without_a_delay(spark):
    clip = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, -1.0])], "position long, x array<double>")
    for mag in (0, 1):
        assert [r["x"] for r in A.lowpass(clip, "x", mag, block=2).orderBy("position").collect()] == [[1.0, 0.5], [0.25, -1.0]]
    assert [r["x"] for r in A.lowpass(clip, "x", 2, block=2).orderBy("position").collect()] == [[0.625, 0.3125], [0.625 * 1.05, 0.625 * -0.6]]


def test_two_levels_of_buckets(spark):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("position"), (F.col("id") % 5).alias("x"), F.when(F.col("id") % 700 == 650, F.col("id")).alias("m"))
    total, last, sums, seen = 0, None, {}, {}
    for k in range(n):
        total += k % 5
        last = k if k % 700 == 650 else last
        sums[k], seen[k] = total, last
    for few in (1, 100_000):
        assert {r["position"]: r["s"] for r in W.running_sum(df, "x", "s", bucket=3, few=few).collect()} == sums
        assert {r["position"]: r["s"] for r in W.last_seen(df, "m", "s", bucket=3, few=few).collect()} == seen


@pytest.mark.parametrize("version", [2, 3, 4])
def test_binary_index(spark, tmp_path, version):
    rows = [(0, 12, 0, 5000), (12, 12, 5000, 7000), (24, 1, 1 << 40, 2**31 - 1)]
    index = spark.createDataFrame(rows, "frame long, frames long, offset long, length long").withColumn("file", F.lit("a.awi"))
    rows_, foot_ = sinks.index_rows(index, "file", version)
    write_frames(rows_, str(tmp_path), foot_)
    raw = (tmp_path / "a.awi").read_bytes()
    head, foot = files.INDEX_SIZES[version]
    assert len(raw) == head + 60 + foot and struct.unpack(">hhiqi", raw[head + 20 : head + 40]) == (int(version == 4), 12, 12, 5000, 7000)
    got = files.read_index(spark, str(tmp_path / "a.awi")).orderBy("frame").collect()
    assert [(r["frame"], r["frames"], r["offset"], r["length"]) for r in got] == rows and all(r["closed"] and r["version"] == version for r in got)
    for cut in (foot, foot + 7):
        grown = files.parse_index(raw[:-cut])
        assert (grown[0], len(grown[1]), grown[2]) == (version, 3 if cut == foot else 2, False)
    assert files.parse_index(raw[:head])[0] == version and len(files.parse_index(raw[:head])[1]) == 0
    with pytest.raises(ValueError):
        files.parse_index(b"something else")


def test_wav_frames_are_split(spark, tmp_path):
    x = (np.sin(np.arange(30_000) / 9) * 0.7).reshape(-1, 2)
    clip = spark.createDataFrame([(k, x[k * 40 : (k + 1) * 40].ravel().tolist()) for k in range(375)], "position long, audio array<double>")
    sinks.write_null(sinks.write_wav(clip, str(tmp_path), "audio", 2, 1000, 150))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["part-0.wav", "part-1.wav", "part-2.wav"]
    got = files.read_wav(spark, str(tmp_path), frames_per_task=40)
    assert got.count() == 375 and got.select("path", "position").distinct().count() == 375
    part = got.where("path like '%part-1.wav'").orderBy("position").collect()
    want = np.trunc(x[6000:12000] * 32768) / 32768
    assert np.allclose(np.concatenate([r["audio"] for r in part]).reshape(-1, 2), want)


def test_raw_and_aud_files(spark, tmp_path):
    images = spark.createDataFrame([(k, "a", ("yuv420p", 4, 2, [bytes([k] * 8), bytes([k + 1] * 2), bytes([k + 2] * 2)])) for k in range(3)], f"position long, file string, image {I.IMAGE}")
    write_frames(sinks.raw_rows(images, "image", "file"), str(tmp_path / "raw"))
    assert (tmp_path / "raw" / "a").read_bytes().split(b"\n", 1)[0] == b"pf=yuv420p width=4 height=2 fps_num=25 fps_den=1 sar_num=1 sar_den=1 field_order=0 pad=0"
    frames = files.read_raw(spark, str(tmp_path / "raw")).orderBy("position").collect()
    assert [bytes(r["payload"]) for r in frames] == [bytes([k] * 8 + [k + 1] * 2 + [k + 2] * 2) for k in range(3)]
    write_frames(sinks.raw_rows(images, "image", "file", pad=16, header=False), str(tmp_path / "padded"))
    assert (tmp_path / "padded" / "a").stat().st_size == 48
    with pytest.raises(ValueError):
        sinks.raw_rows(images, "image", "file", pad=16)
    sound = spark.createDataFrame([(0, "a", [0.5] * 1602), (1, "a", [-0.5] * 1601)], "position long, file string, audio array<double>")
    write_frames(sinks.aud_rows(sound, "audio", "file", 48000, 1, (30000, 1001), "mpeg"), str(tmp_path / "aud"))
    aud = files.read_aud(spark, str(tmp_path / "aud")).orderBy("position").collect()
    assert [(r["samples"], r["payload"][:2]) for r in aud] == [(1602, b"\x00\x40"), (1601, b"\x00\xc0")]


def test_exact_times(spark):
    lit = lambda a, b: (F.lit(a).cast("long"), F.lit(b).cast("long"))
    big = (1 << 61, 3)
    row = spark.range(1).select(*(F.struct(*op).alias(n) for n, op in {"add": T.time_add(lit(1, 6), lit(1, 10)), "neg": T.time_sub(lit(1, 6), lit(2, 3)), "div": T.time_div(lit(1, 2), lit(-1, 4)), "none": T.time_div(lit(1, 2), lit(0, 4)), "zero": T.time_sub(lit(1, 2), lit(2, 4)), "big": T.time_mul(lit(*big), lit(3, 1 << 60))}.items()), T.time_less(lit(1, 3), lit(1, 2)).alias("less")).first()
    assert [tuple(row[k]) for k in ("add", "neg", "div", "zero", "big")] == [(4, 15), (-1, 2), (-2, 1), (0, 1), (2, 1)]
    assert row["none"][0] is None and row["less"]


def test_events_and_composites(spark):
    df = spark.range(6).select(F.col("id").alias("position"))
    assert [tuple(r) for r in C.events_at(df, [4, 2]).orderBy("position").collect()] == [(0, 0, None), (1, 0, None), (2, 1, 2), (3, 1, 2), (4, 2, 4), (5, 2, 4)]
    grey = lambda w, h, v: ("grey8", w, h, [bytes([v] * (w * h))])
    rows = [(0, grey(8, 4, 10), grey(2, 2, 200)), (1, grey(8, 4, 10), None), (2, None, grey(2, 2, 200))]
    clip = spark.createDataFrame(rows, f"position long, back {I.IMAGE}, over {I.IMAGE}")
    for mode, w, h in (("fill", 4, 4), ("smart", 8, 4), ("letter", 8, 4), ("pillar", 4, 4), ("native", 2, 2), ("corrected", 2, 2), ("distort", 8, 4)):
        got = {r["position"]: r["out"] for r in I.composite(clip, "back", "over", "out", mode, target=(8, 4)).collect()}
        pixels = np.frombuffer(got[0]["planes"][0], np.uint8).reshape(4, 8)
        assert (pixels == 200).sum() == w * h and (pixels[(4 - h) // 2 : (4 + h) // 2, (8 - w) // 2 : (8 + w) // 2] == 200).all(), mode
        assert bytes(got[1]["planes"][0]) == bytes([10] * 32) and got[2] is None
