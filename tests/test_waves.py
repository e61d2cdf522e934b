"""Pictures of samples against drawing pixel by pixel, and the operators' odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.model import Clip
from cadenza.operators import image as I
from cadenza.operators import reindex as R
from cadenza.operators import waves as V


def half(x):
    return int(x / 2)  # toward zero


def drawn_lines(samples, width, height, split):
    planes = [[[c] * (width if k == 0 else width // 2) for _ in range(height if k == 0 else height // 2)] for k, c in enumerate((16, 128, 128))]
    channels = len(samples[0])
    parts = channels if split else 1
    for i in range(width):
        for j in range(channels):
            level = int(samples[int(len(samples) / width * i)][j] / 32769.0 * (height // (2 * parts)))
            red = j % 2 == 0 if split else j == 0
            for k, colour in enumerate((81, 90, 240) if red else (234, 128, 128)):
                small = 2 if k else 1
                column = i // small
                middle = height // (2 * parts * small) + (j * (height // (parts * small)) if split else 0)
                end = -(half(level) if k else level)
                start = 1 if column == 0 else 0
                for r in range(min(start, end), max(start, end) + 1):
                    if 0 <= middle + r < len(planes[k]):
                        planes[k][middle + r][column] = 128 + half(planes[k][middle + r][column] + colour - 256)
    return planes


def drawn_dots(samples, width, height, scattered):
    out = np.zeros((3, height, width), int)
    channels = len(samples[0])
    for j in range(channels):
        x, y, w, h = 0, 0, width, height
        if scattered:
            rows = (channels + 1) // 2 if channels > 2 else channels
            w, h = (width // 2 if channels > 2 else width), height // rows
            x, y = (0, j * h) if j < rows else (w, (j - rows) * h)
        for i in range(w):
            level = int(samples[int(len(samples) / w * i)][j] / 32767.0 * (h // 2))
            row = min(max(y + h // 2 - level, 0), height - 1)
            out[:, row, x + i] = (255, 0, 0) if j == 0 else (0, 255, 0)
    return out


@pytest.mark.parametrize("channels", [1, 2, 3, 5])
def test_pixel_by_pixel(channels):
    rng = np.random.default_rng(channels)
    samples = rng.integers(-32768, 32768, (50, channels))
    samples[:3] = [[-32768] * channels, [0] * channels, [32767] * channels]
    for flag in (False, True):
        size = (24, 4 * channels * 4)
        got = V.lines(samples.astype(float), *size, split=flag)
        assert [p.tolist() for p in got] == drawn_lines(samples.tolist(), *size, flag)
        got = V.dots(samples.astype(float), *size, scattered=flag)
        assert (np.array(got) == drawn_dots(samples.tolist(), *size, flag)).all()


def test_odd_rows(spark):
    picture = ("rgb24p", 1, 1, [b"a", b"b", b"c"])
    rows = [(0, [], None), (1, None, None), (2, [100, -100, 5], None), (3, [1, 2], picture), (4, None, None), (5, [7, 8], None)]
    df = spark.createDataFrame(rows, f"position long, audio array<int>, image {I.IMAGE}")
    shape = lambda **more: {r["position"]: r["image"] and (r["image"]["pf"], r["image"]["width"]) for r in V.waves(df, "audio", "image", 2, 8, 8, **more).collect()}
    new, own = ("yuv420p", 8), ("rgb24p", 1)
    assert shape() == {0: new, 1: None, 2: new, 3: own, 4: own, 5: own}
    assert shape(hold=False) == {0: new, 1: None, 2: new, 3: own, 4: None, 5: new}
    assert shape(force=True) == {0: new, 1: None, 2: new, 3: new, 4: None, 5: new}
    bare = V.waves(df.drop("image"), "audio", "image", 2, 8, 8, "rgb24p", scattered=True, reverse=True)
    assert bare.where("image is not null").count() == 4 and V.waves(df.limit(0), "audio", "image").count() == 0


def test_reverse_draws_backwards(spark):
    there = spark.createDataFrame([(0, [20000, 2, 30000, -30000, 500, 9])], "position long, audio array<int>")
    back = spark.createDataFrame([(0, [500, 9, 30000, -30000, 20000, 2])], "position long, audio array<int>")
    one = lambda df, r: V.waves(df, "audio", "image", 2, 9, 16, "rgb24p", reverse=r).first()["image"]
    assert one(there, True) == one(back, False) != one(there, False)


def test_transport_and_hold_of_odd_clips(spark):
    clip = Clip(spark.range(3).select(F.col("id").alias("position"), F.array("id").alias("audio")), 3, (25, 1))
    mute = lambda **k: [r["audio"] for r in R.transport(clip, audio="audio", **k).df.orderBy("position").collect()]
    assert mute(start=0, speed=1, rows=4) == [[0], [1], [2], [0]]
    assert mute(start=1, speed=0, rows=2) == [None, None]
    assert mute(start=0, speed=3, rows=3) == [[0], None, None]  # around the clip to the same row
    assert mute(start=0, speed=1, rows=2, silence=True) == [None, None]
    picture = ("yuv444p", 1, 3, [bytes([0, 9, 4])] * 3)
    df = spark.createDataFrame([(0, picture, 1), (1, None, 2), (2, picture, None)], f"position long, image {I.IMAGE}, field_order int")
    held = lambda k: [r["image"] and r["image"]["planes"][0] for r in R.hold(Clip(df, 3, (25, 1)), k, 1, image="image").df.orderBy("position").collect()]
    own, still = bytes([0, 9, 4]), bytes([0, 2, 4])
    assert held(0) == [still, own, None, own] and held(1) == [own, None, None, own] and held(2) == [own, None, own, own]


def test_alpha_and_sizes(spark):
    four, grey, wide = ("yuva444p", 2, 1, [b"ab"] * 4), ("grey8", 2, 1, [b"xy"]), ("grey8", 3, 1, [b"xyz"])
    rows = [(four, grey), (four, wide), (four, None), (grey, grey), (None, grey)]
    df = spark.createDataFrame(rows, f"image {I.IMAGE}, alpha {I.IMAGE}")
    got = [r["image"] and [bytes(p) for p in r["image"]["planes"]] for r in I.merge_alpha(df, "image", "alpha").collect()]
    assert got == [[b"ab", b"ab", b"ab", b"xy"], [b"ab"] * 4, [b"ab"] * 4, [b"xy"], None]
    p = [np.arange(4, dtype=np.uint8).reshape(1, 2, 2)]
    assert I.distort(2, 2)(p, "grey8")[0] is p and I.distort(3, 5)(p, "grey8")[0][0].shape == (1, 5, 3)
