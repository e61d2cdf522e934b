"""Pictures of a row's samples: each channel's dots, or lines from a middle line, in a picture of planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.image import IMAGE, drawn
from cadenza.operators.windows import last_seen

# Colours as Y, U and V.
BLACK = (16, 128, 128)
RED = (81, 90, 240)
WHITE = (234, 128, 128)


def _levels(samples: np.ndarray, width: int, full: float, half: int) -> np.ndarray:
    """The sample of each column of the picture as whole lines above the middle, a column of the result for each channel."""
    at = (samples.shape[-2] / width * np.arange(width)).astype(int)
    return np.trunc(samples[..., at, :] / full * half).astype(int)


def dots(samples: np.ndarray, width: int, height: int, scattered: bool = False) -> list[np.ndarray]:
    """Planes R, G and B with a dot a column for each channel of samples (n, channels, or of several rows): the first is red, the others are green over it.

    scattered: each channel has a part of the picture of its own; up to two lie one below the other, more in two columns.
    """
    first, (n, channels) = samples.shape[:-2], samples.shape[-2:]
    samples = samples.reshape(int(np.prod(first)), n, channels)
    out = np.zeros((3, len(samples), height, width), np.uint8)
    down = (channels + 1) // 2 if channels > 2 else channels
    w, h = (width // 2 if channels > 2 else width, height // down) if scattered else (width, height)
    if n and w and h:
        level = _levels(samples, w, 32767.0, h // 2)
        for j in range(channels):
            right, below = divmod(j, down) if scattered else (0, 0)
            line = np.clip(below * h + h // 2 - level[..., j], 0, height - 1)
            out[:, np.arange(len(samples))[:, None], line, right * w + np.arange(w)] = np.array([0 if j else 255, 255 if j else 0, 0])[:, None, None]
    return list(out.reshape(3, *first, height, width))


def lines(samples: np.ndarray, width: int, height: int, split: bool = False) -> list[np.ndarray]:
    """Planes Y, U and V (4:2:0) with a line a column for each channel from the middle to its sample, mixed half with what is there.

    The first channel is red and the others are white; split: the channels lie one below the other, red and white by turns
    (the height should divide by four times their number). The first column's lines start one below the middle.
    """
    shapes = [(height, width)] + [(-(-height // 2), -(-width // 2))] * 2
    out = [np.full(s, c, np.int64) for s, c in zip(shapes, BLACK, strict=True)]
    channels = samples.shape[1]
    if not len(samples):
        return [x.astype(np.uint8) for x in out]
    parts = channels if split else 1
    level = _levels(samples, width, 32769.0, height // (2 * parts))
    for odd in (0, 1):  # two columns share one of the chroma planes: the left one comes first
        x = np.arange(odd, width, 2)
        for j in range(channels):
            colour = RED if j == 0 or (split and j % 2 == 0) else WHITE
            for k, plane in enumerate(out):
                small = 2 if k else 1
                place = x // small
                middle = height // (2 * parts * small) + (j * (height // (parts * small)) if split else 0)
                end, start = -np.trunc(level[x, j] / small).astype(int), np.where(place == 0, 1, 0)
                row = np.arange(len(plane))[:, None] - middle
                on = (row >= np.minimum(start, end)) & (row <= np.maximum(start, end))
                own = plane[:, place]
                plane[:, place] = np.where(on, 128 + np.fix((own + colour[k] - 256) / 2).astype(int), own)
    return [x.astype(np.uint8) for x in out]


def waves(df: DataFrame, audio: str, image: str, channels: int = 2, width: int = 640, height: int = 480, pf: str = "yuv420p", split: bool = False, scattered: bool = False, reverse: bool = False, hold: bool = True, force: bool = False) -> DataFrame:
    """Give rows without an image one of their samples (16-bit whole numbers, channels by turns).

    pf yuv420p draws lines (split: channel below channel), rgb24p dots (scattered: a part for each channel). hold: a row after one
    that has an image gets the last such image instead. force: all rows with samples get a picture of them. reverse draws
    the samples backwards (not where split). Rows without samples and image stay without.
    """
    if pf not in ("yuv420p", "rgb24p"):
        raise ValueError(pf)

    def planes(x: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1] // channels
        s = x[:, : n * channels].reshape(len(x), n, channels)
        s = s[:, ::-1] if reverse and not split else s
        return dots(s, width, height, scattered) if pf == "rgb24p" else [np.stack(p) for p in zip(*(lines(r, width, height, split) for r in s), strict=True)]

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            yield drawn(series, pf, width, height, planes)

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    hold = hold and not force and image in df.columns  # else there is none to hold, and rows stay where they are
    df = df if image in df.columns else df.withColumn(image, F.lit(None).cast(IMAGE))
    rows = last_seen(df, image, "_held") if hold else df.withColumn("_held", F.col(image))
    wanted = F.when(F.lit(True) if force else F.col("_held").isNull(), F.col(audio))  # only these are drawn
    rows = rows.withColumn("_drawn", F.when(wanted.isNotNull(), F.pandas_udf(work, IMAGE)(wanted)))
    first, then = ("_drawn", image) if force else ("_held", "_drawn")
    return rows.withColumn(image, F.coalesce(first, then)).drop("_held", "_drawn")
