"""Clips that are made, not read: colour, silence, tone, test picture, nothing."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.text import to_yuv
from cadenza.functions.timecode import samples_for_frame
from cadenza.model import Clip


def colour(spark: SparkSession, rows: int, r: int = 0, g: int = 0, b: int = 0, a: int = 255, width: int = 720, height: int = 576, fps: tuple[int, int] = (25, 1), sar: tuple[int, int] = (59, 54)) -> Clip:
    """One colour. The source is endless, so the number of rows wanted is given."""
    df = spark.range(rows).select(F.col("id").alias("position"), *(F.lit(v).alias(k) for k, v in (("r", r), ("g", g), ("b", b), ("a", a), ("width", width), ("height", height), ("sar_num", sar[0]), ("sar_den", sar[1]))))
    return Clip(df.withColumns(to_yuv(F.col("r"), F.col("g"), F.col("b"))), rows, fps)


def silence(spark: SparkSession, rows: int, frequency: int = 48000, channels: int = 2, fps: tuple[int, int] = (25, 1), profile: str = "dv") -> Clip:
    """Zeros, as many as each frame has; without channels the audio is null."""

    def made(position: Column) -> dict[str, Column]:
        n = samples_for_frame(position, frequency, fps, profile)
        data = F.array_repeat(F.lit(0.0), (n * channels).cast("int")) if channels else F.lit(None).cast("array<double>")
        return {"samples": n if channels else F.lit(0).cast("long"), "audio": data}

    return Clip(spark.range(rows).select(F.col("id").alias("position")).withColumns(made(F.col("position"))), rows, fps, made)


def tone(spark: SparkSession, rows: int = 250, periods: float = 16.0, peak: float = 1.0, frequency: int = 48000, channels: int = 2, fps: tuple[int, int] = (25, 1)) -> Clip:
    """sin(periods * 2 * 3.1415 * i / samples) * peak in every frame; 3.1415 is a fixed value."""
    n = samples_for_frame(F.col("id"), frequency, fps)
    wave = F.transform(F.sequence(F.lit(0), (n * channels - 1).cast("int")), lambda k: F.sin(periods * 2 * 3.1415 * F.floor(k / channels) / n) * peak)
    return Clip(spark.range(rows).select(F.col("id").alias("position"), n.alias("samples"), wave.alias("audio")), rows, fps)


def test_picture(spark: SparkSession, rows: int = 250, side: int = 512) -> Clip:
    """A grey ramp; level is that of the left edge of a row's picture."""
    df = spark.range(rows).select(F.col("id").alias("position"), F.lit(side).alias("width"), F.lit(side).alias("height"), (F.col("id") % 256).cast("int").alias("level"), (F.col("id") / 25.0).alias("pts"))
    return Clip(df, rows, (25, 1))


def nothing(spark: SparkSession, schema: str = "position long") -> Clip:
    return Clip(spark.createDataFrame([], schema), 0)
