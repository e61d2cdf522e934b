"""Tables as clips, and the decorator that registers a query with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.model import Clip


def registers(queries: dict, oracle: dict) -> Callable:
    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one of spark.checkpoint.dir; where that is unset (tests), in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-cadenza-")
    return f"{root.rstrip('/')}/cadenza-{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, *columns: str, fps: tuple[int, int] = (25, 1)) -> Clip:
    """The events as a clip; only the columns asked for are scanned."""
    columns = columns or ("value",)
    c = Clip.of(table(spark, sf_dir, "events"), "event_id", fps)
    return c.with_df(c.df.select("position", *columns))


def orders(spark: SparkSession, sf_dir: str, *columns: str) -> Clip:
    c = Clip.of(table(spark, sf_dir, "orders"), "o_orderkey")
    return c.with_df(c.df.select("position", *(columns or ("o_totalprice",))))


def stereo(spark: SparkSession, sf_dir: str) -> Clip:
    """The embeddings as two-channel blocks of 32 sample frames."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("audio"))
    return Clip.of(df, "vec_id")


def plane_sums(df: DataFrame, planes: int, column: str = "image") -> DataFrame:
    """position and, for each plane from 1, total and weighted: the sums of its samples and of samples times their place from 1; null where the plane is.

    In numpy: what Spark has to take a byte out of a string or a number out of its digits takes time with the square of a plane's size, or some hundred instructions a sample.
    """

    def summed(plane: bytes | None) -> list[int | None]:
        if plane is None:
            return [None, None]
        x = np.frombuffer(plane, np.uint8).astype(np.int64)
        return [int(x.sum()), int(x @ np.arange(1, len(x) + 1))]

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([None if image is None else [n for k in range(planes) for n in summed(image[k])] for image in series], dtype=object)

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    names = [f"{what}{k}" for k in range(1, planes + 1) for what in ("total", "weighted")]
    sums = df.select("position", F.pandas_udf(work, "array<long>")(F.col(column).getField("planes")).alias("_sums"))
    return sums.select("position", *(F.get("_sums", F.lit(k)).alias(n) for k, n in enumerate(names)))
