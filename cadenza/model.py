"""A clip: a DataFrame with a dense position column, its length and its frame rate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clip:
    """Rows with position 0 .. length-1. The length is known to the driver, so bounds are literals in plans.

    made: columns of df that follow from the position alone, as a function of it; joins may leave them out and make them afterwards.
    """

    df: DataFrame
    length: int
    fps: tuple[int, int] = (25, 1)
    made: Callable[[Column], dict[str, Column]] | None = field(default=None, compare=False)

    def __post_init__(self):
        k = gcd(*self.fps) or 1
        object.__setattr__(self, "fps", (self.fps[0] // k, self.fps[1] // k))

    @classmethod
    def of(cls, df: DataFrame, key: str, fps: tuple[int, int] = (25, 1)) -> Clip:
        """A table whose column key is dense from 0. Counting a Parquet table reads its footers only."""
        return cls(df.withColumn("position", F.col(key).cast("long")), df.count(), fps)

    def with_df(self, df: DataFrame, length: int | None = None, fps: tuple[int, int] | None = None) -> Clip:
        return replace(self, df=df, length=self.length if length is None else length, fps=fps or self.fps, made=None)

    def transform(self, op, *args, **kwargs) -> Clip:
        """op(self, ...), to chain operators."""
        return op(self, *args, **kwargs)

    def fetch(self, position: int) -> DataFrame:
        """The row at a position; a negative one counts from the end, one past the end is the last row."""
        at = position + self.length if position < 0 else position
        return self.df.where(F.col("position") == min(max(at, 0), max(self.length - 1, 0)))
