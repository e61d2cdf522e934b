"""Folds over a clip in the order of its positions, in parallel: each bucket as one step, a scan over buckets, then each bucket from its own start.

A fold step is a map of a state; the map of a whole bucket is the composition of its steps. Where such compositions have a small form (affine maps:
two numbers; maps of a few states: as many numbers) buckets are composed independently, the compositions are scanned in levels of wide buckets each, and each bucket then
runs from the state before it. No task has more than a bucket or a level's wide summaries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Steps:
    """What a fold is made of, in arrays of one bucket in order.

    summary: the composition of a bucket's rows; then(a, b): a, then b; run: the values at each row from a composition that leads to the bucket, and the first state.
    """

    summary: Callable[[pd.DataFrame], np.ndarray]
    then: Callable[[np.ndarray, np.ndarray], np.ndarray]
    run: Callable[[np.ndarray, pd.DataFrame], np.ndarray]
    identity: np.ndarray


def affine(factor: str | float, plus: str, first: float = 0.0) -> Steps:
    """y = factor * y before + plus, a first-order filter: factor is a number or a column, plus a column; nulls keep y."""

    def terms(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        b = rows[plus].to_numpy(float)
        a = rows[factor].to_numpy(float) if isinstance(factor, str) else np.full(len(b), float(factor))
        known = ~(np.isnan(a) | np.isnan(b))
        return np.where(known, a, 1.0), np.where(known, b, 0.0)

    def walked(y: float, rows: pd.DataFrame) -> np.ndarray:
        out = np.empty(len(rows))
        for k, (a, b) in enumerate(zip(*(x.tolist() for x in terms(rows)), strict=True)):
            y = a * y + b
            out[k] = y
        return out

    def summary(rows: pd.DataFrame) -> np.ndarray:
        return np.array([np.prod(terms(rows)[0]), walked(0.0, rows)[-1]])

    return Steps(summary, lambda a, b: np.array([a[0] * b[0], b[0] * a[1] + b[1]]), lambda s, rows: walked(s[0] * first + s[1], rows), np.array([1.0, 0.0]))


def machine(states: int, symbol: str, table: list[list[int]], first: int = 0) -> Steps:
    """A machine of few states: table has, by symbol and state, the next state; a null or another symbol keeps it."""
    moves = np.array([*table, list(range(states))], np.int64)

    def symbols(rows: pd.DataFrame) -> list[int]:
        known = rows[symbol].to_numpy(float)
        return np.where((known >= 0) & (known < len(table)), known, len(table)).astype(int).tolist()

    def summary(rows: pd.DataFrame) -> np.ndarray:
        at = np.arange(states)
        for k in symbols(rows):
            at = moves[k][at]
        return at.astype(float)

    def run(s: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        at, out = int(s[first]), np.empty(len(rows))
        for k, x in enumerate(symbols(rows)):
            at = moves[x][at]
            out[k] = at
        return out

    return Steps(summary, lambda a, b: b[a.astype(int)], run, np.arange(states, dtype=float))


def _leading(summaries: DataFrame, count: int, steps: Steps, wide: int) -> DataFrame:
    """_b and s of summaries, with s the composition of all smaller _b."""

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows, at, out = rows.sort_values("_b"), steps.identity, []
        for s in rows["s"]:
            out.append(at.tolist())
            at = steps.then(at, np.asarray(s, float))
        return pd.DataFrame({"_b": rows["_b"].to_numpy(), "s": out})

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = steps.identity
        for s in rows.sort_values("_b")["s"]:
            at = steps.then(at, np.asarray(s, float))
        return pd.DataFrame({"_b": [key[0]], "s": [at.tolist()]})

    upper = F.expr(f"_b div {wide}")
    inside = summaries.groupBy(upper).applyInPandas(within, "_b long, s array<double>")
    if count <= wide:
        return inside
    totals = summaries.groupBy(upper.alias("_u")).applyInPandas(total, "_b long, s array<double>")
    above = _leading(totals, -(-count // wide), steps, wide).select(F.col("_b").alias("_u"), F.col("s").alias("_above"))

    def joined(batches):
        for rows in batches:
            yield pd.DataFrame({"_b": rows["_b"], "s": [steps.then(np.asarray(a, float), np.asarray(s, float)).tolist() for a, s in zip(rows["_above"], rows["s"], strict=True)]})

    return inside.withColumn("_u", upper).join(above, "_u").select("_b", "s", "_above").mapInPandas(joined, "_b long, s array<double>")


def folded(df: DataFrame, length: int, steps: Steps, columns: list[str], name: str, bucket: int = 1 << 14, wide: int = 4096) -> DataFrame:
    """position and name (double): the fold's value at each row of a clip. columns are those that the steps read; positions may have gaps."""
    rows = df.select("position", *columns).withColumn("_b", F.expr(f"position div {bucket}"))

    def summed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_b": [key[0]], "s": [steps.summary(part.sort_values("position")).tolist()]})

    def ran(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        return pd.DataFrame({"position": part["position"].to_numpy(), name: steps.run(np.asarray(part["_s"].iloc[0], float), part)})

    summaries = rows.groupBy("_b").applyInPandas(summed, "_b long, s array<double>")
    lead = _leading(summaries, -(-length // bucket), steps, wide).select(F.col("_b").alias("_c"), F.col("s").alias("_s"))
    return rows.join(lead, F.col("_b") == F.col("_c")).drop("_c").groupBy("_b").applyInPandas(ran, f"position long, `{name}` double")
