"""Intervals (start, duration) on an axis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[Column, Column]


def intersection(a: Span, b: Span) -> Column:
    """struct(start, duration), null where they don't meet."""
    start = F.greatest(a[0], b[0])
    end = F.least(a[0] + a[1], b[0] + b[1])
    return F.when(end > start, F.struct(start.alias("start"), (end - start).alias("duration")))


def union(a: Span, b: Span) -> Column:
    """The span that holds both, null where a gap is between them."""
    start, end = F.least(a[0], b[0]), F.greatest(a[0] + a[1], b[0] + b[1])
    return F.when(F.greatest(a[0], b[0]) <= F.least(a[0] + a[1], b[0] + b[1]), F.struct(start.alias("start"), (end - start).alias("duration")))


def subtraction(a: Span, b: Span) -> Column:
    """An array of the none, one or two spans of a outside b."""
    a_end, b_end = a[0] + a[1], b[0] + b[1]
    left = F.struct(a[0].alias("start"), (F.least(a_end, b[0]) - a[0]).alias("duration"))
    right_start = F.greatest(a[0], b_end)
    right = F.struct(right_start.alias("start"), (a_end - right_start).alias("duration"))
    return F.filter(F.array(left, right), lambda s: s["duration"] > 0)


def holds(a: Span, point: Column) -> Column:
    return (point >= a[0]) & (point < a[0] + a[1])


def out_before_in(a: Span, b: Span) -> Column:
    """a ends at or before b's start."""
    return a[0] + a[1] <= b[0]


def in_before_out(a: Span, b: Span) -> Column:
    """a starts before b's end."""
    return a[0] < b[0] + b[1]


def trim(a: Span, b: Span) -> Column:
    """a cut to b; of duration 0 at the nearer edge if they don't meet."""
    start = F.least(F.greatest(a[0], b[0]), b[0] + b[1])
    end = F.greatest(F.least(a[0] + a[1], b[0] + b[1]), start)
    return F.struct(start.alias("start"), (end - start).alias("duration"))
