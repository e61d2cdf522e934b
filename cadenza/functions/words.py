"""The scalar words of graph scripts as column functions: double arithmetic, loose comparison, packs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def add(a: Column, b: Column) -> Column:
    return _d(a) + _d(b)


def sub(a: Column, b: Column) -> Column:
    return _d(a) - _d(b)


def mul(a: Column, b: Column) -> Column:
    return _d(a) * _d(b)


def div(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives an infinity, 0 / 0 NaN."""
    a, b = _d(a), _d(b)
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), float("nan")).otherwise(F.signum(a) * float("inf"))).otherwise(a / F.nullif(b, F.lit(0.0)))


def power(a: Column, b: Column) -> Column:
    return F.pow(_d(a), _d(b))


def mod(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; NaN by zero."""
    return F.when(_d(b) == 0, float("nan")).otherwise(_d(a) % F.nullif(_d(b), F.lit(0.0)))


def absolute(a: Column) -> Column:
    return F.abs(_d(a))


def sin(a: Column) -> Column:
    return F.sin(_d(a))


def cos(a: Column) -> Column:
    return F.cos(_d(a))


def tan(a: Column) -> Column:
    return F.tan(_d(a))


def floor(a: Column) -> Column:
    return _d(F.floor(_d(a)))


def ceil(a: Column) -> Column:
    return _d(F.ceil(_d(a)))


def compare(a: Column, op: str, b: Column) -> Column:
    """1 or 0: texts that are both numbers compare as numbers, others as text."""
    x, y = a.cast("string"), b.cast("string")
    nx, ny = x.try_cast("double"), y.try_cast("double")
    test: dict[str, Callable] = {"=": lambda p, q: p == q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}
    return F.when(nx.isNotNull() & ny.isNotNull(), test[op](nx, ny)).otherwise(test[op](x, y)).cast("int")


def between(x: Column, low: Column, high: Column) -> Column:
    return (x.between(low, high)).cast("int")


def pack_get(pack: Column, k: int) -> Column:
    """Element k, from the end if negative; null outside."""
    return F.try_element_at(pack, F.lit(k + 1 if k >= 0 else k))


def pack_append(pack: Column, x: Column) -> Column:
    return F.array_append(pack, x)


def pack_insert(pack: Column, k: int, x: Column) -> Column:
    return F.array_insert(pack, k + 1 if k >= 0 else k, x)


def pack_remove(pack: Column, k: int) -> Column:
    n = F.size(pack)
    at = F.lit(k) if k >= 0 else n + k
    return F.filter(pack, lambda _, i: i != at)


def pack_sum(pack: Column) -> Column:
    return F.aggregate(pack, F.lit(0.0), lambda s, x: s + x.cast("double"))


def pack_average(pack: Column) -> Column:
    return F.when(F.size(pack) > 0, pack_sum(pack) / F.size(pack))


def properties_matching(columns: list[str], pattern: str) -> list[str]:
    """The property names that a regular expression finds, in order."""
    return sorted(c for c in columns if re.search(pattern, c))


def unfold_properties(columns: dict[str, str]) -> Column:
    """An array of (name, type, value as text) of a row's properties by name; debug and hidden ones (with a leading dot) are left out."""
    shown = sorted(n for n in columns if n != "debug" and not n.startswith("."))
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(columns[n]).alias("type"), F.col(n).cast("string").alias("value")) for n in shown))


def matches_all(conditions: list[Column]) -> Column:
    """An aggregate: 1 if every row meets all conditions."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return F.bool_and(F.coalesce(out, F.lit(False))).cast("int")
