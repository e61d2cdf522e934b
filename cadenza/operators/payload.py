"""Operators on a row's own columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(parameter: str | float, columns: list[str], default: float | None = None) -> Column:
    """An operator's parameter: a number, or the name of a column to take it from row by row."""
    if isinstance(parameter, str):
        return F.coalesce(F.col(parameter), F.lit(default)) if parameter in columns else F.lit(default)
    return F.lit(parameter)


def lerp(position: Column, length: int, spec: str) -> Column:
    """lower[:upper[:in[:out]]] over a clip of this length; in and out are inclusive, negative from the end.

    Two numbers move evenly from in to out, one is constant there; null outside. A word instead of
    numbers, word[:in[:out]], is constant. in = out gives lower.
    """
    parts = spec.split(":")
    numbers = []
    for x in parts:
        try:
            numbers.append(float(x))
        except ValueError:
            break
    if not numbers:
        value: Column = F.lit(parts[0])
        bounds = [int(x) for x in parts[1:3]]
    elif len(numbers) == 1:
        value, bounds = F.lit(numbers[0]), []
    else:
        value, bounds = None, [int(x) for x in numbers[2:4]]
    a, b = (bounds + [0, -1][len(bounds) :])[:2]
    a, b = (length + a if a < 0 else a), (length + b if b < 0 else b)
    q = position % length
    if value is None:
        low, high = numbers[:2]
        value = F.lit(low) + (q - a) / F.lit(float(b - a)) * (high - low) if a != b else F.lit(low)
    return F.when(q.between(a, b), value)


def lerp_segments(position: Column, length: int, specs: dict[str, str]) -> Column:
    """Several specs by sorted key; where more apply, the last key wins."""
    return F.coalesce(*(lerp(position, length, specs[k]) for k in sorted(specs, reverse=True)))


def bezier(position: Column, length: int, points: list[tuple[float, float]], first: int = 0, out: int = -1) -> tuple[Column, Column]:
    """x and y of a cubic curve of four points, from first to out (inclusive); null outside."""
    a, b = (length + first if first < 0 else first), (length + out if out < 0 else out)
    q = position % length
    t = (q - a) / F.lit(float(max(b - a, 1)))
    u = 1 - t
    curve = lambda k: u * u * u * points[0][k] + 3 * u * u * t * points[1][k] + 3 * u * t * t * points[2][k] + t * t * t * points[3][k]
    return F.when(q.between(a, b), curve(0)), F.when(q.between(a, b), curve(1))


def sar(df: DataFrame, num: int = 59, den: int = 54) -> DataFrame:
    """Another sample aspect ratio."""
    return df.withColumns({"sar_num": F.lit(num), "sar_den": F.lit(den)})


def remove(df: DataFrame, component: str) -> DataFrame:
    """A component set to null; an unknown one is an error."""
    if component not in df.columns:
        raise ValueError(f"no component {component}")
    return df.withColumn(component, F.lit(None).cast(df.schema[component].dataType))


def evaluate(df: DataFrame, path: str) -> DataFrame:
    """df computed into a table at path and read from there, so that what follows doesn't compute it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_once(df: DataFrame, path: str, key: str = "position") -> DataFrame:
    """Add the positions that the table at path doesn't have yet, each once, and pass df through."""
    fresh = df.dropDuplicates([key])
    try:
        kept = df.sparkSession.read.schema(df.schema).parquet(path).select(key)
    except AnalysisException:  # no table yet
        kept = None
    (fresh if kept is None else fresh.join(kept, key, "left_anti")).write.mode("append").parquet(path)
    return df


def geometry(mode: str, src: tuple[Column, Column], target: tuple[int, int], src_sar: tuple[int, int] = (1, 1), dst_sar: tuple[int, int] = (1, 1), area: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> dict[str, Column]:
    """How a source of a size fits a target: w, h placed at x, y; cx, cy, cw, ch what is cut of the source.

    fill covers with both in sight, smart covers wholly, letter fits the width, pillar the height, native
    keeps the size, corrected keeps it in square samples, distort stretches. area is the part of the target, as shares (x, y, w, h).
    """
    sw, sh = (c.cast("long") for c in src)
    x0, y0, W, H = (int(full * share) for full, share in zip((*target, *target), area, strict=True))
    (ssn, ssd), (dsn, dsd) = (tuple(x if x > 0 else 1 for x in p) for p in (src_sar, dst_sar))
    letter_h = F.floor(F.lit(W) * sh * ssd * dsn / (sw * ssn * dsd))
    pillar_w = F.floor(F.lit(H) * sw * ssn * dsd / (sh * ssd * dsn))
    size = {
        "fill": (F.when(pillar_w <= W, pillar_w).otherwise(W), F.when(pillar_w <= W, H).otherwise(letter_h)),
        "smart": (F.when(pillar_w >= W, pillar_w).otherwise(W), F.when(pillar_w >= W, H).otherwise(letter_h)),
        "letter": (F.lit(W), letter_h),
        "pillar": (pillar_w, F.lit(H)),
        "native": (sw, sh),
        "corrected": (F.floor(sw * (ssn * dsd) / F.lit(float(ssd * dsn)) + 0.5), sh),
        "distort": (F.lit(W), F.lit(H)),
    }[mode]
    out: dict[str, Column] = {}
    for axis, dim, full, limit, own, first in (("x", "w", size[0], W, sw, x0), ("y", "h", size[1], H, sh, y0)):
        full = full.cast("long")
        over = full > limit
        diff = (full - limit) / full.cast("double")
        out[axis] = (F.lit(first) + F.when(over, 0).otherwise(F.floor((F.lit(limit) - full) / 2))).cast("long")
        out[dim] = F.when(over, limit).otherwise(full).cast("long")
        out["c" + axis] = F.when(over, F.floor(own * diff / 2)).otherwise(0).cast("long")
        out["c" + dim] = F.when(over, F.floor(own * (1 - diff))).otherwise(own).cast("long")
    return out


def crop(width: Column, height: Column, rx: float, ry: float, rw: float, rh: float, absolute: bool = False) -> dict[str, Column]:
    """The rectangle cut out, in pixels, from relative (or absolute) geometry, kept inside the image."""
    part = lambda r, full: F.lit(int(r)) if absolute else F.floor(full * r)
    x, y = F.greatest(F.lit(0), F.least(part(rx, width), width)), F.greatest(F.lit(0), F.least(part(ry, height), height))
    return {"x": x.cast("long"), "y": y.cast("long"), "w": F.least(part(rw, width), width - x).cast("long"), "h": F.least(part(rh, height), height - y).cast("long")}
