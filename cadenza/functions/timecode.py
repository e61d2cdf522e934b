"""Timecode, exact seconds and audio cadence as integer column expressions."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.bind import let

#: name: (frames a second as counted, exact rate, frames dropped a minute when drop-frame)
RATES = {"movie": (24, (24, 1), 0), "pal": (25, (25, 1), 0), "ntsc": (30, (30000, 1001), 2), "pal_50": (50, (50, 1), 0), "ntsc_60": (60, (60000, 1001), 4)}


def _div(a: Column, b: int | Column) -> Column:
    """Integer quotient of a column that is not negative."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def to_timecode(frame: Column, rate: str, drop: bool = False) -> dict[str, Column]:
    """h, m, s and f of a frame; wraps after 24 hours. Drop-frame skips 2 (4 at 60) numbers a minute, except each tenth."""
    r, _, d = RATES[rate]
    n = frame.cast("long")
    if drop and d:
        ten, minute = 600 * r - 9 * d, 60 * r - d
        n = n % (144 * ten)
        q, x = _div(n, ten), n % ten
        m = F.when(x < d, 0).otherwise(_div(x - d, minute))
        n = n + (9 * q + m) * d
    n = n % (86400 * r)
    return {"h": _div(n, 3600 * r), "m": _div(n, 60 * r) % 60, "s": _div(n, r) % 60, "f": n % r}


def from_timecode(h: Column, m: Column, s: Column, f: Column, rate: str, drop: bool = False) -> Column:
    r, _, d = RATES[rate]
    total = ((h * 60 + m) * 60 + s).cast("long") * r + f
    minutes = (h * 60 + m).cast("long")
    return total - d * (minutes - _div(minutes, 10)) if drop and d else total


def convert_frames(frame: Column, src: tuple[int, int], dst: tuple[int, int]) -> Column:
    """A number of frames at another rate, rounded down."""
    a, b = dst[0] * src[1], dst[1] * src[0]
    k = gcd(a, b)
    return _div(frame.cast("long") * (a // k), b // k)


def seconds(frame: Column, fps: tuple[int, int]) -> dict[str, Column]:
    """Exact seconds as num and den (not reduced)."""
    return {"num": frame.cast("long") * fps[1], "den": F.lit(fps[0]).cast("long")}


def common_divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor of two longs by Euclid's steps, which are at most 92 for them; 1 of zeros."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b")))
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    return F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"]), F.lit(1).cast("long"))


def reduced(num: Column, den: Column) -> tuple[Column, Column]:
    """An exact time in lowest terms, its denominator positive; a null where the denominator is zero."""
    num, den = (x.cast("decimal(38,0)") for x in (num, den))
    fits = F.greatest(F.abs(num), F.abs(den)) <= F.lit((1 << 63) - 1).cast("decimal(38,0)")
    n, d = F.when(fits, num).cast("long"), F.when(fits & (den != 0), den).cast("long")
    sign = F.when(d < 0, -1).otherwise(1)
    both = let(F.struct(n.alias("n"), d.alias("d"), sign.cast("long").alias("s")), lambda x: let(common_divisor(x["n"], x["d"]), lambda k: F.struct(_div(F.abs(x["n"]), k).alias("n"), _div(F.abs(x["d"]), k).alias("d"), (F.signum(x["n"].cast("double")) * x["s"]).cast("long").alias("s"))))
    return F.when(d.isNotNull(), both["n"] * both["s"]), both["d"]


Time = tuple[Column, Column]


def _times(a: Column, b: Column) -> Column:
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def time_add(a: Time, b: Time) -> Time:
    return reduced(_times(a[0], b[1]) + _times(b[0], a[1]), _times(a[1], b[1]))


def time_sub(a: Time, b: Time) -> Time:
    return reduced(_times(a[0], b[1]) - _times(b[0], a[1]), _times(a[1], b[1]))


def time_mul(a: Time, b: Time) -> Time:
    return reduced(_times(a[0], b[0]), _times(a[1], b[1]))


def time_div(a: Time, b: Time) -> Time:
    return reduced(_times(a[0], b[1]), _times(a[1], b[0]))


def time_less(a: Time, b: Time) -> Column:
    """Of times with positive denominators."""
    return _times(a[0], b[1]) < _times(b[0], a[1])


#: Samples a frame at 48 kHz where they follow a fixed cycle.
CYCLES = {
    ("mpeg", 30000, 1001): [1602, 1601, 1602, 1601, 1602],
    ("dv", 30000, 1001): [1600, 1602, 1602, 1602, 1602],
    ("mpeg", 60000, 1001): [800, 801, 801, 801, 801],
    ("dv", 60000, 1001): [800, 800, 801, 801, 801, 801, 801, 801, 801, 801],
    ("mpeg", 24000, 1001): [2002],
    ("dv", 24000, 1001): [2002],
}


def samples_for_frame(frame: Column, frequency: int, fps: tuple[int, int], profile: str = "") -> Column:
    """Samples of a frame: by the profile's cycle at 48 kHz, else by the difference of rounded starts."""
    cycle = CYCLES.get((profile, *fps)) if frequency == 48000 else None
    if cycle:
        return F.element_at(F.array(*map(F.lit, cycle)), (frame % len(cycle) + 1).cast("int")).cast("long")
    n, d = _reduced(frequency, fps)
    o = frame % d
    return _div((o + 1) * n, d) - _div(o * n, d)


def samples_to_frame(frame: Column, frequency: int, fps: tuple[int, int], profile: str = "") -> Column:
    """Samples before a frame, in closed form."""
    cycle = CYCLES.get((profile, *fps)) if frequency == 48000 else None
    if cycle:
        before = [sum(cycle[:k]) for k in range(len(cycle))]
        return _div(frame, len(cycle)) * sum(cycle) + F.element_at(F.array(*map(F.lit, before)), (frame % len(cycle) + 1).cast("int"))
    n, d = _reduced(frequency, fps)
    return _div(frame, d) * n + _div((frame % d) * n, d)


def frame_of_sample(sample: Column, frequency: int, fps: tuple[int, int]) -> Column:
    """The frame that holds a sample: the last whose start is not after it."""
    n, d = _reduced(frequency, fps)
    return _div((sample + 1) * d + n - 1, n) - 1


def _reduced(frequency: int, fps: tuple[int, int]) -> tuple[int, int]:
    n, d = frequency * fps[1], fps[0]
    k = gcd(n, d)
    return n // k, d // k
