"""Operators on interleaved sample arrays. All arithmetic is in double; sample order matters throughout."""

from __future__ import annotations

from math import exp, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.bind import let
from cadenza.functions.timecode import CYCLES, frame_of_sample, samples_to_frame

#: pcm24 is kept in 32 bits.
LARGEST = {"pcm16": (1 << 15) - 1, "pcm24": (1 << 31) - 1, "pcm32": (1 << 31) - 1, "float": 1.0}


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def _indexes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def mix(a: Column, b: Column, largest: float = 1.0) -> Column:
    """Two blocks into one: x + y + xy where both are negative, else x + y - xy, of samples over largest. Unequal sizes: null."""

    def one(x: Column, y: Column) -> Column:
        x, y = x.cast("double") / largest, y.cast("double") / largest
        return (F.when((x < 0) & (y < 0), x + y + x * y).otherwise(x + y - x * y)) * largest

    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, one))


def mix_all(layers: Column, largest: float = 1.0) -> Column:
    """The layers folded in their order; the rule is not associative, so the order must be given."""
    return F.aggregate(F.slice(layers, 2, F.greatest(F.size(layers) - 1, F.lit(0))), F.element_at(layers, 1), lambda s, x: mix(s, x, largest))


def mix_matrix(samples: Column, matrix: list[list[float]], low: float = -1.0, high: float = 1.0) -> Column:
    """matrix[input][output] applied to each sample; adding up saturates at every input. Identity: unchanged."""
    n_in, n_out = len(matrix), len(matrix[0])
    if any(len(r) != n_out for r in matrix):
        raise ValueError("the matrix has rows of different lengths")
    if n_in == n_out and all(abs(matrix[i][j] - (i == j)) < 1e-6 for i in range(n_in) for j in range(n_out)):
        return samples
    clamp = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))

    def mixed(x: Column) -> Column:
        def frame(i: Column) -> Column:
            outs = []
            for o in range(n_out):
                acc: Column = F.lit(0.0)
                for k in range(n_in):
                    acc = clamp(acc + _at(x, i * n_in + k) * matrix[k][o])
                outs.append(acc)
            return F.array(*outs)

        return F.flatten(F.transform(_indexes(F.floor(F.size(x) / n_in)), frame))

    return let(samples.cast("array<double>"), mixed)


#: Which inputs each output sums, for layouts L R (C LFE) (Ls Rs): by (inputs, outputs).
_SUMS = {(2, 1): [[0, 1]], (3, 1): [[0, 1, 2]], (4, 1): [[0, 1, 2, 3]], (6, 1): [[0, 1, 2, 3, 4, 5]], (1, 2): [[0], [0]], (6, 2): [[0, 2, 3, 4], [1, 2, 3, 5]]}


def smooth(samples: Column, channels: int = 1, taps: int = 13) -> Column:
    """The one-pole low-pass y = (1 - a) x + a y[-1] with a = exp(-pi), per channel, from rest.

    a to the 13th is under the precision of a double, so the recursion is a sum over 13 samples.
    """
    a = exp(-pi)

    def filtered(x: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            terms: Column = F.lit(0.0)
            for k in range(taps - 1, -1, -1):
                terms = terms + F.coalesce(_at(x, i - k * channels), F.lit(0.0)) * ((1 - a) * a**k)
            return terms

        return F.transform(x, one)

    return let(samples.cast("array<double>"), filtered)


def channel_convert(samples: Column, n_in: int, n_out: int, low: float = -1.0, high: float = 1.0) -> Column:
    """Sum channels to another layout, clip, low-pass. Equal counts: unchanged; pairs not in the table: channel k to k mod out."""
    if n_in == n_out:
        return samples
    sums = _SUMS.get((n_in, n_out)) or [[k for k in range(n_in) if k % n_out == o] for o in range(n_out)]

    def summed(x: Column) -> Column:
        frame = lambda i: F.array(*(F.greatest(F.lit(low), F.least(F.lit(high), sum((_at(x, i * n_in + k) for k in ks), F.lit(0.0)))) for ks in sums))
        return F.flatten(F.transform(_indexes(F.floor(F.size(x) / n_in)), frame))

    return smooth(let(samples.cast("array<double>"), summed), n_out)


def channel_extract(samples: Column, channels: int, channel: int) -> Column:
    return F.filter(samples, lambda _, i: i % channels == channel)


def channel_place(samples: Column, channels: int, channel: int) -> Column:
    """One channel into a silent block of several."""
    return F.flatten(F.transform(samples, lambda x: F.array(*(x.cast("double") if k == channel else F.lit(0.0) for k in range(channels)))))


def combine(blocks: list[Column]) -> Column:
    """Mono blocks interleaved; the shortest gives the length."""

    def woven(bound: Column) -> Column:
        parts = [bound[k] for k in range(len(blocks))]
        n = F.array_min(F.transform(bound, lambda b: F.size(b)))
        return F.flatten(F.transform(_indexes(n), lambda i: F.array(*(_at(b, i) for b in parts))))

    return let(F.array(*(b.cast("array<double>") for b in blocks)), woven)


def level(samples: Column, largest: float = 1.0) -> Column:
    """The largest absolute sample over the largest possible."""
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))) / largest


def channel_mixer(a: Column, b: Column, volumes: list[float], channels: int, low: float = -1.0, high: float = 1.0) -> Column:
    """A mono block b added to each channel of a by its volume (0 to 1), saturating; b is brought to a's length."""
    if any(not 0 <= v <= 1 for v in volumes) or len(volumes) != channels:
        raise ValueError("a volume from 0 to 1 is needed for each channel")
    gain = F.array(*map(F.lit, volumes))
    added = lambda y: F.transform(a, lambda x, i: F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double") + _at(y, F.floor(i / channels)) * _at(gain, i % channels))))
    return let(pitch(b, F.floor(F.size(a) / channels).cast("int")), added)


def locked(df: DataFrame, column: str, fps: tuple[int, int], profile: str = "dv", channels: int = 1, frequency: int = 48000) -> DataFrame:
    """Blocks brought to the fixed cadence of a profile (dv, imx), cycle by cycle.

    A cycle whose blocks have as many samples as the cadence is cut anew at its places; in any other each block
    is brought to its number of samples. Rates or frequencies without a cadence, and null audio, stay as they are.
    """
    cycle = CYCLES.get(({"imx": "mpeg"}.get(profile, profile), *fps)) if frequency == 48000 else None
    if not cycle or len(cycle) == 1:
        return df
    k = len(cycle)
    sizes = F.array(*map(F.lit, cycle))
    starts = F.array(*(F.lit(sum(cycle[:i])) for i in range(k)))
    block = F.col(column).cast("array<double>")
    groups = df.groupBy(F.expr(f"position div {k}").alias("_g")).agg(F.sort_array(F.collect_list(F.struct("position", block.alias("x")))).alias("_rows"))
    whole = F.flatten(F.transform(F.col("_rows"), lambda r: F.coalesce(r["x"], F.array().cast("array<double>"))))
    cut = groups.select(F.explode("_rows").alias("_r"), F.when((F.size(whole) == sum(cycle) * channels) & (F.size("_rows") == k), whole).alias("_whole"))
    at = (F.col("_r.position") % k).cast("int")
    n, start = F.get(sizes, at), F.get(starts, at)
    x = F.col("_r.x")
    new = F.when(F.col("_whole").isNotNull(), F.slice("_whole", start * channels + 1, n * channels)).when(F.size(x) == n * channels, x).otherwise(pitch(x, n, channels))
    made = cut.select(F.col("_r.position").alias("position"), F.when(x.isNotNull(), new).alias(column))
    return df.drop(column).join(made, "position") if len(df.columns) > 2 else made


def volume(samples: Column, start: float, end: float, channels: int = 1, low: float = -1.0, high: float = 1.0) -> Column:
    """A linear ramp of the gain over a block, clipped, then the low-pass (also at gain 1)."""
    n = F.greatest(F.floor(F.size(samples) / channels), F.lit(1))
    gained = F.transform(samples, lambda x, i: F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double") * (start + (end - start) * F.floor(i / channels) / n))))
    return smooth(gained, channels)


def pitch(samples: Column, required: int | Column, channels: int = 1) -> Column:
    """A block of another number of samples: the mean of the sample at i * ratio and the next; the last is copied."""
    required = F.lit(required) if isinstance(required, int) else required

    def resampled(x: Column) -> Column:
        n = F.floor(F.size(x) / channels)

        def one(k: Column) -> Column:
            i, ch = F.floor(k / channels), k % channels
            j = F.floor(i * (n.cast("double") / required))
            here = _at(x, j * channels + ch)
            following = _at(x, F.least(j + 1, n - 1) * channels + ch)
            return F.when(i == required - 1, _at(x, (n - 1) * channels + ch)).otherwise((here + following) / 2)

        return F.transform(_indexes(required * channels), one)

    return let(samples.cast("array<double>"), resampled)


def reverse(samples: Column, channels: int = 1) -> Column:
    """The sample frames in reverse order; the channels of each stay as they are."""

    def turned(x: Column) -> Column:
        n = F.floor(F.size(x) / channels)
        return F.transform(x, lambda _, i: _at(x, (n - 1 - F.floor(i / channels)) * channels + i % channels))

    return let(samples, turned)


def convert(samples: Column, src: str, dst: str) -> Column:
    """Between sample formats: float to integers times the largest magnitude, cut to range; 16 and 32 bits by 16 bits."""
    if src == dst or {src, dst} == {"pcm24", "pcm32"}:
        return samples
    if src == "float":
        size = LARGEST[dst] + 1
        return F.transform(samples, lambda x: F.greatest(F.lit(-size), F.least(F.lit(size - 1), (x.cast("double") * size).cast("long"))).cast("int"))
    if dst == "float":
        return F.transform(samples, lambda x: x.cast("double") / (LARGEST[src] + 1))
    return F.transform(samples, lambda x: F.shiftleft(x.cast("int"), 16) if src == "pcm16" else F.shiftright(x.cast("int"), 16))


def lowpass(df: DataFrame, column: str, mag: int = 14, channels: int = 1, block: int | None = None) -> DataFrame:
    """0.625 * (x + 0.8 * the sample mag before), over the whole stream: the delay goes on across frames. mag 1 or less: unchanged.

    Frames have block sample frames each. A frame needs only the end of the ones before it, which an
    equi-join brings; no window over all frames.
    """
    from cadenza.operators.windows import lagged

    if mag <= 1:
        return df
    if not block:
        raise ValueError("the number of sample frames in a block is needed")
    back = -(-mag // block)
    names = []
    for k in range(back, 0, -1):
        df = lagged(df, column, f"_back{k}", k)
        names.append(f"_back{k}")
    silent = F.transform(F.col(column), lambda _: F.lit(0.0))
    line = F.concat(*(F.coalesce(F.col(n).cast("array<double>"), silent) for n in names), F.col(column).cast("array<double>"))
    shift = (back * block - mag) * channels
    out = let(line, lambda past: F.transform(F.col(column), lambda x, i: 0.625 * (x.cast("double") + 0.8 * F.get(past, i + shift))))
    return df.withColumn(column, out).drop(*names)


def reseat(df: DataFrame, column: str, block: int, frequency: int, fps: tuple[int, int], length: int) -> DataFrame:
    """Blocks of a fixed size cut anew at the frame starts of a cadence; the last is padded with zeros."""
    return recut(df, column, F.col("position") * block, frequency, fps)


def recut(df: DataFrame, column: str, start: Column, frequency: int, fps: tuple[int, int], channels: int = 1) -> DataFrame:
    """Blocks that begin at the sample start, cut anew at the frame starts of a cadence: position and column. A frame's missing end is zeros.

    Each block is sliced into the frames that it touches, mostly one or two, and the slices are gathered by frame.
    """
    size = F.floor(F.size(column) / channels).cast("long")
    rows = df.select(start.cast("long").alias("_s"), size.alias("_n"), F.col(column).cast("array<double>").alias("_x")).where("_n > 0")
    lo, hi = (frame_of_sample(x, frequency, fps) for x in (F.col("_s"), F.col("_s") + F.col("_n") - 1))
    parts = rows.withColumn("frame", F.explode(F.sequence(lo, hi)))
    a = F.greatest(F.col("_s"), samples_to_frame(F.col("frame"), frequency, fps))
    b = F.least(F.col("_s") + F.col("_n"), samples_to_frame(F.col("frame") + 1, frequency, fps))
    piece = F.slice("_x", ((a - F.col("_s")) * channels + 1).cast("int"), ((b - a) * channels).cast("int"))
    got = parts.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct(a.alias("a"), piece.alias("x")))).alias("s"))
    n = (samples_to_frame(F.col("frame") + 1, frequency, fps) - samples_to_frame(F.col("frame"), frequency, fps)) * channels
    data = F.flatten(F.transform("s", lambda v: v["x"]))
    padded = F.concat(data, F.array_repeat(F.lit(0.0), F.greatest((n - F.size(data)).cast("int"), F.lit(0))))
    return got.select(F.col("frame").alias("position"), padded.alias(column))
