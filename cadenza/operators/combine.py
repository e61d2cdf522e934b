"""Operators that combine clips by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.model import Clip

def _pos() -> Column:
    return F.col("position")


def muxer(video: Clip, audio: Clip, use_longest: bool = True) -> Clip:
    """Columns of both clips at equal positions.

    With use_longest the shorter one's last row goes on: that one row is joined to the range of the positions left, so
    no row or task makes them all. If one clip is empty, the other's rows with nulls. Columns that follow from the
    position (Clip.made) are made after the join: their size can't be told from the plan, so the join would broadcast whole blocks of samples.
    """
    if not video.length or not audio.length:
        use_longest = True
    n = max(video.length, audio.length) if use_longest else min(video.length, audio.length)

    def later(c: Clip, other: Clip) -> dict[str, Column]:
        made = c.made(F.least(_pos(), F.lit(c.length - 1))) if c.made and c.length else {}
        return {} if set(made) & set(other.df.columns) else made

    def stretched(c: Clip, other: Clip) -> DataFrame:
        df = c.df.drop(*later(c, other))
        if not use_longest or c.length in (0, n):
            return df.where(_pos() < n)
        return df.unionByName(held_on(df, c.length - 1, c.length, n))

    kind = "full" if not video.length or not audio.length else "inner"
    out = stretched(video, audio).join(stretched(audio, video), "position", kind)
    made = later(video, audio) | later(audio, video)
    if made:
        out = out.withColumns(made).select("position", *(x for c in (video, audio) for x in c.df.columns if x != "position"))
    return video.with_df(out, n)


def held_on(df: DataFrame, source: int, first: int, end: int) -> DataFrame:
    """The row at position source, again at every position from first to before end."""
    row = df.where(_pos() == source).drop("position")
    return df.sparkSession.range(first, end).withColumnRenamed("id", "position").crossJoin(F.broadcast(row)).select(*df.columns)  # one row


def active(background: DataFrame, overlays: DataFrame, bucket: int = 1024) -> DataFrame:
    """Each background row with each overlay (slot, z, start, duration, ...) whose [start, start+duration) has it.

    Both sides are keyed by bucket of the position, an overlay once for each bucket it touches, so this
    is an equi-join with a filter, however many overlays there are.
    """
    spans = overlays.where("duration > 0").withColumn("_b", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(start + duration - 1) div {bucket}"))))
    rows = background.withColumn("_b", F.expr(f"position div {bucket}"))
    return rows.join(spans, "_b").where((_pos() >= F.col("start")) & (_pos() < F.col("start") + F.col("duration"))).drop("_b")


def composite_order(joined: DataFrame, fields: list[str]) -> DataFrame:
    """position and layers: the active overlays of each position by z (missing: 0), ties by slot."""
    z = F.coalesce("z", F.lit(0))
    return joined.groupBy("position").agg(F.sort_array(F.collect_list(F.struct(z.alias("z"), "slot", *fields))).alias("layers"))


def compositor_length(starts: list[int], lengths: list[int]) -> int:
    """The background's length doesn't count: the last end of the overlays."""
    return max((a + n for a, n in zip(starts, lengths, strict=True)), default=0)


def visible(joined: DataFrame, covers: Column) -> DataFrame:
    """Without the layers that a covering opaque layer of higher z (then slot) hides."""
    order = F.struct(F.coalesce("z", F.lit(0)), F.col("slot"))
    top = F.max(F.when(covers, order)).over(Window.partitionBy("position"))
    return joined.withColumn("_top", top).where(F.col("_top").isNull() | (order >= F.col("_top"))).drop("_top")


def conform_audio(df: DataFrame, column: str, channels: int, to_channels: int, samples: int) -> DataFrame:
    """Blocks brought to a number of sample frames and channels; null audio becomes silence."""
    from cadenza.operators.audio import channel_convert, pitch

    silent = F.array_repeat(F.lit(0.0), samples * to_channels)
    x = F.col(column).cast("array<double>")
    sized = F.when(F.size(x) == samples * channels, x).otherwise(pitch(x, samples, channels))
    return df.withColumn(column, F.when(x.isNotNull(), channel_convert(sized, channels, to_channels)).otherwise(silent))


def events_at(df: DataFrame, in_points: list[int]) -> DataFrame:
    """df with event: how many of the sorted in-points have begun at the position; event_start: the latest one (null before the first)."""
    points = sorted(set(in_points))
    at = F.array(*(F.lit(p).cast("long") for p in points)) if points else F.array().cast("array<bigint>")
    begun = F.filter(at, lambda p: p <= _pos())
    return df.withColumns({"event": F.size(begun), "event_start": F.when(F.size(begun) > 0, F.element_at(begun, -1))})


def conform(df: DataFrame, defaults: dict[str, object], drop: list[str] | None = None) -> DataFrame:
    """Null components get their default; those to drop become null."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(name, F.lit(value).cast(df.schema[name].dataType)))
    for name in drop or []:
        df = df.withColumn(name, F.lit(None).cast(df.schema[name].dataType))
    return df


def montage_grid(n: int, orient: int = 2) -> tuple[int, int]:
    """(columns, rows): 0 a vertical strip, 1 a horizontal one, 2 nearly square."""
    if orient == 0:
        return 1, n
    if orient == 1:
        return n, 1
    cols = max(1, int(n**0.5))
    while cols * cols < n:
        cols += 1
    return cols, -(-n // cols)


def montage_window(c: Clip, column: str, frames: int, step: int = 1) -> Clip:
    """Around every position the values at base - (n/2) * step to before base + (n/2 + 1) * step, by step.

    base is the position down to a multiple of step. Each source row is sent to the positions whose
    window has it, and grouped there; places outside the clip are left out.
    """
    half = frames // 2
    rows = c.df.where(_pos() % step == 0).select(F.col("position").alias("source"), column)
    base = F.explode(F.sequence(F.greatest(F.lit(0), F.col("source") - half * step), F.col("source") + half * step, F.lit(step))).alias("base")
    spread = rows.select("source", column, base).where(F.col("base") < c.length)
    grouped = spread.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("source", column))).alias("window"))
    per = grouped.withColumn("position", F.explode(F.sequence(F.col("base"), F.least(F.col("base") + step - 1, F.lit(c.length - 1))))).drop("base")
    return c.with_df(per)


def montage_sheet(c: Clip, column: str, step: int = 1, orient: int = 2) -> DataFrame:
    """The whole clip by step on one sheet: a row per cell with its place in the grid."""
    n = -(-c.length // step)
    cols, _ = montage_grid(n, orient)
    cell = F.expr(f"position div {step}")
    return c.df.where(_pos() % step == 0).select(cell.alias("cell"), (cell % cols).alias("col"), F.expr(f"cast(position div {step} as bigint) div {cols}").alias("row"), column)


def tee(df: DataFrame, path: str, *sinks) -> DataFrame:
    """df for the caller and for each sink (a function of a DataFrame): computed once, into a table at path."""
    df.write.mode("overwrite").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    for sink in sinks:
        sink(kept)
    return kept


def fork(df: DataFrame, path: str, *branches) -> list[DataFrame]:
    """What each branch (a function of a DataFrame) makes of df, which is computed once, into a table at path."""
    kept = tee(df, path)
    return [branch(kept) for branch in branches]


def voodoo(c: Clip, video_op, audio_op, video_cols: list[str], audio_cols: list[str]) -> Clip:
    """Two column sets of a clip processed apart and joined again by position.

    For operators that only change columns in place, of_columns does the same without a join.
    """
    video = video_op(c.with_df(c.df.select("position", *video_cols)))
    audio = audio_op(c.with_df(c.df.select("position", *audio_cols)))
    return muxer(video, audio)


def of_columns(c: Clip, *ops) -> Clip:
    """Operators that keep positions (functions of a DataFrame), one after another on the same rows."""
    df = c.df
    for op in ops:
        df = op(df)
    return c.with_df(df)


def key_frame_of(positions: DataFrame, index: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """positions with key_frame: the greatest indexed frame at or before, else the first one, else -1."""
    from cadenza.operators.windows import last_seen

    marks = index.select(F.col("frame").alias("position"), F.col("frame").alias("_mark")).distinct()
    both = positions.select("position", F.lit(None).cast("long").alias("_mark"), F.lit(True).alias("_asked")).unionAll(marks.select("position", "_mark", F.lit(False).alias("_asked")))
    seen = last_seen(both, "_mark", "_seen", bucket).where("_asked").select("position", "_seen")  # a mark at the position itself counts
    first = index.agg(F.coalesce(F.min("frame"), F.lit(-1)).alias("_first"))
    return seen.crossJoin(F.broadcast(first)).select("position", F.coalesce("_seen", "_first").alias("key_frame"))  # one row


def available_frames(index: DataFrame, size: int, finished: bool = False) -> DataFrame:
    """Frames in the first size bytes of a file by its index (frame, frames, offset, length): one row.

    The last item wholly inside tells; a finished file of at least its indexed size has all of them.
    """
    return index.agg(_available(size, finished).alias("frames"))


def available_at(index: DataFrame, sizes: list[int]) -> DataFrame:
    """size and frames for each of some sizes, in one pass over the index."""
    made = index.agg(F.array(*(F.struct(F.lit(n).cast("long").alias("size"), _available(n).cast("long").alias("frames")) for n in sizes)).alias("all"))
    return made.select(F.inline("all"))


def _available(size: int, finished: bool = False) -> Column:
    end = F.col("offset") + F.col("length")
    inside = F.max(F.when(end <= size, F.struct("offset", (F.col("frame") + F.col("frames")).alias("n"))))
    whole = F.max(F.col("frame") + F.col("frames"))
    return F.when(F.lit(finished) & (F.max(end) <= size), whole).otherwise(F.coalesce(inside["n"], F.lit(0)))
