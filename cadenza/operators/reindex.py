"""Operators that give the rows of a clip new positions.

Each is written from the source row's side: the output positions of a row have a closed form, so a
filter, a projection or an explode does it, and no row is looked up by a join or moved by a shuffle.
Operators that merge rows group them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.timecode import samples_for_frame, samples_to_frame
from cadenza.model import Clip
from cadenza.operators.combine import held_on
from cadenza.operators.image import apply, deinterlace


def _pos() -> Column:
    return F.col("position")


def _bound(value: int, length: int, start: bool) -> int:
    """A clip bound brought into the sequence; negative ones count from the end."""
    if value >= length:
        value = length - 1 if start else length
    if value < 0:
        value = length + value + (0 if start else 1)
    return max(value, 0)


def clip(c: Clip, first: int = 0, out: int = -1) -> Clip:
    """The rows from first to before out. first at or behind out: from first backwards to after out."""
    a, b = _bound(first, c.length, True), _bound(out, c.length, False)
    if a < b:
        return c.with_df(c.df.where(_pos().between(a, b - 1)).withColumn("position", _pos() - a), b - a)
    return c.with_df(c.df.where((_pos() <= a) & (_pos() > b)).withColumn("position", F.lit(a) - _pos()), a - b)


def offset(c: Clip, first: int, audio: str | None = None, frequency: int = 48000, channels: int = 2) -> Clip:
    """first empty rows (nulls), then the clip. If an audio column is named, the rows before have silence there, as many samples as each frame has."""
    blank = c.df.sparkSession.range(first).select(F.col("id").alias("position"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in c.df.schema if f.name != "position"))
    if audio:
        n = samples_for_frame(_pos(), frequency, c.fps) * channels
        blank = blank.withColumn(audio, F.array_repeat(F.lit(0.0), n.cast("int")).cast(c.df.schema[audio].dataType))
    moved = c.df.withColumn("position", _pos() + first)
    return c.with_df(blank.unionByName(moved) if first > 0 else c.df, c.length + max(first, 0))


def step(c: Clip, speed: int = 2) -> Clip:
    """Every speed-th row; the last, incomplete step is left out. 0: the clip itself. Negative: no rows."""
    if speed == 0:
        return c
    n = max(0, c.length // speed) if speed > 0 else 0
    rows = c.df.where((_pos() % speed == 0) & (_pos() < n * speed)) if n else c.df.limit(0)
    return c.with_df(rows.withColumn("position", F.expr(f"position div {speed}")), n)


def extract(c: Clip, frames: int = 180) -> Clip:
    """frames rows evenly from first to last, places as the double division gives them."""
    places: dict[int, list[int]] = {}
    for p in range(frames):
        places.setdefault(min(int(p / (frames - 1) * c.length), c.length - 1) if frames > 1 else 0, []).append(p)
    return _gathered(c, places, frames)


def frame_list(c: Clip, frames: list[int]) -> Clip:
    """The rows at the listed positions, in this order, with repeats. One out of range is an error."""
    if bad := [p for p in frames if not 0 <= p < c.length]:
        raise ValueError(f"positions outside the clip: {bad[:5]}")
    places: dict[int, list[int]] = {}
    for k, p in enumerate(frames):
        places.setdefault(p, []).append(k)
    return _gathered(c, places, len(frames))


def _gathered(c: Clip, places: dict[int, list[int]], length: int) -> Clip:
    """Each source position at its places. A short list becomes a filter that reaches the scan; a longer one is joined."""
    if not places:
        return c.with_df(c.df.limit(0), 0)
    rows = c.df.where(_pos().isin(list(places))) if len(places) <= 1000 else c.df.where(_pos().between(min(places), max(places)))
    wanted = c.df.sparkSession.createDataFrame(list(places.items()), "position long, at array<long>")
    return c.with_df(rows.join(wanted, "position").drop("position").select("*", F.explode("at").alias("position")).drop("at"), length)


def hold(c: Clip, frame: int = 0, count: int = 25, audio: str | None = None, image: str | None = None, order: str = "field_order") -> Clip:
    """Repeat one row count times more, marked silent, then go on with that row.

    The repeats are the range of their positions joined to the one row. An audio column, if named, is silenced in them; an image
    column is deinterlaced (once, in the one row) unless order says that it is progressive (0 or null).
    """
    h = c.length + frame if frame < 0 else frame
    count = max(count, 0)
    if not 0 <= h < c.length or not count:
        return c.with_df(c.df.withColumn("silent", F.lit(False)), c.length + count)
    moved = c.df.withColumn("position", F.when(_pos() < h, _pos()).otherwise(_pos() + count)).withColumn("silent", F.lit(False))
    held = c.df.where(_pos() == h)
    if image:
        moving = F.coalesce(order, F.lit(0)) != 0
        held = apply(held.withColumn("_still", F.col(image)), "_still", deinterlace)
        held = held.withColumns({image: F.when(moving, F.col("_still")).otherwise(F.col(image)), order: F.when(moving, F.lit(0)).otherwise(F.col(order)).cast(held.schema[order].dataType)}).drop("_still")
    repeats = held_on(held, h, h, h + count).withColumn("silent", F.lit(True))
    if audio:
        repeats = repeats.withColumn(audio, F.transform(audio, lambda x: x - x))
    return c.with_df(moved.unionByName(repeats), c.length + count)


def repeat(c: Clip, kind: str = "repeat", count: int = 2) -> Clip:
    """count passes: all forwards, or with every other one backwards (pingpong odd, pongping even ones)."""
    if kind not in ("repeat", "pingpong", "pongping"):
        raise ValueError(kind)
    rows = c.df.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count > 0 else c.df.withColumn("_q", F.lit(0)).limit(0)
    back = {"repeat": F.lit(False), "pingpong": F.col("_q") % 2 == 1, "pongping": F.col("_q") % 2 == 0}[kind]
    at = F.col("_q") * F.lit(c.length).cast("long") + F.when(back, c.length - 1 - _pos()).otherwise(_pos())
    return c.with_df(rows.withColumn("position", at).withColumn("reversed", back).drop("_q"), c.length * max(count, 0))


def loop(c: Clip, rows: int) -> Clip:
    """The clip over and over, as many rows as the consumer asks for."""
    last = F.expr(f"({rows - 1} - position) div {c.length}")
    out = c.df.where(_pos() < rows).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return c.with_df(out.withColumn("position", _pos() + F.col("_q") * c.length).drop("_q"), rows)


def pulldown(c: Clip, payload: list[str]) -> Clip:
    """Four rows to five: the third and fourth of five merge the fields of two source rows each.

    Columns name_top and name_bottom per payload column. A short last group repeats its last row.
    """
    n = c.length * 5 // 4
    last = c.length - 1
    group, place = F.expr("position div 4"), _pos() % 4
    base = group * 5
    # (output place, fields) of each source row in its group of four
    uses = F.when(place == 0, F.array(_use(0, 3))).when(place == 1, F.array(_use(1, 3), _use(2, 1))).when(place == 2, F.array(_use(2, 2), _use(3, 1))).otherwise(F.array(_use(3, 2), _use(4, 3)))
    short = c.length % 4
    if short:
        tail = F.array(*(_use(k, 3 if top >= short - 1 and bottom >= short - 1 else 1 if top >= short - 1 else 2) for k, (top, bottom) in enumerate(((0, 0), (1, 1), (1, 2), (2, 3), (3, 3))) if max(top, bottom) >= short - 1))
        uses = F.when(_pos() == last, tail).otherwise(uses)
    rows = c.df.withColumn("_u", F.explode(uses)).withColumn("_p", base + F.col("_u.k")).where(F.col("_p") < n)
    top, bottom = F.col("_u.fields").bitwiseAND(1) > 0, F.col("_u.fields").bitwiseAND(2) > 0
    cols = [x for name in payload for x in (F.max(F.when(top, F.col(name))).alias(f"{name}_top"), F.max(F.when(bottom, F.col(name))).alias(f"{name}_bottom"))]
    return c.with_df(rows.groupBy(F.col("_p").alias("position")).agg(*cols), n)


def _use(k: int, fields: int) -> Column:
    return F.struct(F.lit(k).alias("k"), F.lit(fields).alias("fields"))


def interlace(c: Clip, payload: list[str], bff: bool = True, enable: bool = True) -> Clip:
    """At 48 rows a second or more, pairs of rows become one with two fields; else the clip itself."""
    if not enable or round(c.fps[0] / c.fps[1]) < 48:
        return c
    n = c.length // 2
    even = _pos() % 2 == 0
    first, second = ("bottom", "top") if bff else ("top", "bottom")
    cols = [x for name in payload for x in (F.max(F.when(even, F.col(name))).alias(f"{name}_{first}"), F.max(F.when(~even, F.col(name))).alias(f"{name}_{second}"))]
    rows = c.df.where(_pos() < 2 * n).groupBy(F.expr("position div 2").alias("position")).agg(*cols)
    return c.with_df(rows, n, (c.fps[0], c.fps[1] * 2))


def transport(c: Clip, start: int = 0, speed: int = 1, rows: int | None = None, looping: bool = True, audio: str | None = None, silence: bool = False) -> Clip:
    """What a cursor meets that moves by speed from start: around the clip, or clamped to its ends.

    An audio column, if named, is null where the cursor stands still or stays on a row, and with silence everywhere.
    """
    rows = c.length if rows is None else rows
    place = lambda cursor: F.pmod(cursor, F.lit(c.length)) if looping else F.greatest(F.lit(0), F.least(cursor, F.lit(c.length - 1)))
    at, before = place(F.col("p") * speed + start), place((F.col("p") - 1) * speed + start)
    picked = c.df.sparkSession.range(rows).withColumnRenamed("id", "p").withColumn("position", at.cast("long"))
    if audio:
        mute = F.lit(silence or speed == 0) | ((F.col("p") > 0) & (at == before))
        picked = picked.withColumn("_mute", mute)
    out = c.df.join(picked, "position").drop("position").withColumnRenamed("p", "position")
    if audio:
        out = out.withColumn(audio, F.when(~F.col("_mute"), F.col(audio))).drop("_mute")
    return c.with_df(out, rows)


def playlist(clips: list[Clip]) -> Clip:
    """The clips one after another; rows tell their slot."""
    out: DataFrame | None = None
    total = 0
    for k, c in enumerate(clips):
        part = c.df.withColumn("position", _pos() + total).withColumn("slot", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        total += c.length
    return clips[0].with_df(out, total)


def slots(clips: list, first: int = 0, out: int = -1) -> list:
    """A slice of a list of clips by clip bounds; backwards it includes the clip at out."""
    a, b = _bound(first, len(clips), True), _bound(out, len(clips), False)
    if a <= b:
        return clips[a:b]
    return [clips[k] for k in range(a, max(b, 0) - 1, -1)]


def frame_rate(c: Clip, num: int, den: int = 1, reverse: bool = False) -> Clip:
    """Nearest earlier row at another rate: position p shows floor(p * source / target), exactly.

    reverse: the row that backward play shows, ceil((p + 1) * source / target) - 1.
    """
    if (num, den) == c.fps:
        return c
    a, b = c.fps[0] * den, c.fps[1] * num
    n = -(-c.length * b // a)
    if reverse:  # p with ceil((p+1)a/b)-1 = s: floor(s b / a) <= p < floor((s+1) b / a), shifted by what p+1 needs
        lo, hi = F.expr(f"(position * {b}) div {a}"), F.expr(f"((position + 1) * {b}) div {a} - 1")
    else:
        lo, hi = F.expr(f"(position * {b} + {a - 1}) div {a}"), F.expr(f"((position + 1) * {b} + {a - 1}) div {a} - 1")
    hi = F.least(hi, F.lit(n - 1))
    rows = c.df.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
    rows = rows.withColumn("source", _pos()).withColumn("position", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return c.with_df(rows, n, (num, den))


def frame_rate_audio(c: Clip, column: str, frequency: int, num: int, den: int = 1, channels: int = 1) -> Clip:
    """frame_rate, with the samples re-blocked: each row has those of its own time, so the stream of samples stays; its end is padded with zeros."""
    from cadenza.operators.audio import recut

    if (num, den) == c.fps:
        return c
    out = frame_rate(c.with_df(c.df.drop(column)), num, den)
    blocks = recut(c.df.select("position", column), column, samples_to_frame(_pos(), frequency, c.fps), frequency, out.fps, channels)
    n = samples_for_frame(_pos(), frequency, out.fps) * channels
    silent = F.array_repeat(F.lit(0.0), n.cast("int"))
    return out.with_df(out.df.join(blocks, "position", "left").withColumn(column, F.coalesce(column, silent)))
