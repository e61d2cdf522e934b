"""The library's words in SQL: temporary functions written in SQL, and table functions over TABLE arguments."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StringType, StructType

from cadenza.functions.timecode import CYCLES, RATES


def _timecode(rate: str, drop: bool) -> str:
    r, _, d = RATES[rate]
    number = "frame"
    if drop:
        ten, minute = 600 * r - 9 * d, 60 * r - d
        inside = f"(frame % {144 * ten}L)"
        number = f"({inside} + {d} * (9 * ({inside} div {ten}L) + if({inside} % {ten}L < {d}, 0, ({inside} % {ten}L - {d}) div {minute}L)))"
    n = f"({number} % {86400 * r}L)"
    part = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    mark = ";" if drop else ":"
    return f"concat({part(f'{n} div {3600 * r}L')}, ':', {part(f'{n} div {60 * r}L % 60')}, ':', {part(f'{n} div {r}L % 60')}, '{mark}', {part(f'{n} % {r}L')})"


def _cycle(profile: tuple) -> str:
    cycle = CYCLES[profile]
    return f"element_at(array({', '.join(map(str, cycle))}), CAST(frame % {len(cycle)} AS INT) + 1)"


#: name: arguments, result, text. Words come from the language of the library (see words) and its timecode, cadence and span functions.
FUNCTIONS = {
    "cz_mod": ("a BIGINT, b BIGINT", "BIGINT", "if(b = 0, NULL, pmod(a, b))"),
    "cz_clamp": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(low, least(high, x))"),
    "cz_lerp": ("position BIGINT, first BIGINT, last BIGINT, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN position BETWEEN first AND last THEN low + (high - low) * if(last = first, 0D, (position - first) / (last - first)) END"),
    "cz_tc_pal": ("frame BIGINT", "STRING", _timecode("pal", False)),
    "cz_tc_ntsc_df": ("frame BIGINT", "STRING", _timecode("ntsc", True)),
    "cz_samples_mpeg_ntsc": ("frame BIGINT", "INT", _cycle(("mpeg", 30000, 1001))),
    "cz_samples_dv_ntsc": ("frame BIGINT", "INT", _cycle(("dv", 30000, 1001))),
    "cz_samples": ("frame BIGINT, frequency BIGINT, num BIGINT, den BIGINT", "BIGINT", "(frame + 1) * frequency * den div num - frame * frequency * den div num"),
    "cz_span_meets": ("a BIGINT, ad BIGINT, b BIGINT, bd BIGINT", "BOOLEAN", "least(a + ad, b + bd) > greatest(a, b)"),
    "cz_span_common": ("a BIGINT, ad BIGINT, b BIGINT, bd BIGINT", "STRUCT<start BIGINT, duration BIGINT>", "CASE WHEN least(a + ad, b + bd) > greatest(a, b) THEN named_struct('start', greatest(a, b), 'duration', least(a + ad, b + bd) - greatest(a, b)) END"),
    "cz_has": ("properties MAP<STRING, STRING>, name STRING", "BOOLEAN", "map_contains_key(properties, name)"),
    "cz_query": ("properties MAP<STRING, STRING>, name STRING, missing STRING", "STRING", "coalesce(try_element_at(properties, name), missing)"),
}


@udtf
class Unfold:
    """cz_unfold(TABLE(t), id => 'column'): id (as text), name and value of each other column of each row. The columns need not be known to the query."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, id: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not id.isConstantExpression or id.value not in rows.dataType.names:
            raise ValueError("cz_unfold takes a TABLE argument and the name of its id column")
        return AnalyzeResult(StructType().add("id", StringType()).add("name", StringType()).add("value", StringType()))

    def eval(self, rows: Row, id: str):
        for name, value in rows.asDict().items():
            if name != id:
                yield rows[id] if rows[id] is None else str(rows[id]), name, None if value is None else str(value)


@udtf
class Uncovered:
    """cz_uncovered(TABLE(t) PARTITION BY key ORDER BY start): key, start and duration of what spans of kind 0 leave of those of kind 1, in each partition.

    t has key, kind, start and duration; rows come by start. Of each partition only the spans that are still open are held. Spans of kind 1 are cut one by one, so those that overlap give a row each.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"key", "kind", "start", "duration"} <= set(rows.dataType.names):
            raise ValueError("cz_uncovered takes a TABLE of key, kind, start and duration")
        return AnalyzeResult(StructType().add("key", rows.dataType["key"].dataType).add("start", LongType()).add("duration", LongType()))

    def __init__(self):
        self.open, self.covered, self.key = [], None, None  # spans (start, end) not yet cut to their end; up to where covers reach

    def _upto(self, at):
        """What is free up to a place, of all open spans."""
        left = []
        for start, end in self.open:
            free = start if self.covered is None else max(start, self.covered)
            stop = end if at is None else min(end, at)
            if stop > free:
                yield self.key, free, stop - free
                free = stop
            if at is not None and end > max(free, at):
                left.append((max(free, at), end))
        self.open = left

    def eval(self, rows: Row):
        self.key = rows["key"]
        if rows["start"] is None or not rows["duration"] or rows["duration"] <= 0:
            return
        start, end = rows["start"], rows["start"] + rows["duration"]
        if rows["kind"] == 1:
            self.open.append((start, end))
        elif rows["kind"] == 0:
            yield from self._upto(start)
            self.covered = end if self.covered is None else max(self.covered, end)

    def terminate(self):
        yield from self._upto(None)


def register_sql(spark: SparkSession) -> SparkSession:
    """Make FUNCTIONS, cz_unfold and cz_uncovered known to a session, so that queries can be written in SQL alone."""
    for name, (arguments, result, text) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {text}")
    spark.udtf.register("cz_unfold", Unfold)
    spark.udtf.register("cz_uncovered", Uncovered)
    return spark
