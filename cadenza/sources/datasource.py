"""Media files as a Spark data source, `cadenza_frames`: frames of raw pictures, samples and WAV, records of key-frame indexes.

spark.read.format("cadenza_frames").option("format", "raw").load(path) gives a row a frame. Files are cut into spans of bytes and each span is read by a task of its own, so a
file of any size is read by many; of a range of positions (of an index, of record numbers) it reads only the bytes of those frames and, of other spans, only the
file's header. spark.readStream follows indexes that grow. df.write puts files together from sorted rows and commits them: see write_frames.
"""

from __future__ import annotations

import ast
import bisect
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from cadenza.functions.timecode import CYCLES

NAME = "cadenza_frames"
HEADER, CHUNK = 1 << 16, 4 << 20
SCHEMAS = {
    "raw": "path string, position long, payload binary",
    "aud": "path string, position long, channels int, frequency int, samples int, payload binary",
    "wav": "path string, position long, channels int, frequency int, samples long, audio array<double>",
    "awi": "path string, position long, version int, closed boolean, type long, frame long, frames long, offset long, length long",
}
WRITTEN = "file string, position long, head binary, payload binary"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _schema(kind: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (f.split(" ") for f in SCHEMAS[kind].split(", "))])


def _rows(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Layout:
    """Where the frames of a file are: frame p is the bytes from place(p) to place(p + 1) after start, count of them; size is where data ends."""

    start: int
    size: int
    count: int
    place: Callable[[int], int]
    rows: Callable[[int, int, bytes], pa.RecordBatch]

    def between(self, low: int, high: int | None) -> tuple[int, int]:
        """The frames whose first byte lies in these bytes of the file."""
        at = lambda x: bisect.bisect_left(range(self.count), max(x - self.start, 0), key=self.place)
        return at(low), self.count if high is None else at(high)


def entries_of(head: bytes) -> tuple[dict[str, str], int]:
    """The name=value entries of a file's first line, and how many bytes it has."""
    line = head[:4096].split(b"\n", 1)[0].decode("latin-1")
    return dict(re.findall(r"(?:^|\s)(\w+)=(\S*)", line)), len(line) + 1


def _raw(path: str, head: bytes, size: int, options: dict) -> Layout:
    from cadenza.sources.files import FRAME_BYTES

    if options.get("frame_bytes"):
        one, skip = int(options["frame_bytes"]), int(options.get("header_bytes", 0))
    else:
        known, skip = entries_of(head)
        num, den = FRAME_BYTES[known["pf"]]
        one = int(known["width"]) * int(known["height"]) * num // den

    def rows(a: int, b: int, data: bytes) -> pa.RecordBatch:
        return _rows("raw", [(path, p, data[(p - a) * one : (p - a + 1) * one]) for p in range(a, b)])

    return Layout(skip, size, max(size - skip, 0) // one, lambda p: p * one, rows)


def _aud(path: str, head: bytes, size: int, options: dict) -> Layout:
    from cadenza.sources.files import SAMPLE_BYTES

    h, skip = entries_of(head)
    f, ch, num, den = (int(h[k]) for k in ("frequency", "channels", "fps_num", "fps_den"))
    one = SAMPLE_BYTES[h["af"]] * ch
    cycle = CYCLES.get((h.get("profile", ""), num, den)) if f == 48000 else None
    if cycle:
        before = np.cumsum([0, *cycle]).tolist()
        first = lambda p: p // len(cycle) * before[-1] + before[p % len(cycle)]
    else:
        first = lambda p: p * f * den // num
    total = max(size - skip, 0) // one
    most = (total + 1) * num // (f * den) + 2 if not cycle else total + 1
    count = bisect.bisect_left(range(most), total, key=first)
    start = lambda p: min(first(p), total)

    def rows(a: int, b: int, data: bytes) -> pa.RecordBatch:
        base = start(a)
        return _rows("aud", [(path, p, ch, f, start(p + 1) - start(p), data[(start(p) - base) * one : (start(p + 1) - base) * one]) for p in range(a, b)])

    return Layout(skip, size, count, lambda p: start(p) * one, rows)


def _wav(path: str, head: bytes, size: int, options: dict) -> Layout:
    from cadenza.sources.files import SAMPLE_KINDS, decode, wav_header

    h = wav_header(head)
    num, den = int(options.get("fps_num", 25)), int(options.get("fps_den", 1))
    f, ch, one = h["frequency"], h["channels"], h["channels"] * h["bits"] // 8
    total = max(min(h["bytes"], size - h["start"]), 0) // one
    first = lambda p: p * f * den // num
    start = lambda p: min(first(p), total)

    def rows(a: int, b: int, data: bytes) -> pa.RecordBatch:
        x, base, out = decode(data, SAMPLE_KINDS[h["format"], h["bits"]]), start(a), []
        for p in range(a, b):
            own = x[(start(p) - base) * ch : (start(p + 1) - base) * ch]
            out.append((path, p, ch, f, len(own) // ch, np.pad(own, (0, (first(p + 1) - first(p)) * ch - len(own)))))
        return _rows("wav", out)

    return Layout(h["start"], size, -(-total * num // (f * den)), lambda p: start(p) * one, rows)


def _records(path: str, version: int, closed: bool, first: int, data: bytes) -> pa.RecordBatch:
    from cadenza.sources.files import RECORD

    part = np.frombuffer(data, RECORD)
    n = len(part)
    fixed = [pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n)), pa.array(np.full(n, version, np.int32)), pa.array(np.full(n, closed))]
    return pa.RecordBatch.from_arrays(fixed + [pa.array(part[k].astype("<i8")) for k in ("type", "frame", "frames", "offset", "length")], schema=_schema("awi"))


def index_state(head: bytes, tail: bytes, size: int) -> tuple[int, int, int, bool]:
    """Version, header bytes, whole records and whether a footer closes it, of an index that may be growing, by its first and last bytes."""
    from cadenza.sources.files import INDEX_SIZES, RECORD, index_version

    version = index_version(head[:8])
    if not version:
        return 0, 0, 0, False
    skip, foot = INDEX_SIZES[version]
    body, one = max(size - skip, 0), RECORD.itemsize
    mark = tail[-foot:]
    closed = body >= foot and body % one == foot % one and len(mark) == foot and mark[:2] == b"\xff\xff" and b"AWI" in mark
    return version, skip, (body - foot if closed else body) // one, closed


def _awi(path: str, head: bytes, size: int, options: dict) -> Layout:
    from cadenza.sources.files import RECORD

    version, skip, count, closed = index_state(head, options["tail"], size)
    one = RECORD.itemsize
    return Layout(skip, size, count, lambda p: p * one, lambda a, b, data: _records(path, version, closed, a, data))


LAYOUTS = {"raw": _raw, "aud": _aud, "wav": _wav, "awi": _awi}


def read_at(file, offset: int, size: int) -> bytes:
    """All reading of files goes through here."""
    file.seek(offset)
    return file.read(size)


def layout_of(file, kind: str, path: str, options: dict) -> Layout:
    size = file.size()
    more = {"tail": read_at(file, max(size - 64, 0), 64)} if kind == "awi" else {}
    return LAYOUTS[kind](path, read_at(file, 0, HEADER), size, options | more)


def listed(path: str) -> list[tuple[str, int]]:
    """The files of a path (a file, or a folder's files at any depth but hidden ones) and their sizes, in order."""
    from pyarrow.fs import FileSelector, FileType

    from cadenza.sources.files import file_system

    fs, inner = file_system(path)
    own = fs.get_file_info(inner)
    if own.type == FileType.File:
        return [(path, own.size)]
    if own.type == FileType.NotFound:
        raise FileNotFoundError(path)
    found = [i for i in fs.get_file_info(FileSelector(inner, recursive=True)) if i.type == FileType.File]
    root = path.removesuffix("/")
    inside = [(i.path.removeprefix(inner.rstrip("/")), i.size) for i in found]
    return sorted((root + rel, size) for rel, size in inside if not any(part.startswith((".", "_")) for part in rel.split("/")))


@dataclass
class Span(InputPartition):
    path: str
    low: int
    high: int | None


class FramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kind = options, options["format"]
        self.low, self.high = int(options.get("first", 0)), int(options["end"]) if "end" in options else None

    def partitions(self):
        """Spans of bytes, without a look into files."""
        step = int(self.options.get("span_bytes", 64 << 20))
        out = []
        for path, size in listed(self.options["path"]):
            cuts = [*range(0, max(size, 1), step), None]
            out += [Span(path, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        from cadenza.sources.files import file_system

        if not partition.path:
            return
        fs, inner = file_system(partition.path)
        with fs.open_input_file(inner) as file:
            known = layout_of(file, self.kind, partition.path, self.options)
            at, end = known.between(partition.low, partition.high)
            at, end = max(at, self.low), end if self.high is None else min(end, self.high)
            while at < end:
                to = min(max(bisect.bisect_right(range(end), known.place(at) + CHUNK, key=known.place) - 1, at + 1), at + 65536, end)
                first, last = known.start + known.place(at), known.start + known.place(to)
                yield known.rows(at, to, read_at(file, first, min(last, known.size) - first))
                at = to


class BoundedReader(FramesReader):
    """A reader that takes bounds of position from Spark's filters."""

    def _narrow(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    def pushFilters(self, filters):
        """Bounds of position are taken; all else is left to Spark."""
        for f in filters:
            own = getattr(f, "attribute", None) == ("position",)
            value = getattr(f, "value", None)
            if own and isinstance(f, In) and f.value and all(isinstance(v, int) for v in f.value):
                self._narrow(min(f.value), max(f.value) + 1)
                yield f  # which of them, Spark sees
            elif not own or not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self._narrow(value, value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._narrow(value + isinstance(f, GreaterThan), None)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self._narrow(0, value + isinstance(f, LessThanOrEqual))
            else:
                yield f


@dataclass
class Records(InputPartition):
    path: str
    version: int
    closed: bool
    skip: int
    first: int
    end: int


class IndexStream(DataSourceStreamReader):
    """Indexes that grow. An offset has, by file, how many whole records there are, and whether the footer has come: [records, closed, version, header]."""

    def __init__(self, options: dict):
        self.options, self.closed = options, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from cadenza.sources.files import file_system

        out = {}
        for path, size in listed(self.options["path"]):
            if path not in self.closed:
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as file:
                    size = file.size()
                    version, skip, count, closed = index_state(read_at(file, 0, 8), read_at(file, max(size - 64, 0), min(size, 64)), size)
                out[path] = [count, closed, version, skip]
                if closed:
                    self.closed[path] = out[path]
            else:
                out[path] = self.closed[path]
        return out

    def partitions(self, start: dict, end: dict) -> list[Records]:
        step = int(self.options.get("records_per_task", 1 << 20))
        out = []
        for path, (count, closed, version, skip) in end.items():
            done = start.get(path, [0])[0]
            out += [Records(path, version, closed, skip, a, min(a + step, count)) for a in range(done, count, step)]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        from cadenza.sources.files import RECORD, file_system

        fs, inner = file_system(partition.path)
        one = RECORD.itemsize
        with fs.open_input_file(inner) as file:
            for a in range(partition.first, partition.end, 65536):
                b = min(a + 65536, partition.end)
                yield _records(partition.path, partition.version, partition.closed, a, read_at(file, partition.skip + a * one, (b - a) * one))


@dataclass
class Parts(WriterCommitMessage):
    files: list[tuple[str, str, int]]


class FramesWriter(DataSourceArrowWriter):
    """Rows sorted by file and position become files: head of the first row, then payloads, then foot. Tasks write hidden files; the driver gives them their names once all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.foot, self.overwrite, self.job = options["path"].rstrip("/"), bytes.fromhex(options.get("foot", "")), overwrite, uuid.uuid4().hex

    def _hidden(self) -> str:
        return f"{self.root}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        from cadenza.sources.files import file_system

        fs, hidden = file_system(self._hidden())
        fs.create_dir(hidden, recursive=True)
        now, out, done = None, None, []
        for batch in iterator:
            for k in range(len(batch)):
                name = batch.column("file")[k].as_py()
                if name != now:
                    if out is not None:
                        out.write(self.foot)
                        out.close()
                    if name is None or "/" in name or name.startswith((".", "_")):
                        raise ValueError(f"no file can be named {name!r}")
                    now, part = name, f"{hidden}/{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part)
                    out.write(batch.column("head")[k].as_py() or b"")
                    done.append((part, name, 0))
                out.write(batch.column("payload")[k].as_py() or b"")
        if out is not None:
            out.write(self.foot)
            out.close()
        return Parts(done)

    def commit(self, messages: list[Parts | None]) -> None:
        from pyarrow.fs import FileType

        from cadenza.sources.files import file_system

        fs, root = file_system(self.root)
        parts = [f for m in messages if m for f in m.files]
        names = [name for _, name, _ in parts]
        there = [i.path for i in fs.get_file_info([f"{root}/{n}" for n in names]) if i.type != FileType.NotFound] if names else []
        if len(set(names)) < len(names) or there and not self.overwrite:
            self.abort(messages)
            raise ValueError("rows of a file lie in several tasks" if not there else f"there is a {there[0]}")
        fs.create_dir(root, recursive=True)
        for part, name, _ in parts:
            fs.move(part, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        from pyarrow.fs import FileType

        from cadenza.sources.files import file_system

        fs, hidden = file_system(self._hidden())
        if fs.get_file_info(hidden).type != FileType.NotFound:
            fs.delete_dir(hidden)


class FramesSource(DataSource):
    """Options: path, format (raw, aud, wav, awi), span_bytes, frame_bytes and header_bytes (raw without a header), first and end (positions), bounds (see read_filtered), fps_num and fps_den (wav), foot (writing)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _options(self) -> dict:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def schema(self) -> str:
        return SCHEMAS[self._options()["format"]]

    def reader(self, schema) -> FramesReader:
        own = self._options()
        return BoundedReader(own) if own.get("bounds") == "true" else FramesReader(own)

    def streamReader(self, schema) -> IndexStream:
        if self._options()["format"] != "awi":
            raise ValueError("only indexes are followed")
        return IndexStream(self._options())

    def writer(self, schema, overwrite: bool) -> FramesWriter:
        return FramesWriter(self._options(), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session."""
    spark.dataSource.register(FramesSource)
    return spark


def read_frames(spark: SparkSession, path: str, kind: str, first: int = 0, end: int | None = None, **options) -> DataFrame:
    """The frames of files, or of each file those from first to before end, whose bytes alone are then read; see SCHEMAS for the columns of each kind.

    Positions are bounded here and not by Spark's filters: this version of Spark keeps what a Python reader took of filters with the relation, so that of two scans of
    one DataFrame in a query both read what the last one asked for. For a DataFrame that is scanned once a query, read_filtered has bounds by filters.
    """
    more = {"first": first} | ({} if end is None else {"end": end})
    return register(spark).read.format(NAME).options(format=kind, **more, **options).load(path)


def read_filtered(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """read_frames with bounds of position taken from Spark's filters. Use the DataFrame for one scan only: see there."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return register(spark).read.format(NAME).options(format=kind, bounds="true", **options).load(path)


def follow_index(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of indexes that grow, each once, as a stream. A part of a record at the end waits for the rest."""
    return register(spark).readStream.format(NAME).options(format="awi", **options).load(path)


def await_closed(query, poll: float = 0.2, timeout: float | None = None) -> bool:
    """Wait until every index that a query follows is closed by its footer and read to the end, then stop the query. False after timeout seconds."""
    until = None if timeout is None else time.time() + timeout
    while query.isActive and (until is None or time.time() < until):
        last = query.lastProgress
        ends = last["sources"][0]["endOffset"] if last else None
        ends = ast.literal_eval(ends) if isinstance(ends, str) else ends  # as Python writes it
        if ends and all(state[1] for state in ends.values()) and not query.status["isDataAvailable"] and not query.status["isTriggerActive"]:
            query.stop()
            return True
        time.sleep(poll)
    if query.exception():
        raise query.exception()
    return False


def write_frames(rows: DataFrame, folder: str, foot: bytes = b"", overwrite: bool = False) -> None:
    """Files of a folder from rows of file, position, head and payload: all of them, or after a failure none.

    Rows are dealt out by file and sorted by Spark (which spills), and frames go to the file as they come; so a file may be larger than a task's memory. A file is one task's work.
    """
    dealt = rows.select(F.col("file").cast("string").alias("file"), F.col("position").cast("long").alias("position"), "head", "payload").repartition("file").sortWithinPartitions("file", "position")
    register(rows.sparkSession)
    dealt.write.format(NAME).mode("overwrite" if overwrite else "append").options(path=folder, format="raw", foot=foot.hex()).save()
