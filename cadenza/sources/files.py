"""Media files read by Spark: WAV (split among tasks by frames), raw pictures and samples, key-frame indexes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_KINDS = {(1, 16): "<i2", (1, 24): "i24", (1, 32): "<i4", (3, 32): "<f4", (65534, 16): "<i2", (65534, 24): "i24", (65534, 32): "<i4"}


def wav_header(raw: bytes) -> dict:
    """Format, channels, frequency, bits, and where the data is; sizes of an RF64 file from its ds64 part."""
    if raw[:4] not in (b"RIFF", b"RF64") or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, out, long_size = 12, {}, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"ds64":
            long_size = struct.unpack_from("<Q", raw, at + 16)[0]
        elif name == b"fmt ":
            out["format"], out["channels"], out["frequency"], _, _, out["bits"] = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            out["start"] = at + 8
            out["bytes"] = long_size if size == 0xFFFFFFFF and long_size is not None else size
            break
        at += 8 + size + size % 2
    return out


def decode(raw: bytes, kind: str) -> np.ndarray:
    """Samples as doubles in -1..1."""
    if kind == "i24":
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    x = np.frombuffer(raw[: len(raw) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], kind)
    return x.astype(np.float64) if kind == "<f4" else x / float(1 << (8 * x.dtype.itemsize - 1))


def file_system(path: str):
    """The file system of a path or URI as tasks see it, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:") or "://" not in path:
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(path)


def read_wav(spark: SparkSession, path: str, fps: tuple[int, int] = (25, 1), frames_per_task: int = 4096) -> DataFrame:
    """path, position, channels, frequency, samples (without padding) and audio per frame of each file.

    Headers are read first; then tasks read ranges of frames_per_task frames, so that a large file is split among them.
    """

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as f:
                    h = wav_header(f.read(1 << 16))
                    n = min(h["bytes"], f.size() - h["start"]) // (h["channels"] * h["bits"] // 8)
                rows.append((path, h["start"], n, h["channels"], h["frequency"], h["bits"], h["format"]))
            yield pd.DataFrame(rows, columns=["path", "start", "n", "channels", "frequency", "bits", "format"])

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                f, ch, width = int(r.frequency), int(r.channels), int(r.bits) // 8
                place = lambda p, f=f: p * f * fps[1] // fps[0]
                begin, end = place(r.first), min(place(r.last + 1), r.n)
                fs, inner = file_system(r.path)
                with fs.open_input_file(inner) as file:
                    file.seek(r.start + begin * ch * width)
                    x = decode(file.read((end - begin) * ch * width), SAMPLE_KINDS[r.format, r.bits])
                for a in range(r.first, r.last + 1, 256):
                    rows = []
                    for p in range(a, min(a + 256, r.last + 1)):
                        lo, hi = place(p), place(p + 1)
                        own = x[(lo - begin) * ch : (min(hi, end) - begin) * ch]
                        rows.append((r.path, p, ch, f, len(own) // ch, np.pad(own, (0, (hi - lo) * ch - len(own)))))
                    yield pd.DataFrame(rows, columns=["path", "position", "channels", "frequency", "samples", "audio"])

    files = spark.read.format("binaryFile").load(path).select("path")  # the content isn't read
    known = files.mapInPandas(heads, "path string, start long, n long, channels int, frequency int, bits int, format int")
    count = F.expr(f"(n * {fps[0]} + {fps[1]}L * frequency - 1) div ({fps[1]}L * frequency)")
    ranges = known.withColumn("count", count).where("count > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(frames_per_task).cast("long"))))
    ranges = ranges.withColumn("last", F.least(F.col("first") + frames_per_task, F.col("count")) - 1).drop("count")
    return ranges.repartition("path", "first").mapInPandas(frames, "path string, position long, channels int, frequency int, samples long, audio array<double>")


#: Bytes of an image by its format: samples of the planes for each pixel, as a fraction.
FRAME_BYTES = {"yuv420p": (3, 2), "yuv422p": (2, 1), "yuv444p": (3, 1), "grey8": (1, 1), "rgb24p": (3, 1)}
#: Bytes of a sample by its format.
SAMPLE_BYTES = {"pcm8": 1, "pcm16": 2, "pcm24": 4, "pcm32": 4, "float": 4}


def read_raw(spark: SparkSession, path: str, frame_bytes: int | None = None, header_bytes: int = 0, **bounds) -> DataFrame:
    """path, position and payload of files of frames of one size.

    Without frame_bytes a file begins with a line of name=value entries, whose pf, width and height give the size. Files are read by
    spans, with first and end only those frames of each; see datasource.
    """
    from cadenza.sources.datasource import read_frames

    return read_frames(spark, path, "raw", **({"frame_bytes": frame_bytes, "header_bytes": header_bytes} if frame_bytes else {}), **bounds)


def read_aud(spark: SparkSession, path: str) -> DataFrame:
    """path, position, channels, frequency, samples and payload (bytes) per frame of files of plain samples after a line of entries; read as read_raw does."""
    from cadenza.sources.datasource import read_frames

    return read_frames(spark, path, "aud")


#: Fixed layout of the records of a binary index, all big-endian: record, header and footer bytes by version.
RECORD = np.dtype([("type", ">u2"), ("frames", ">i2"), ("frame", ">i4"), ("offset", ">i8"), ("length", ">i4")])
INDEX_SIZES = {2: (8, 16), 3: (64, 20), 4: (20, 20)}


def index_version(head: bytes) -> int:
    """The version by the first 8 bytes; 0 if they aren't there yet."""
    if len(head) < 8:
        return 0
    version = 4 if head[:5] == b"\0\0AWI" else int(head[3:4]) if head[:3] == b"AWI" and head[3:4] in b"23" else 0
    if not version:
        raise ValueError("not an index")
    return version


def parse_index(raw: bytes) -> tuple[int, np.ndarray, bool]:
    """Version, records and whether the index is closed by a footer. A part of a record at the end of a growing file is left out."""
    raw = bytes(raw)
    version = index_version(raw[:8])
    if not version:
        return 0, np.zeros(0, RECORD), False
    head, foot = INDEX_SIZES[version]
    body = raw[head:]
    closed = len(body) >= foot and len(body) % RECORD.itemsize == foot % RECORD.itemsize and b"AWI" in body[-foot:] and body[-foot : 2 - foot or None] == b"\xff\xff"
    body = body[: len(body) - foot] if closed else body
    return version, np.frombuffer(body[: len(body) // RECORD.itemsize * RECORD.itemsize], RECORD), closed


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """frame, frames, offset and length of a key-frame index: binary files of any version, or Parquet by sinks.write_index."""
    if path.rstrip("/").endswith(".awi"):
        from cadenza.sources.datasource import read_frames

        return read_frames(spark, path, "awi").select("path", "version", "closed", "type", "frame", "frames", "offset", "length")
    return spark.read.parquet(path).select("frame", "frames", "offset", "length")
