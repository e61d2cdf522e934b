"""Where clips go: nowhere, frame files, binary indexes, WAV, raw pictures and samples."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_null(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def ppm_bytes(width: Column, height: Column, rgb: Column) -> Column:
    """A binary PPM image of packed 8-bit R'G'B' bytes."""
    head = F.encode(F.concat(F.lit("P6\n"), width.cast("string"), F.lit(" "), height.cast("string"), F.lit("\n255\n")), "US-ASCII")
    return F.concat(head, rgb)


def write_payloads(df: DataFrame, path: str, payload: str, frames_per_bucket: int = 1024) -> None:
    """Payloads as a Parquet table laid out by ranges of the position, so that readers skip by position."""
    df.withColumn("bucket", F.expr(f"position div {frames_per_bucket}")).repartition("bucket").sortWithinPartitions("position").select("position", payload).write.mode("overwrite").parquet(path)


def index_of(df: DataFrame, key: Column, size: Column) -> DataFrame:
    """The key-frame index of packets by position: frame, frames (to the next key frame), offset and length in bytes.

    Sizes of groups between key frames are aggregated first; the running byte offset is then taken over
    one row per key frame.
    """
    from cadenza.operators.windows import last_seen, running_sum

    marked = last_seen(df.select("position", F.when(key, F.col("position")).alias("_mark"), size.alias("_size")), "_mark", "frame")
    groups = marked.where("frame is not null").groupBy("frame").agg(F.count("*").alias("frames"), F.sum("_size").alias("length"))
    return running_sum(groups.withColumnRenamed("frame", "position"), "length", "offset", before=True).withColumnRenamed("position", "frame").select("frame", "frames", "offset", "length")


def write_index(index: DataFrame, path: str) -> None:
    index.sort("frame").write.mode("overwrite").parquet(path)


def wav_head(channels: int, frequency: int, data_bytes: int, bits: int = 16) -> bytes:
    """The header of a PCM file; from 4 GB on an RF64 one with 64-bit sizes."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, frequency, frequency * channels * bits // 8, channels * bits // 8, bits)
    if data_bytes + 36 < 1 << 32:
        return struct.pack("<4sI4s", b"RIFF", data_bytes + 36, b"WAVE") + fmt + struct.pack("<4sI", b"data", data_bytes)
    ds64 = struct.pack("<4sIQQQI", b"ds64", 28, data_bytes + 72, data_bytes, data_bytes // (channels * bits // 8), 0)
    return struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + ds64 + fmt + struct.pack("<4sI", b"data", 0xFFFFFFFF)


def wav_bytes(samples: Column) -> Column:
    """Doubles in -1..1 as 16-bit little-endian bytes."""
    byte = lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(255))), 2, "0")
    value = lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), (x * 32768).cast("int")))
    return F.unhex(F.array_join(F.transform(samples, lambda x: F.concat(byte(value(x)), byte(F.shiftright(value(x), 8)))), ""))


def write_wav(df: DataFrame, folder: str, audio: str, channels: int, frequency: int, frames_per_part: int = 4096) -> DataFrame:
    """A 16-bit WAV file part-N.wav for each frames_per_part frames; name and bytes of the files.

    A part's size is summed first, so its header (RF64 from 4 GB on) is written before the samples, which then go to the file
    as they come: the window spills, and no task holds a file. The window is also what keeps a part in one task: a repartition by the
    part behind a join by it is taken out of the plan, and the join's rows are then read as they were written.
    """
    part = F.expr(f"position div {frames_per_part}")
    rows = df.select(part.alias("part"), "position", wav_bytes(F.col(audio)).alias("raw"))
    whole = Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = rows.withColumn("total", F.sum(F.length("raw")).over(whole)).sortWithinPartitions("part", "position")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from cadenza.sources.files import file_system

        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        now, out, name, size, done = None, None, "", 0, []

        def close() -> None:
            out.close()
            fs.move(name, f"{root}/part-{now}.wav")
            done.append((f"part-{now}.wav", size))

        for batch in batches:
            for p, raw, total in zip(batch["part"], batch["raw"], batch["total"], strict=True):
                if p != now:
                    if out:
                        close()
                    now, name = p, f"{root}/.part-{p}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                    head = wav_head(channels, frequency, int(total))
                    out.write(head)
                    size = len(head)
                out.write(raw)
                size += len(raw)
        if out:
            close()
        yield pd.DataFrame(done, columns=["name", "bytes"])

    return ordered.mapInPandas(work, "name string, bytes long")


def raw_rows(df: DataFrame, image: str, file: str, pad: int = 0, header: bool = True, fps: tuple[int, int] = (25, 1), sar: tuple[int, int] = (1, 1)) -> DataFrame:
    """Rows for datasource.write_frames: raw pictures of the files named by the column file, after a line of entries. pad: zeros up to a multiple (without a header only)."""
    if pad and header:
        raise ValueError("a header and padding exclude each other")
    frame = F.aggregate(F.col(f"{image}.planes"), F.lit(b""), lambda a, b: F.concat(a, b))
    if pad:
        frame = F.concat(frame, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.length(frame), F.lit(pad)))))
    line = F.format_string(f"pf=%s width=%d height=%d fps_num={fps[0]} fps_den={fps[1]} sar_num={sar[0]} sar_den={sar[1]} field_order=0 pad={pad}\n", F.col(f"{image}.pf"), F.col(f"{image}.width"), F.col(f"{image}.height"))
    return df.select(F.col(file).cast("string").alias("file"), "position", (F.encode(line, "US-ASCII") if header else F.lit(b"")).alias("head"), frame.alias("payload"))


def aud_rows(df: DataFrame, audio: str, file: str, frequency: int, channels: int, fps: tuple[int, int], profile: str = "") -> DataFrame:
    """Rows for datasource.write_frames: 16-bit samples of the files named by the column file, after a line of entries."""
    line = f"af=pcm16 frequency={frequency} channels={channels} fps_num={fps[0]} fps_den={fps[1]}{f' profile={profile}' if profile else ''}\n"
    return df.select(F.col(file).cast("string").alias("file"), "position", F.lit(line.encode()).alias("head"), wav_bytes(F.col(audio)).alias("payload"))


def index_rows(index: DataFrame, file: str, version: int = 2) -> tuple[DataFrame, bytes]:
    """Rows and foot for datasource.write_frames: closed binary indexes (version 2, 3 or 4) of the files named by the column file, from rows of frame, frames, offset and length."""
    big = lambda c, digits: F.lpad(F.substring(F.hex(F.col(c).cast("long")), -digits, digits), digits, "0")
    kind = "0001" if version == 4 else "0000"
    record = F.unhex(F.concat(F.lit(kind), big("frames", 4), big("frame", 8), big("offset", 16), big("length", 8)))
    own = b"AWI" + str(version).encode()
    head = {2: own + bytes(4), 3: own + bytes(60), 4: b"\0\0" + own + bytes(14)}[version]
    foot = {2: b"\xff" * 8 + bytes(4) + own, 3: b"\xff\xff" + bytes(14) + own, 4: b"\xff\xff" + bytes(4) + own + bytes(10)}[version]
    return index.select(F.col(file).cast("string").alias("file"), F.col("frame").alias("position"), F.lit(head).alias("head"), record.alias("payload")), foot


def latest(df: DataFrame, key: str = "position", order: str = "version") -> DataFrame:
    """The last version of each position."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
