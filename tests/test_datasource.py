import hashlib
import os
import struct
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import IsNotNull

from cadenza.sources import datasource as D
from cadenza.sources import files, sinks
from cadenza.streaming import operators as O

FRAME = 1 << 20


@pytest.fixture
def reads(monkeypatch):
    seen = []
    real = D.read_at
    monkeypatch.setattr(D, "read_at", lambda file, offset, size: (seen.append((offset, size)), real(file, offset, size))[1])
    return seen


def planned(path, kind, filters=(), **options):
    reader = D.BoundedReader({"path": str(path), "format": kind} | {k: str(v) for k, v in options.items()})
    return reader, list(reader.pushFilters(list(filters))), reader.partitions()


def test_a_filter_reads_its_bytes_only(spark, tmp_path, reads):
    """A raw file of 3 GB, mostly a hole: 48 spans; of these one reads two frames, the others their header."""
    path = tmp_path / "large.raw"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
        f.seek(2000 * FRAME)
        f.write(b"x" * FRAME)
    reader, left, spans = planned(path, "raw", [D.GreaterThanOrEqual(("position",), 2000), D.LessThan(("position",), 2002)], frame_bytes=FRAME)
    assert left == [] and len(spans) == 48 and len({(s.low, s.high) for s in spans}) == 48
    rows = [r for s in spans for b in reader.read(s) for r in b.select(["position", "payload"]).to_pylist()]
    assert [r["position"] for r in rows] == [2000, 2001] and rows[0]["payload"] == b"x" * FRAME
    assert sum(size for _, size in reads if size != D.HEADER) == 2 * FRAME and sum(size == D.HEADER for _, size in reads) == 48
    df = files.read_raw(spark, str(path), FRAME, first=2000, end=2002)
    assert df.rdd.getNumPartitions() == 48
    assert [tuple(r) for r in df.select("position", F.sha2("payload", 256)).collect()][0] == (2000, hashlib.sha256(b"x" * FRAME).hexdigest())
    once = D.read_filtered(spark, str(path), "raw", frame_bytes=FRAME).where("position > 3069").select("position")
    assert sorted(r[0] for r in once.collect()) == [3070, 3071]


def test_filters_that_arent_bounds_stay(tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes(100))
    kept = [D.In(("position",), (3, 7)), D.EqualTo(("path",), "x"), IsNotNull(("position",))]
    reader, left, spans = planned(tmp_path, "raw", [*kept, D.GreaterThan(("position",), 3)], frame_bytes=10)
    assert left == kept and (reader.low, reader.high) == (4, 8)


def test_filters_of_one_query_are_not_those_of_the_next(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes(1000))
    df = files.read_raw(spark, str(tmp_path), 10)
    two, three = df.where("position = 20"), df.where("position = 30 or position = 2")
    assert [x.count() for x in (df, two, df, three, df, two.union(three), two.unionAll(df), df.where("position > 97 or position in (1, 5)"), two, df.where("path is null"), df)] == [100, 1, 100, 2, 100, 3, 101, 4, 1, 0, 100]
    assert two.join(df, "path").count() == 100


def test_frames_fall_in_one_span_each(spark, tmp_path):
    """Sample frames of changing size, cut at every byte count."""
    head = b"af=pcm16 frequency=48000 channels=2 fps_num=30000 fps_den=1001 profile=dv\n"
    data = np.random.default_rng(0).integers(0, 256, 4 * 20_000 + 3, np.uint8).tobytes()
    (tmp_path / "a.aud").write_bytes(head + data)
    (tmp_path / "none.aud").write_bytes(head)
    cycle, want, at = [1600, 1602, 1602, 1602, 1602], [], 0
    while at < 20_000:
        n = min(cycle[len(want) % 5], 20_000 - at)
        want.append((len(want), n, data[at * 4 : (at + n) * 4]))
        at += n
    for span in (999, 6400, 70_000, 1 << 30):
        reader, _, spans = planned(tmp_path, "aud", span_bytes=span)
        got = sorted((r["position"], r["samples"], r["payload"]) for s in spans for b in reader.read(s) for r in b.to_pylist())
        assert got == want
    assert files.read_aud(spark, str(tmp_path)).count() == len(want)


def test_wav_is_as_by_ranges(spark, tmp_path):
    x = (np.sin(np.arange(30_010) / 9) * 20000).astype("<i2")
    (tmp_path / "a.wav").write_bytes(sinks.wav_head(2, 1000, len(x) * 2) + x.tobytes())
    one = {r["position"]: (r["samples"], r["audio"]) for r in files.read_wav(spark, str(tmp_path), (30000, 1001)).collect()}
    two = {r["position"]: (r["samples"], r["audio"]) for r in D.read_frames(spark, str(tmp_path), "wav", fps_num=30000, fps_den=1001, span_bytes=1000).collect()}
    assert one == two and len(one) > 400


def test_empty_folders_and_missing_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_hidden").write_bytes(b"x")
    assert D.read_frames(spark, str(tmp_path / "in"), "aud").count() == 0
    with pytest.raises(Exception, match="FileNotFound|missing"):
        D.read_frames(spark, str(tmp_path / "missing"), "aud").count()


def test_writing_commits_all_or_nothing(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), (99 - F.col("id")).alias("position"), F.lit(b"H").alias("head"), F.encode(F.lpad((99 - F.col("id")).cast("string"), 2, "0"), "US-ASCII").alias("payload"))
    D.write_frames(rows, str(tmp_path / "out"), foot=b"F")
    want = {f"f{k}": b"H" + b"".join(b"%02d" % p for p in range(100) if (99 - p) % 3 == k) + b"F" for k in range(3)}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == want
    with pytest.raises(Exception, match="there is a"):
        D.write_frames(rows, str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == want
    D.write_frames(rows.where("position < 3"), str(tmp_path / "out"), overwrite=True)
    assert sorted(p.stat().st_size for p in (tmp_path / "out").iterdir()) == [3, 3, 3]
    # A row in the middle of a file fails: no file is there, nor a part of one.
    bad = rows.withColumn("payload", F.when(F.col("position") == 57, F.raise_error(F.lit("broken"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="broken"):
        D.write_frames(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or list((tmp_path / "bad").iterdir()) == []
    with pytest.raises(Exception, match="no file can be named"):
        D.write_frames(rows.withColumn("file", F.lit("../up")), str(tmp_path / "bad"))


def record(k):
    return struct.pack(">hhiqi", 0, 12, 12 * k, 100 * k, 100)


@pytest.mark.parametrize("version", [2, 3, 4])
def test_a_growing_index_is_followed_to_its_footer(spark, tmp_path, version):
    (tmp_path / "in").mkdir()
    own = b"AWI" + str(version).encode()
    head = {2: own + bytes(4), 3: own + bytes(60), 4: b"\0\0" + own + bytes(14)}[version]
    foot = {2: b"\xff" * 8 + bytes(4) + own, 3: b"\xff\xff" + bytes(14) + own, 4: b"\xff\xff" + bytes(4) + own + bytes(10)}[version]
    whole = {name: head + b"".join(record(k) for k in range(n)) + foot for name, n in (("a.awi", 40), ("b.awi", 7))}

    def grow():
        for name, data in whole.items():
            for a in range(0, len(data), 67):  # cuts in the midst of records and of the footer
                with open(tmp_path / "in" / name, "ab") as f:
                    f.write(data[a : a + 67])
                    f.flush()
                time.sleep(0.4)

    (tmp_path / "in" / "a.awi").write_bytes(b"")
    (tmp_path / "in" / "b.awi").write_bytes(b"")
    got, batches = [], []
    stream = D.follow_index(spark, str(tmp_path / "in"), records_per_task=5)
    query = O.started(stream.writeStream.foreachBatch(lambda b, n: (got.extend(b.collect()), batches.append(n))).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds"))
    writer = threading.Thread(target=grow)
    writer.start()
    try:
        assert D.await_closed(query, timeout=90)
    finally:
        query.stop()
        writer.join()
    assert not query.isActive and len(batches) > 1
    assert sorted((os.path.basename(r["path"]), r["position"], r["frame"], r["offset"]) for r in got) == [(n, k, 12 * k, 100 * k) for n, m in (("a.awi", 40), ("b.awi", 7)) for k in range(m)]
    assert {r["version"] for r in got} == {version}
