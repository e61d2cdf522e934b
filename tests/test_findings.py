"""What showed only on larger tables, on small ones cut so that it shows too."""

import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cadenza.model import Clip
from cadenza.operators import combine as C
from cadenza.operators import image as I
from cadenza.operators import waves as V
from cadenza.plans import registry
from cadenza.plans.base import plane_sums
from cadenza.sources import files, sinks, synthetic
from cadenza.streaming import ordered
from tests.compare import compare

SF = "/root/testdata/sf0.1"


def vectors(at, n):
    """A folder of tables that has the first n embeddings."""
    (at / str(n)).mkdir()
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < {n} ORDER BY vec_id) TO '{at}/{n}/embeddings.parquet' (FORMAT parquet)")
    return f"{at}/{n}"


def test_a_cycle_that_the_clip_ends_in(spark, tmp_path):
    for n in (51, 52, 53, 54):
        compare(spark, vectors(tmp_path, n), registry.QUERIES["locked_audio_cycles"], registry.ORACLE_SQL["locked_audio_cycles"])


def test_a_wav_file_is_written_by_one_task(spark, tmp_path):
    """Files of rows that lie in several input files, sizes small enough to be broadcast and samples not."""
    for k in range(4):
        spark.range(k * 25, k * 25 + 25).select(F.col("id").alias("position"), F.array_repeat(F.col("id") / 128, 64).alias("audio")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    small = {"spark.sql.autoBroadcastJoinThreshold": "2k", "spark.sql.files.openCostInBytes": "1m", "spark.sql.files.maxPartitionBytes": "1m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = spark.read.parquet(f"{tmp_path}/in/*")
        sinks.write_null(sinks.write_wav(df, f"{tmp_path}/out", "audio", 2, 800, 40))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    part = F.regexp_extract("path", r"part-(\d+)\.wav$", 1).cast("long")
    got = files.read_wav(spark, f"{tmp_path}/out").select((part * 40 + F.col("position")).alias("p"), "audio").orderBy("p").collect()
    assert [(r["p"], r["audio"]) for r in got] == [(k, [k / 128] * 64) for k in range(100)]


def test_silence_is_made_after_the_join(spark):
    """No join has blocks of samples in its rows; all kinds of muxer give them."""
    plan = registry.QUERIES["silence_source"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_repeat") < plan.index("Join") and plan.count("array_repeat") == 1
    video = Clip(spark.range(7).select(F.col("id").alias("position"), (F.col("id") * 2).alias("v")), 7)
    said = lambda *clips, **k: [(r["position"], r["v"], r["samples"], r["audio"] and len(r["audio"])) for r in C.muxer(*clips, **k).df.orderBy("position").collect()]
    cadence = [1600, 1602, 1602, 1602, 1602, 1600, 1602, 1602, 1602]
    silent = lambda n: synthetic.silence(spark, n, 48000, 2, (30000, 1001), "dv")
    assert said(video, silent(3)) == [(k, 2 * k, cadence[min(k, 2)], 2 * cadence[min(k, 2)]) for k in range(7)]
    assert said(silent(9), video) == [(k, 2 * min(k, 6), cadence[k], 2 * cadence[k]) for k in range(9)]
    assert said(video, silent(6), use_longest=False) == [(k, 2 * k, cadence[k], 2 * cadence[k]) for k in range(6)]
    assert said(video, silent(0)) == [(k, 2 * k, None, None) for k in range(7)]
    assert said(Clip(video.df.limit(0), 0), silent(2)) == [(0, None, 1600, 3200), (1, None, 1602, 3204)]
    mute = synthetic.silence(spark, 2, channels=0)
    assert said(video, mute, use_longest=False) == [(0, 0, 0, None), (1, 2, 0, None)]
    assert C.muxer(silent(2), video).df.columns == ["position", "samples", "audio", "v"]


def test_sums_of_a_large_picture(spark):
    """Time in proportion to the samples (with the square of them this takes minutes)."""
    own = bytes(np.random.default_rng(1).integers(0, 256, 512 * 512, np.uint8))
    picture = lambda *planes: ("rgb24p", 512, 512, list(planes))
    df = spark.createDataFrame([(0, picture(own, None, b"")), (1, None), (2, picture(b"ab", b"c", own))], f"position long, image {I.IMAGE}")
    began = time.time()
    got = [tuple(r) for r in plane_sums(df, 3).orderBy("position").collect()]
    assert time.time() - began < 45
    total, weighted = sum(own), sum(x * k for k, x in enumerate(own, 1))
    assert got == [(0, total, weighted, None, None, 0, 0), (1, *[None] * 6), (2, 195, 97 + 2 * 98, 99, 99, total, weighted)]


def test_waveforms_of_all_rows_at_once(spark):
    rng = np.random.default_rng(2)
    rows = [(k, None if k == 3 else rng.uniform(-1.2, 1.2, (0, 5, 64, 99)[k % 4]).tolist()) for k in range(12)]
    got = {r["position"]: r["image"] for r in I.visualise(spark.createDataFrame(rows, "position long, audio array<double>"), "audio", "image", 8, 6).collect()}
    for k, x in rows:
        want = np.full((6, 8), 16)
        for j in range(8) if x else ():
            a, b = len(x) * j // 8, len(x) * (j + 1) // 8
            part = np.clip(x[a : max(b, a + 1)], -1, 1)
            want[int((1 - part.max()) / 2 * 5) : int((1 - part.min()) / 2 * 5) + 1, j] = 235
        assert (got[k] and list(got[k]["planes"][0])) == (None if x is None else want.ravel().tolist()), k


def test_rows_without_pictures_are_drawn_where_they_are(spark):
    """Without pictures to hold no row is moved to a bucket's task; dots of several rows are those of each."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("position"), F.transform("embedding", lambda x: (x * 32767).cast("int")).alias("audio"))
    plan = V.waves(df, "audio", "image", 2, 24, 32, "rgb24p")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    rng = np.random.default_rng(3)
    for channels in (1, 2, 5):
        x = rng.integers(-32768, 32768, (4, 30, channels)).astype(float)
        for flag in (False, True):
            got, each = V.dots(x, 24, 40, flag), [V.dots(one, 24, 40, flag) for one in x]
            assert all((got[k][r] == each[r][k]).all() for k in range(3) for r in range(4))


def test_parts_for_each_channel_stay_in_their_rows(spark, tmp_path):
    """The scattered query has no exchange, and its rows are those of its SQL."""
    at = vectors(tmp_path, 130)
    assert "Exchange" not in registry.QUERIES["waves_scattered"](spark, at)._jdf.queryExecution().executedPlan().toString()
    compare(spark, at, registry.QUERIES["waves_scattered"], registry.ORACLE_SQL["waves_scattered"])


class Store:
    """A state store in memory that counts how often the carry is asked or written."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValueState(self, name, *schemas):
        return State(self, name)

    getMapState = getValueState


class State:
    def __init__(self, store, name):
        self.store, self.name, self.at = store, name, store.values.setdefault(name, {})

    def count(self):
        self.store.calls += self.name == "carry"

    def exists(self):
        return bool(self.at)

    def get(self):
        return self.at["value"]

    def update(self, value):
        self.at["value"] = value

    def keys(self):
        return iter(list(self.at))

    def containsKey(self, key):
        self.count()
        return key in self.at

    def getValue(self, key):
        self.count()
        return self.at[key]

    def updateValue(self, key, value):
        self.count()
        self.at[key] = value

    def removeKey(self, key):
        del self.at[key]


def folded(rows, step, columns, size, order, parts=8, most=1 << 17):
    """What the fold gives of rows cut into blocks that come in an order, a call for each list of them; and the calls of the carry."""
    store, out = Store(), []
    for numbers in order:
        fold = ordered._Folded("u", step, columns, parts, most)
        fold.init(store)
        frames = [pd.DataFrame({"block": [k], "rows": [ordered.packed(rows.iloc[k * size : (k + 1) * size])]}) for k in numbers]
        out += list(fold.handleInputRows((0,), iter(frames), None))
    return pd.concat(out), store.calls


def test_reblocking_asks_for_a_part_of_the_keys_once_for_many_blocks():
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"u": rng.integers(0, 300, 6000), "v": rng.normal(size=6000).round(3)})
    got, calls = folded(rows, ordered.reblock_step("u", "v", [3, 4]), ["u", "frame", "samples"], 100, [range(60)])
    assert calls <= 3 * 8  # 300 keys in 60 blocks were some 4,300 times 3
    for most, order in ((1 << 17, [range(60)]), (1000, [[5, 1, 0], range(59, 20, -1), range(20, 1, -1)]), (1, [[0, 0], range(60)])):
        got, _ = folded(rows, ordered.reblock_step("u", "v", [3, 4]), ["u", "frame", "samples"], 100, order, most=most)
        for u, own in rows.groupby("u")["v"]:
            left, frames = own.tolist(), []
            while len(left) >= (n := 3 + len(frames) % 2):
                frames, left = [*frames, left[:n]], left[n:]
            mine = got[got["u"] == u]
            assert mine["frame"].tolist() == list(range(len(frames))) and mine["samples"].tolist() == frames, (most, u)
    arrays = pd.DataFrame({"u": [1, 2, 1, 1, 2], "v": [[1.0, 2.0], [], [3.0], [4.0, 5.0, 6.0, 7.0], [8.0, 9.0, 10.0]]})
    got, _ = folded(arrays, ordered.reblock_step("u", "v", [3, 4]), ["u", "frame", "samples"], 2, [range(3)])
    assert sorted(zip(got["u"], got["frame"], got["samples"], strict=True)) == [(1, 0, [1, 2, 3]), (1, 1, [4, 5, 6, 7]), (2, 0, [8, 9, 10])]


def test_the_low_pass_of_many_keys_at_once():
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"u": rng.integers(0, 40, 700), "p": np.arange(700), "v": rng.normal(size=700).round(3)})
    for mag in (0, 1, 2, 3, 30):
        for most, order in ((1 << 17, [range(70)]), (25, [[1, 0], range(69, 1, -1)])):
            got, calls = folded(rows, ordered.lowpass_step("u", "p", "v", mag), ["u", "p", "filtered"], 10, order, most=most)
            assert most == 25 or calls <= 3 * 8
            got = got.sort_values("p")
            assert got["p"].tolist() == list(range(700)) and got["u"].tolist() == rows["u"].tolist()
            want = rows["v"] if mag <= 1 else 0.625 * (rows["v"] + 0.8 * rows.groupby("u")["v"].shift(mag).fillna(0))
            assert np.allclose(got["filtered"], want), (mag, most)


def test_keys_with_nulls_among_them():
    """A whole number, or a null, that nulls have made a float in one block goes on where it is none."""
    names = ordered._Folded("u", None, [], 4, 1)
    assert names._place(1.0) == names._place(1) != names._place(1.5) and names._place(float("nan")) == names._place(None)
