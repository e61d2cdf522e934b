"""Time, spans, audio, images, files: against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import span as S
from cadenza.functions import text as X
from cadenza.functions import timecode as T
from cadenza.functions import words as W
from cadenza.operators import audio as A
from cadenza.operators import image as I
from cadenza.operators import payload as P
from cadenza.sources import files, sinks, synthetic
from cadenza.sources.registry import default_registry


@pytest.mark.parametrize("rate,drop", [("movie", False), ("pal", False), ("pal_50", False), ("ntsc", False), ("ntsc", True), ("ntsc_60", False), ("ntsc_60", True)])
def test_timecodes_of_hours(spark, rate, drop):
    r, _, d = T.RATES[rate]
    n = 60 * 60 * 2 * r
    df = spark.range(n).select("id", *(v.alias(k) for k, v in T.to_timecode(F.col("id"), rate, drop).items()))
    df = df.withColumn("again", T.from_timecode(*(F.col(k) for k in "hmsf"), rate, drop))
    assert df.where("again <> id").count() == 0
    h = m = s = f = 0
    some = {r_["id"]: tuple(r_[k] for k in "hmsf") for r_ in df.where(f"id < {12 * 60 * r} or id > {n - 5}").collect()}
    for k in range(12 * 60 * r):
        assert some[k] == (h, m, s, f)
        f += 1
        if f == r:
            f, s = 0, s + 1
            if s == 60:
                s, m = 0, m + 1
                if drop and d and m % 10:
                    f = d


def test_known_conversions(spark):
    row = spark.range(1).select(*(T.convert_frames(F.lit(n), (25, 1), (30000, 1001)).alias(f"a{n}") for n in (250, 2500, 25000))).first()
    assert tuple(row) == (299, 2997, 29970)
    n = synthetic.silence(spark, 5, fps=(30000, 1001)).df.agg(F.sum("samples"), F.sum(F.size("audio"))).first()
    assert tuple(n) == (8008, 16016)
    assert synthetic.silence(spark, 2, channels=0).df.where("audio is null").count() == 2


def test_cadence_adds_up(spark):
    for freq in (48000, 44100, 32000):
        for fps in ((24, 1), (25, 1), (30000, 1001), (60000, 1001)):
            for profile in ("", "dv"):
                got = spark.range(400).select("id", T.samples_for_frame(F.col("id"), freq, fps, profile).alias("n"), T.samples_to_frame(F.col("id"), freq, fps, profile).alias("s")).orderBy("id").collect()
                total = 0
                for r in got:
                    assert r["s"] == total
                    total += r["n"]


def test_spans(spark):
    lit = lambda a, n: (F.lit(a), F.lit(n))
    row = spark.range(1).select(S.intersection(lit(0, 250), lit(100, 300)).alias("i"), S.union(lit(0, 250), lit(100, 300)).alias("u"), S.subtraction(lit(0, 250), lit(100, 300)).alias("s"), S.subtraction(lit(0, 250), lit(50, 10)).alias("t"), S.intersection(lit(0, 5), lit(5, 5)).alias("none"), S.subtraction(lit(3, 2), lit(0, 9)).alias("gone")).first()
    assert tuple(row["i"]) == (100, 150) and tuple(row["u"]) == (0, 400)
    assert [tuple(x) for x in row["s"]] == [(0, 100)] and [tuple(x) for x in row["t"]] == [(0, 50), (60, 190)]
    assert row["none"] is None and row["gone"] == []


def test_words(spark):
    row = spark.range(1).select(W.div(F.lit(1), F.lit(0)).alias("inf"), W.div(F.lit(0), F.lit(0)).alias("nan"), W.mod(F.lit(-7), F.lit(3)).alias("mod"), W.compare(F.lit("10"), ">", F.lit("9")).alias("n"), W.compare(F.lit("10"), ">", F.lit("9a")).alias("t"), W.pack_get(F.array(F.lit(1), F.lit(2)), -1).alias("g"), W.pack_remove(F.array(F.lit(1), F.lit(2)), -1).alias("r"), W.pack_average(F.array(F.lit(1), F.lit(2))).alias("a"), X.parse_bool(F.lit("is True")).alias("b"), X.parse_list(F.lit("1:x:3"), "int").alias("l")).first()
    assert row["inf"] == math.inf and math.isnan(row["nan"]) and row["mod"] == -1.0
    assert (row["n"], row["t"], row["g"], row["r"], row["a"], row["b"], row["l"]) == (1, 0, 2, [1], 1.5, True, [1, None, 3])


def test_audio(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 40)
    df = spark.createDataFrame([(x.tolist(), x[::-1].tolist())], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(A.mix(a, b).alias("mix"), A.volume(a, 0.5, 0.5).alias("vol"), A.reverse(a, 2).alias("rev"), A.pitch(a, 30).alias("pitch"), A.combine([A.channel_extract(a, 2, 0), A.channel_extract(a, 2, 1)]).alias("same"), A.convert(F.array(F.lit(1.2), F.lit(-1.2)), "float", "pcm32").alias("cut"), A.channel_convert(a, 2, 1).alias("mono"), A.mix(a, F.array(F.lit(1.0))).alias("none"), A.channel_place(a, 2, 1).alias("placed")).first()
    y = x[::-1]
    assert np.allclose(row["mix"], np.where((x < 0) & (y < 0), x + y + x * y, x + y - x * y))
    k, state, want = math.exp(-math.pi), 0.0, []
    for v in x * 0.5:
        state = (1 - k) * v + k * state
        want.append(state)
    assert np.allclose(row["vol"], want, atol=1e-14)
    assert np.allclose(row["rev"], x.reshape(-1, 2)[::-1].ravel()) and np.allclose(row["same"], x) and row["none"] is None
    assert len(row["pitch"]) == 30 and row["pitch"][-1] == x[-1] and row["cut"] == [2**31 - 1, -(2**31)]
    assert len(row["mono"]) == 20 and row["placed"][1::2] == x.tolist()


def test_interpolation_and_geometry(spark):
    p = F.col("id")
    rows = spark.range(10).select(P.lerp(p, 10, "0:9").alias("a"), P.lerp(p, 10, "5:7:3:3").alias("b"), P.lerp(p, 10, "word:2:4").alias("c"), P.bezier(p, 10, [(0, 0), (0, 0), (1, 1), (1, 1)])[0].alias("x")).collect()
    assert [r["a"] for r in rows] == [float(k) for k in range(10)] and rows[3]["b"] == 5.0 and rows[4]["b"] is None
    assert [r["c"] for r in rows] == [None] * 2 + ["word"] * 3 + [None] * 5 and (rows[0]["x"], rows[9]["x"]) == (0.0, 1.0)
    g = spark.range(1).select(*(v.alias(k) for k, v in P.geometry("letter", (F.lit(1600), F.lit(900)), (640, 480)).items())).first()
    assert (g["w"], g["h"], g["x"], g["y"]) == (640, 360, 0, 60)
    with pytest.raises(ValueError):
        P.remove(spark.range(1), "image")


def test_images(spark):
    rng = np.random.default_rng(2)
    planes = [rng.integers(0, 256, s).astype(np.uint8) for s in I.plane_shapes("yuv420p", 8, 6)]
    df = spark.createDataFrame([(1, ("yuv420p", 8, 6, [p.tobytes() for p in planes])), (2, None)], f"id int, image {I.IMAGE}")

    def run(kernel):
        got = {r["id"]: r["image"] for r in I.apply(df, "image", kernel).collect()}
        assert got[2] is None
        x = got[1]
        return [np.frombuffer(p, np.uint8).reshape(s) for p, s in zip(x["planes"], I.plane_shapes(x["pf"], x["width"], x["height"]))], x

    assert (run(I.invert(1))[0][0] == 255 - planes[0]).all()
    assert set(run(I.mono(128))[0][0].ravel()) <= {16, 235}
    assert run(I.rescale(4, 4))[1]["width"] == 4 and run(I.crop(2, 2, 4, 2))[0][0].tolist() == planes[0][2:4, 2:6].tolist()
    assert (run(I.chroma())[0][1] == 128).all() and run(I.chroma_key())[1]["pf"] == "grey8"
    assert (I.swap_fields(I.swap_fields(planes, "yuv420p")[0], "yuv420p")[0][0] == planes[0]).all()
    flat = [np.full((4, 4), 100, np.uint8), np.full((2, 2), 120, np.uint8), np.full((2, 2), 140, np.uint8)]
    back = I.colour_space("yuv420p")(*I.colour_space("rgb24p")(flat, "yuv420p"))[0]
    assert all(abs(int(a[0, 0]) - int(b[0, 0])) <= 2 for a, b in zip(flat, back))
    coded = I.write_codes(spark.createDataFrame([(k, ("grey8", w, h, [bytes(w * h)]), n) for k, (w, h, n) in enumerate([(400, 2, 123456789), (20, 16, (1 << 32) - 2), (64, 4, 7)])], f"position int, image {I.IMAGE}, n long"), "image", "n")
    rows = I.read_codes(coded, "image", "code").orderBy("position").collect()
    assert [r["code"] for r in rows] == [123456789, (1 << 32) - 2, None]
    y = np.frombuffer(rows[0]["image"]["planes"][0], np.uint8)
    assert set(y[:320].tolist()) == {16, 235} and not y[320:].any() and (y[:160] + y[160:320] == 251).all()
    for damaged, code in (((0, 2), 123456789), ((0, 3), None), ((200, 203), None)):  # the majority of five counts
        z = y.copy()
        z[slice(*damaged)] = 251 - z[slice(*damaged)]
        assert I.read_code(z) == code
    assert I.waveform(np.sin(np.arange(500) / 9)).shape == (32, 64) and I.correction()(planes, "yuv420p")[0][0].tolist() == (planes[0].astype(int) * 255 >> 8).tolist()
    assert I.deinterlace(planes, "yuv420p")[0][0][0].tolist() == planes[0][0].tolist()
    drawn = I.charcoal()([np.full((4, 4), 9, np.uint8), planes[1]], "yuv420p")[0]
    assert drawn[0][1:3, 1:3].tolist() == [[235, 235]] * 2 and drawn[0].sum() == 4 * 235 + 12 * 16 and drawn[1] is planes[1]
    assert I.charcoal()([np.full((2, 4), 9, np.uint8)], "grey8")[0][0].tolist() == [[16] * 4] * 2
    part = I.invert(3, 0.5, 0.5, 0.5, 0.5)(planes, "yuv420p")[0]
    assert (part[0][3:, 4:] == 255 - planes[0][3:, 4:]).all() and (part[0][:3] == planes[0][:3]).all() and (part[1][1:, 2:] == 255 - planes[1][1:, 2:]).all() and (part[2] == planes[2]).all()
    assert (I.mono(128, chroma=1)(planes, "yuv420p")[0][1] == planes[1]).all()
    masked = spark.createDataFrame([(0, ("grey8", 8, 6, [bytes(range(48))])), (1, None), (2, ("grey8", 4, 3, [bytes([9] * 12)]))], f"id int, alpha {I.IMAGE}").join(df.where("id = 1").select("image"))
    out = {r["id"]: np.frombuffer(r["alpha"]["planes"][0], np.uint8).reshape(6, 8) for r in I.key_alpha(masked, "image", "alpha", 128, 128, 60).collect()}
    hit = I.chroma_key(128, 128, 60)(planes, "yuv420p")[0][0] == 0
    assert hit.any() and not hit.all() and all((out[k] == np.where(hit, 0, base)).all() for k, base in ((0, np.arange(48).reshape(6, 8)), (1, 255), (2, 9)))
    assert I.blend(planes[0], np.full((2, 2), 9, np.uint8), np.full((2, 2), 255, np.uint8), 1, 1)[1:3, 1:3].tolist() == [[9, 9], [9, 9]]


def test_wav_files_and_registry(spark, tmp_path):
    x = (np.sin(np.arange(96000) / 20) * 0.5).reshape(-1, 2)
    raw = (x * 32768).astype("<i2").tobytes()
    (tmp_path / "a.wav").write_bytes(sinks.wav_head(2, 48000, len(raw)) + raw)
    got = default_registry().open(spark, str(tmp_path / "a.wav")).orderBy("position").collect()
    assert len(got) == 25 and sum(r["samples"] for r in got) == 48000
    assert np.allclose(np.concatenate([r["audio"] for r in got]), (x * 32768).astype("<i2").ravel() / 32768)
    assert files.wav_header(sinks.wav_head(2, 48000, 1 << 33) + b"x")["bytes"] == 1 << 33
    for kind, data in (("i24", b"\x00\x00\x40\x00\x00\xc0"), ("<f4", np.array([0.5, -0.5], "<f4").tobytes())):
        assert files.decode(data, kind).tolist() == [0.5, -0.5]
    clip = spark.createDataFrame([(0, [0.5, -0.5]), (1, [0.25, -1.0])], "position long, audio array<double>")
    assert [tuple(r) for r in sinks.write_wav(clip, str(tmp_path / "parts"), "audio", 1, 8000).collect()] == [("part-0.wav", 52)]
    wav = (tmp_path / "parts" / "part-0.wav").read_bytes()
    h = files.wav_header(wav)
    assert files.decode(wav[h["start"] :][: h["bytes"]], "<i2").tolist() == [0.5, -0.5, 0.25, -1.0]
    (tmp_path / "b.raw").write_bytes(b"HD" + b"abcd" + b"efgh")
    assert [bytes(r["payload"]) for r in files.read_raw(spark, str(tmp_path / "b.raw"), 4, 2).orderBy("position").collect()] == [b"abcd", b"efgh"]
    with pytest.raises(LookupError):
        default_registry().find("film.mov")
    assert default_registry().open(spark, "colour:", rows=3).length == 3
    ppm = spark.range(1).select(sinks.ppm_bytes(F.lit(1), F.lit(1), F.lit(b"abc"))).first()[0]
    assert bytes(ppm) == b"P6\n1 1\n255\nabc"
