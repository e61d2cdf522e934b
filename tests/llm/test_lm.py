import math
import re
import zlib
from collections import Counter

import numpy as np

from cadenza.llm import lm


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


def brute_model(texts):
    uni, pairs = Counter(), Counter()
    for t in texts:
        w = words(t)
        uni.update(w)
        pairs.update(zip(["<s>", *w], w))
    ctx = Counter()
    for (a, _), n in pairs.items():
        ctx[a] += n
    follows = Counter(b for _, b in pairs)
    cc = lambda c: [sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]
    d1, d2 = lm.discounts(cc(follows)), lm.discounts(cc(pairs))
    off = lambda d, n: ([0.0, *d])[min(n, 3)]
    total = len(pairs)
    spare = sum(off(d1, n) for n in follows.values()) / total
    p1 = lambda w: max(follows[w] - off(d1, follows[w]), 0) / total + spare / (len(uni) + 1)

    left = Counter()
    for (a, _), n in pairs.items():
        left[a] += off(d2, n)

    def p(a, w):
        if not ctx[a]:
            return p1(w)
        gamma = left[a] / ctx[a]
        return max(pairs[a, w] - off(d2, pairs[a, w]), 0) / ctx[a] + gamma * p1(w)

    return uni, p


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(999, "a very long text of words that come again " * 20_000)] + [(1000, None), (1001, ""), (1002, "never seen zzzqqq")]
    learnt = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score")
    from pyspark.sql import functions as F

    for shard_tokens in (10**7, 500):
        model = lm.train(df.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0), shard_tokens=shard_tokens)
        uni, p = brute_model(learnt)
        n, v = sum(uni.values()), len(uni)
        assert (model.tokens, model.words) == (n, v)
        got = {r["doc_id"]: r for r in lm.score_documents(df, model, batch_tokens=700).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            w = words(t)
            assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(x in uni for x in w)
            assert math.isclose(got[i]["base_score"], sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
            if len(w) < 200 or i == 999:
                assert math.isclose(got[i]["score"], sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w)), rel_tol=1e-6)
        for a in ["<s>", *list(uni)[:3]]:
            assert math.isclose(sum(p(a, b) for b in [*uni, "?unknown?"]), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = lm.train(df.limit(0))
    got = lm.score_documents(df, model).collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert lm.score_documents(df.limit(0), model).count() == 0


def test_large_counts(spark):
    df = spark.createDataFrame([(1, "a b " * 1000)], "doc_id long, text string")
    model = lm.train(df)
    a, b = (lm.WordHashes()(w)[:1] for w in ("a", "b"))
    assert model.pair_counts_of(lm.mixed(a, b)).tolist() == [1000]
    assert model.word_stats(np.sort(a))[0].tolist() == [1000]


def test_maps_are_bounded_and_no_row_is_empty(spark):
    df = spark.createDataFrame([(k, f"w{k} x y w{k + 1}") for k in range(200)], "doc_id long, text string")
    few, many = lm.train(df), lm.train(df, shard_tokens=5)
    many.most_open = 2
    h = [lm.WordHashes()(f"w{k} x zz y") for k in range(150)]
    for a, b in zip(few.score(h), many.score(h)):
        assert np.allclose(a, b)
    assert many.shards > 50 and len(many._maps) <= 2
    texts = df.select("text").coalesce(1)
    blobs = texts.mapInArrow(lm._pair_counts(1 << 14), "shard int, blob binary").collect()
    assert 0 < len(blobs) <= 900 and all(r["blob"] for r in blobs)
