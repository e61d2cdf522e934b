import random
import zlib
from collections import defaultdict

import pytest

from cadenza.llm import sharding
from cadenza.llm.sharding import greedy, shard_documents, smallest_capacity


def brute_capacity(sizes, shards):
    """The least maximum over all contiguous partitions, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        after = [0] + [float("inf")] * len(sizes)
        for i in range(1, len(sizes) + 1):
            total = 0
            for j in range(i, 0, -1):
                total += sizes[j - 1]
                after[i] = min(after[i], max(best[j - 1], total))
        best = after
    return best[-1]


def test_capacity_is_the_least():
    rnd = random.Random(1)
    for _ in range(60):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 14))]
        shards = rnd.randint(1, 6)
        c = smallest_capacity(sizes, shards)
        assert c == brute_capacity(sizes, shards)
        assert len(greedy(sizes, c)) <= shards


def test_refined_cuts_equal_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 16)
    rnd = random.Random(2)
    for n, shards in ((1, 3), (7, 3), (300, 7), (400, 24)):
        keys = sorted(rnd.sample(range(-(10**6), 10**6), n))
        sizes = [rnd.choice([1, 5, 9, 200]) for _ in keys]
        cuts = sharding.cut_keys(spark.createDataFrame(list(zip(keys, sizes)), "key long, size long"), shards)
        plain = greedy(sizes, smallest_capacity(sizes, shards))
        shares = [sum(sizes[a:b]) for a, b in zip(plain, [*plain[1:], n])]
        at = [keys.index(c) for c in cuts]
        assert max(sum(sizes[a:b]) for a, b in zip(at, [*at[1:], n])) == max(shares)


def check(rows, shards, got):
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    slots = defaultdict(list)
    where = defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        if len(texts[r["doc_id"]]) == 1:
            t = texts[r["doc_id"]][0]
            assert r["size"] == len((t or "").encode()) + 8
            assert r["text_crc32"] == zlib.crc32((t or "").encode())
            where[t].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= s < shards for s in slots)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = shard_documents(docs, 8, block_rows=5).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], 8, got)
    load = defaultdict(int)
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= sum(load.values()) / 8 + max(r["size"] for r in got) * 4


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (1, None), (2, ""), (3, "é" * 9), (3, "x")], [(k, "same") for k in range(40)] + [(k, f"t{k}") for k in range(40, 60)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size")
    check(rows, 4, shard_documents(df, 4, block_rows=3).collect())


def test_a_group_above_the_share_has_its_own_shard(spark):
    rows = [(k, "y" * 92) for k in range(30)] + [(100 + k, f"{k:092d}") for k in range(30)]
    load = defaultdict(int)
    for r in shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect():
        load[r["shard"]] += 1
    assert sorted(load.values()) == [10, 10, 10, 30]
