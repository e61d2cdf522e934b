import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import simhash
from corpus_pipeline import NEAR_BITS


def brute_fingerprint(text, width=4, seed=42):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, most):
    ids = [i for i, _ in prints]
    parent = dict(zip(ids, ids))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= most:
                x, y = find(prints[a][0]), find(prints[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(prints, 4)
    got = simhash.near_duplicates(docs, 4, 4).collect()
    assert {r["doc_id"]: r["f0"] % (1 << 64) for r in got} == dict(prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("most,words", [(4, 1), (1, 1), (24, 2)])
def test_pairs_are_those_of_all_pairs(most, words):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 1 << 63, (40, words), dtype=np.uint64)
    f = np.concatenate([base, base, base])
    for k in range(len(f)):
        for b in rng.integers(0, 64 * words, rng.integers(0, most + 2)):
            f[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    group = rng.integers(0, 3, len(f))
    found = {(a, b) for x, y in simhash.near_pairs(group, f, most, chunk=50) for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a in range(len(f)) for b in range(a + 1, len(f)) if group[a] == group[b] and sum(int(np.bitwise_count(f[a, w] ^ f[b, w])) for w in range(words)) <= most}
    equal = {(a, b) for a, b in want if (f[a] == f[b]).all()}
    assert found <= want and want - equal <= found | {(a, b) for a, b in want - equal}
    from cadenza.llm.common import roots

    split = lambda pairs: roots(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int), len(f)).tolist()
    assert split(sorted(found)) == split(sorted(want))


@pytest.mark.parametrize("rows", [100, 10**7, 10**10])
def test_some_mask_shows_a_near_pair_equal(rows):
    rng = np.random.default_rng(5)
    masks = simhash.pigeonhole_masks(4, rows)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.permutation(64)[:4])
        assert any(flips & m[0] == 0 for m in masks)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (5, "two words"), (None, "nobody else says this at all"), (6, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as f0", "2 as component_id")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 6)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_chains_are_one_component(spark):
    from cadenza.llm.common import components

    links = [(k, k + 1) for k in range(1000, 1090)] + [(5, 1040), (7, 8), (8, 7), (9, 9), (None, 1)]
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 5 for k in [5, *range(1000, 1091)]} | {7: 7, 8: 7}


def test_a_node_of_many_rows_is_dealt_out(spark):
    """Chains, dense clusters and strangers of one node, by both ways, against all pairs."""
    rng = np.random.default_rng(9)
    rows = [int(x) for x in rng.integers(0, 1 << 40, 30)]
    for k in range(6):  # a dense cluster and a chain of steps of 4 bits
        base = int(rng.integers(0, 1 << 40))
        rows += [base ^ (1 << int(b)) for b in rng.permutation(40)[:25]]
        for _ in range(25):
            base ^= sum(1 << int(b) for b in rng.permutation(40)[:4])
            rows.append(base)
    rows = sorted(set(rows))
    rng.shuffle(rows)
    prints = list(enumerate(rows))
    df = spark.createDataFrame(prints, "id long, f0 long")
    want = brute_components(prints, 4)
    for node_rows in (4096, 40):
        links = simhash.near_links(df, [(1 << 63,)], 4, 1, node_rows=node_rows)
        from cadenza.llm.common import components

        got = {r["node"]: r["component_id"] for r in components(links).collect()}
        assert {i: got.get(i, i) for i in want} == want
    labelled = df.selectExpr("*", "cast(if(id < 150, 0, id) as long) as label")
    known = labelled.selectExpr("id as a", "label as b")
    for node_rows in (4096, 40):
        got = {r["node"]: r["component_id"] for r in components(simhash.near_links(labelled, [(1 << 63,)], 4, 1, node_rows=node_rows).unionAll(known)).collect()}
        joined = brute_components(prints + [], 4)
        low = {joined[i] for i in range(150)}
        assert {i: got.get(i, i) for i in want} == {i: 0 if c in low else c for i, c in joined.items()}


def test_a_full_node_ends_soon():
    """16,000 mutually near fingerprints of 128 bits: two blocks of a node are compared in seconds."""
    import time

    import pyarrow as pa

    rng = np.random.default_rng(3)
    f = np.zeros((4096, 2), np.uint64)
    for k in range(len(f)):
        for b in rng.integers(0, 128, 8):
            f[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    key = np.arange(len(f))
    table = pa.table({"cell": np.zeros(len(f), np.int64), "side": (key >= 2048).astype(np.int32), "k": key, "f0": f[:, 0].view(np.int64), "f1": f[:, 1].view(np.int64)})
    began = time.time()
    out = list(simhash.CellCompare(2, 24, None)(table.to_batches()))
    assert sum(map(len, out)) == len(f) - 1 and time.time() - began < 10
    node = pa.table({"id": key, "label": key, "f0": f[:, 0].view(np.int64), "f1": f[:, 1].view(np.int64), "node": np.zeros(len(f), np.int64)})
    out = list(simhash.NodeWalk(2, 24)(node.to_batches()))
    assert sum(map(len, out)) == len(f) - 1 and time.time() - began < 20
    out = list(simhash.NodeWalk(2, 24, rows=1000, node_rows=500)(node.to_batches(max_chunksize=300)))
    assert [(x.column(0).to_pylist(), x.column(1).to_pylist()) for x in out] == [([0], [None])]


def near_pair(rnd, words, shared):
    """Two texts of which so many words are one run and the rest differ: the Jaccard similarity of the five-word shingles is known."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    a = [word() for _ in range(words)]
    return " ".join(a), " ".join([*a[:shared], *(word() for _ in range(words - shared))])


def test_planted_pairs(spark):
    """Of pairs at a similarity of just over 0.8 nearly all lose one text, of those below none."""
    import random

    rnd = random.Random(4)
    words = 404
    plan = {0.8: 360, 0.78: 354, 0.7: 334, 0.6: 304}  # run of s words: s - 4 shingles of 400 shared
    rows, kind = [], {}
    for j, s in plan.items():
        assert (j >= 0.8) == ((s - 4) * 5 >= (800 - s + 4) * 4)
        for _ in range(200):
            for text in near_pair(rnd, words, s):
                kind[len(rows)] = j
                rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = [r["doc_id"] for r in simhash.near_copies(docs, 5, 0.8, NEAR_BITS).collect()]
    assert all(i % 2 == 1 for i in gone)
    lost = {j: sum(kind[i] == j for i in gone) for j in plan}
    assert lost[0.8] >= 194 and lost[0.78] == lost[0.7] == lost[0.6] == 0, lost


@pytest.mark.parametrize("rows", [10_000, 40_000, 160_000])
def test_strangers_are_no_candidates_however_many(spark, rows):
    """Random fingerprints, sizes not telling them apart, beside planted near ones: only these are linked."""
    from pyspark.sql import functions as F

    names = [f"f{w}" for w in range(4)]
    df = spark.range(rows).select("id", *(F.xxhash64("id", F.lit(w)).alias(n) for w, n in enumerate(names)), F.lit(100).alias("n"))
    near = df.where("id < 50").select((F.col("id") + rows).alias("id"), *(F.col(n).bitwiseXOR(F.lit(0x0101010101010101)).alias(n) for n in names), "n")  # 32 bits
    masks = simhash.mask_plan(rows, 4, 256 * 0.1515)
    links = simhash.near_links(df.unionAll(near), masks, NEAR_BITS, 4, 0.8).distinct().collect()
    assert all(abs(r["a"] - r["b"]) == rows for r in links) and len(links) >= 48


def test_strangers_by_calculation():
    """Expected links of a row to unrelated ones of 10^11, and the share of pairs at a similarity of just 0.8 that the limits leave out."""
    from math import acos, comb, pi

    def within(limits, p):  # the chance that bits differing each with p stay within the limits up to the end of each word
        at = [1.0]
        for most in limits:
            word = [comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(65)]
            at = list(np.convolve(at, word)[: most + 1])
        return sum(at)

    assert within(NEAR_BITS, 0.5) * 1e11 < 1e-5
    assert within(NEAR_BITS, acos(1.6 / 1.8) / pi) > 1 - 3e-4


def test_limits_by_word_are_those_of_all_pairs():
    """Pairs within a number of bits up to the end of each word, by the index and by a matrix."""
    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 63, (40, 3), dtype=np.uint64)
    f = np.concatenate([f, f, f])
    for k in range(40, 120):
        for b in rng.integers(0, 192, 20):
            f[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    limits = (8, 14, 20)
    far = lambda a, b: np.cumsum([int(x ^ y).bit_count() for x, y in zip(f[a], f[b])])
    want = {(a, b) for b in range(120) for a in range(b) if (far(a, b) <= limits).all()}
    got = {(int(a), int(b)) for x, y in simhash.near_pairs(np.zeros(120, int), f, limits) for a, b in zip(x, y)}
    matrix = np.argwhere(np.triu(simhash.near_matrix(f, f, limits), 1))
    assert got == want == {(int(a), int(b)) for a, b in matrix} and len(want) > 20


def test_a_large_group_of_near_copies(spark):
    """Texts like a common one, not all like each other, beside a chain of edits and strangers, against all pairs."""
    import random

    rnd = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    texts = [" ".join(base)]
    for k in range(150):
        edited = list(base)
        for at in rnd.sample(range(120), 1):
            edited[at] = f"x{k}"
        cut = rnd.randrange(12)
        texts.append(" ".join(edited[cut:] if k % 2 else edited[: 120 - cut]))
    step = [f"c{k}" for k in range(100)]
    for k in range(40):
        step = [*step[4:], *(f"d{k}_{i}" for i in range(4))]
        texts.append(" ".join(step))
    rows = list(enumerate(texts))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n * 5 >= (len(sets[a]) + len(sets[b]) - n) * 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    distinct = spark.createDataFrame([(k, (False, k, None), len(s)) for k, s in enumerate(sets)], "s long, first struct<none:boolean,doc_id:long,h:long>, n int")
    distinct = distinct.join(docs.selectExpr("doc_id as _d", "xxhash64(text) as _h"), distinct["s"] == F.col("_d")).select("s", F.struct(F.lit(False).alias("none"), F.col("s").alias("doc_id"), F.col("_h").alias("h")).alias("first"), "n")
    group = docs.selectExpr("doc_id as node", "0L as component_id")
    from cadenza.llm.common import components

    for shingles in (200_000, 4000):
        links = simhash.alike_links(docs, distinct, group, 5, 42, 0.8, shingles=shingles)
        got = {r["node"]: r["component_id"] for r in components(links).collect()}
        assert {k: got.get(k, k) for k in range(len(rows))} == {k: find(k) for k in range(len(rows))}


def test_a_row_moves_few_times():
    """Base masks, by which rows move, are few; base and finer masks together miss a pair at the limit no oftener than told."""
    same = 1 - 0.1515
    for rows, most in ((50_000, 24), (260_000, 24), (14_000_000, 45)):
        masks = simhash.mask_plan(rows, 4, 256 * 0.1515)
        assert len(masks) <= most
        bits = lambda m: sum(x.bit_count() for x in m)
        base, fine = bits(masks[0].base), bits(masks[0].finer[0])
        assert rows / 2**base <= 32_768 and rows / 2**fine <= max(16, rows / 2**14)
        assert all(all(b & ~x == 0 for b, x in zip(m.base, k)) and bits(k) == fine for m in masks for k in m.finer)
        missed = (1 - same**base * (1 - (1 - same ** (fine - base)) ** len(masks[0].finer))) ** len(masks)
        assert missed <= 2e-4


def test_nodes_in_groups_are_those_of_all_pairs(spark):
    """A crowd, a chain, pairs and strangers: by tasks in their groups, by crowds compared with anchors, and dealt out by the finer masks."""
    from cadenza.llm.common import components

    rng = np.random.default_rng(2)
    flip = lambda x, k: [w ^ sum(1 << int(b) % 64 for b in bits if b // 64 == i) for bits in [rng.permutation(128)[:k]] for i, w in enumerate(x)]
    new = lambda: [int(x) for x in rng.integers(0, 1 << 63, 2)]
    rows = [new() for _ in range(150)]
    base = new()
    rows += [flip(base, int(rng.integers(1, 11))) for _ in range(200)]
    for _ in range(60):
        base = flip(base, 12)
        rows.append(base)
    rows += [flip(rows[k], 14) for k in range(50)]
    rows = [(k, *(x - (1 << 64) if x >> 63 else x for x in r)) for k, r in enumerate(rows)]
    limits = (14, 18)
    masks = [simhash.NestedMask((7, 1 << 40), ((7 | 1 << k, 1 << 40 | 1 << k), (7, 1 << 40 | 3 << k))) for k in (20, 30, 50)]
    f = np.array([r[1:] for r in rows]).astype(np.uint64)
    near = simhash.near_matrix(f, f, limits)
    shown = np.zeros_like(near)
    for m in masks:
        for x in m.finer:
            p = f & np.array(x, np.uint64)
            shown |= (p[:, None] == p[None, :]).all(2)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in np.argwhere(np.tril(near & shown, -1)):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame(rows, "id long, f0 long, f1 long")
    for node_rows, group_rows in ((4096, 262_144), (4096, 40), (10, 262_144), (10, 40)):
        links = simhash.near_links(df, masks, limits, 2, node_rows=node_rows, group_rows=group_rows)
        got = {r["node"]: r["component_id"] for r in components(links).collect()}
        assert {k: got.get(k, k) for k in range(len(rows))} == {k: find(k) for k in range(len(rows))}
