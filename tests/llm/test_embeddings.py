import math
import random

import numpy as np

from cadenza.llm.embeddings import Plan, collisions, near_duplicates


def brute(rows, least=0.98):
    usable = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a in range(len(usable)):
        for b in range(a):
            (i, u, k), (j, v, l) = usable[a], usable[b]
            if k == l and len(u) == len(v) and u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= least:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in sorted(x for x in links if x is not None):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return {i: (len(links[i]), comp.get(i), comp.get(i) == i) for i in links if i is not None}


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], [float(np.float32(x)) for x in r["embedding"]], r["label"]) for r in df.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_groups_of_copies_and_odd_vectors(spark):
    rnd = random.Random(1)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(k, [x + rnd.gauss(0, 0.07) for x in base[k % 6]], k % 2) for k in range(300)]
    rows += [(k, base[0], 0) for k in range(300, 340)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [math.nan] * 16, 1), (403, [math.inf] * 16, 1), (404, [None] * 16, 1), (405, base[0], None), (406, [1.0, 2.0], 0), (407, [], 0), (None, base[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as kept", "2 as h")
    got = near_duplicates(df, block_rows=40).collect()
    assert len(got) == len(rows)
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
    want = brute(rows)
    have = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None}
    assert have == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_limit():
    """Pairs at a cosine of just 0.98 share a cell and pass the collision count nearly always."""
    rng = np.random.default_rng(2)
    plan = Plan(64, 0.98, 20_000)
    hit = 0
    u = rng.standard_normal((1000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((1000, 64))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.98 * u + math.sqrt(1 - 0.98**2) * w
    cells = (plan.cells(u) == plan.cells(v)).any(1)
    close = (np.abs(u @ plan.directions - v @ plan.directions) <= plan.window).sum(1) >= plan.threshold
    hit = (cells & close).mean()
    assert hit >= 0.99 and plan.cell_directions > 0


def test_windows_count_like_a_plain_comparison():
    rng = np.random.default_rng(3)
    p, q = rng.standard_normal((50, 8)), rng.standard_normal((70, 8))
    want = {(a, b) for a in range(50) for b in range(70) if (np.abs(p[a] - q[b]) <= 1.0).sum() >= 6}
    x, y = collisions(p, q, 1.0, 6)
    assert set(zip(x.tolist(), y.tolist())) == want


def test_sql_gives_the_same_rows(spark):
    from cadenza.llm.queries import ORACLE_SQL, QUERIES
    from tests.compare import compare

    name = "op9_embedding_near_dedup"
    compare(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name])


def test_many_vectors_of_two_lengths(spark):
    """10,000 vectors with groups of near copies, chains and strangers, in cells and blocks, against all pairs."""
    rng = np.random.default_rng(4)
    v = []
    for d, n in ((32, 8000), (16, 2000)):
        base = rng.standard_normal((n // 40, d))
        near = base[rng.integers(0, len(base), n // 2)] + rng.normal(0, 0.08, (n // 2, d))
        crowd = base[0] + rng.normal(0, 0.09, (n // 4, d))
        v.append(np.concatenate([near, crowd, rng.standard_normal((n - n // 2 - n // 4, d))]).astype(np.float32))
    rows, want, at = [], {}, 0
    for x in v:
        label = rng.integers(0, 2, len(x))
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        links = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
        np.fill_diagonal(links, False)
        from cadenza.llm.common import roots

        a, b = np.nonzero(links)
        comp = roots(a, b, len(x)) + at
        for k in range(len(x)):
            rows.append((at + k, x[k].tolist(), int(label[k])))
            want[at + k] = (int(links[k].sum()), int(comp[k]))
        at += len(x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(df).collect()}
    total, found = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert len(got) == len(want) and all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.998 * total > 100_000, (found, total)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.995 * len(want)


def test_magnitudes_at_the_ends_of_doubles(spark):
    tiny = 5e-324
    v = [[1e200, 1e200], [1e200, 1e200], [1e-200, 0.0], [1e-200, 0.0], [1e300, 1e300], [tiny, 0.0], [tiny, tiny], [0.0, -0.0], [1e308, -1e308]]
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (2, 2), 3: (2, 2), 4: (3, 0), 5: (2, 2), 6: (3, 0), 7: (0, 7), 8: (0, 8)}
