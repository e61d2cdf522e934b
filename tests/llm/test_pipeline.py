import pytest

import corpus_pipeline
from tests.llm.test_packing import ids_of


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long_text = " ".join(f"word{k} of the story" for k in range(200))
    extra = spark.createDataFrame([(9001, "12345 !!", "en", "s", 8), (9002, long_text, "en", "s", 1), (9003, long_text.replace("word70 ", "changed "), "en", "s", 1), (9004, long_text, "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = (ids(x) for x in seen["language_id"])
    assert 9001 in before - after and len(after) > 0.95 * len(before)
    before, after = (ids(x) for x in seen["simhash_near_dedup"])
    assert before - after >= {9003, 9004} and 9002 in after
    before, after = (ids(x) for x in seen["decontamination"])
    assert after <= before and len(after) > 0.8 * len(before)
    before, after = seen["pii"]
    assert ids(before) == ids(after)
    packed = docs.collect()
    from tokenizers import Tokenizer

    from cadenza.llm.queries import tokenizer_file

    tokenizer = Tokenizer.from_file(tokenizer_file())
    assert sum(r["length"] for r in packed) == sum(len(ids_of(tokenizer, r["text"])) for r in after.collect())


def test_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    text = "the cat and the dog and the bird and one more word here"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", None, None), (3, None, "en", "a", 1), (4, "", "en", "a", 1), (None, "another text altogether, of some words", None, "a", 1), (5, "long words " * 20000, "en", "a", 1), (6, "12 34", "en", "a", 1)]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as component_id", "2 as lang_pred", "3 as n", "4 as ids", "5 as _again", "6 as _gone", "7 as _h", "8 as __found")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out
        kept.append(sorted((r["doc_id"] or 0) for r in docs.select("doc_id").collect()))
    assert kept == [[0, 1, 1, 2, 5], [0, 1, 5], [0, 1, 5], [0, 1, 5]]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_copies_are_those_of_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    words = [f"w{k}" for k in range(104)]
    changed = lambda k: " ".join([*words[:-k], *("x" for _ in range(k))])
    extra = spark.createDataFrame([(90001, " ".join(words), "en", "s", 1), (90002, changed(11), "en", "s", 1), (90003, changed(12), "en", "s", 1), (None, " ".join(words), "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for _, text in rows:
        part = (text or "").encode().lower().split()
        sets.append(frozenset(b" ".join(part[k : k + 5]) for k in range(max(1, len(part) - 4))) if part else frozenset())
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n * 5 >= (len(s) + len(sets[j]) - n) * 4:
                parent[find(k)] = find(j)
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(find(k), []).append(row)
    want = {min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()}
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_dedup_moves_no_text_but_candidates(spark, monkeypatch):
    """However large the tables, the stage's result is a filter of its input, and only texts of candidates are joined."""
    from cadenza.llm import simhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    asked = []
    real = simhash.KeySet.having
    monkeypatch.setattr(simhash.KeySet, "having", lambda self, key: asked.append(self) or real(self, key))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_dedup_stage(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert 0 < out.count() < docs.count() and len(asked) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_key_set_tells_ids_and_texts(spark):
    from cadenza.llm import simhash
    from cadenza.llm.common import KeySet

    rows = [(1, "a"), (1, "b"), (-1, "a"), (None, "a"), (None, None), (0, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) as h")
    key = simhash.row_key(df["doc_id"], df["h"])
    for some in (rows[:1], rows[3:4], rows[4:6], rows, []):
        chosen = spark.createDataFrame(some, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as h")
        keys = KeySet.of(chosen.select(simhash.row_key(chosen["doc_id"], chosen["h"]).alias("key")), "test-keys", len(some), file_rows=2)
        assert {(r["doc_id"], r["text"]) for r in df.where(keys.having(key)).collect()} == set(some)


def test_near_dedup_has_one_python_process_a_task(spark, monkeypatch):
    """What goes to a Python task comes through no other one in the same task, also where joins are broadcast."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plans = []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or real(self, *a, **b))
    assert corpus_pipeline.near_dedup_stage(spark, docs, "").count() > 0
    assert len(plans) >= 3
    for plan in plans:
        above = plan.split("Repartition")[0]
        assert "EvalPython" not in above and "MapInArrow" not in above


@pytest.mark.parametrize("stage", ["language_id", "simhash_near_dedup", "decontamination", "packing"])
def test_batches_for_python_are_small(spark, stage):
    import pyarrow as pa

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([x.nbytes for x in batches], pa.int64())], ["n"])

    sf, key = "/root/testdata/sf0.001", "spark.sql.execution.arrow.maxBytesPerBatch"
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    old = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        run(spark, docs, sf)
        got = [r["n"] for r in spark.range(0, 20_000, 1, 1).selectExpr("id", "repeat('some words ', 100) as text").mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 20_000_000 and max(got) < 6_000_000
        spark.conf.set(key, "1m")  # the session's own limit stays
        run(spark, docs, sf)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
