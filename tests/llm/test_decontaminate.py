import random

from cadenza.llm import decontaminate as D


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        before, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != t)))
    return min(row)


def edited(rnd, text, edits):
    for _ in range(edits):
        k = rnd.randrange(len(text))
        text = rnd.choice([text[:k] + text[k + 1 :], text[:k] + "q" + text[k:], text[:k] + "z" + text[k + 1 :]])
    return text


def test_myers_distance():
    rnd = random.Random(1)
    for _ in range(300):
        p = "".join(rnd.choice("abc ") for _ in range(rnd.randint(8, 90)))
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 60))) + edited(rnd, p, rnd.randint(0, 4)) + "cab"
        assert D.best_distance(p, t, 10**6) == brute_distance(p, t)


def test_no_match_within_the_budget_is_missed():
    rnd = random.Random(2)
    items = [D.Item(k, "".join(rnd.choice("abcdefgh ") for _ in range(n)), b) for k, (n, b) in enumerate(((40, 2), (100, 6), (16, 0), (60, 3)))]
    matcher = D.Matcher(items)
    for _ in range(200):
        item = rnd.choice(items)
        text = "".join(rnd.choice("abcdefgh ") for _ in range(200))
        k = rnd.randrange(200)
        text = text[:k] + edited(rnd, item.text, rnd.randint(0, item.budget + 3)) + text[k:]
        want = [(i.item_id, d) for i in items if (d := brute_distance(i.text, text)) <= i.budget and (i.budget or f" {i.text} " in f" {text} ")]
        assert matcher.matches(text) == want


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r["doc_id"]: D.normalised(r["text"]) for r in docs.collect()}
    items = {r["item_id"]: D.normalised(r["text"]) for r in bench.collect()}
    whole = {i for i, t in texts.items() if any(x in t for x in items.values())}
    got = D.find_leaks(docs, bench).collect()
    assert len(got) == len(texts)
    found = {r["doc_id"] for r in got if r["contaminated"]}
    assert whole and whole <= found and len(found) <= len(whole) + 10
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(texts) - found


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "A long enough passage of a test, to be found!"), (3, "x" * 10**6)], "doc_id long, text string").selectExpr("*", "1 as items")
    bench = spark.createDataFrame([(1, "a LONG enough passage of a test to be found"), (1, None), (2, " !"), (None, "nothing")], "item_id long, text string")
    assert [(r["doc_id"], r["n_items"]) for r in D.find_leaks(docs, bench).collect()] == [(1, 0), (2, 0), (None, 1), (3, 0)]
    assert D.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0
    assert D.find_leaks(docs.limit(0), bench).count() == 0
    more = spark.createDataFrame([(k, f"item number {k} of a benchmark, with some words") for k in range(30)], "item_id long, text string")
    parts = D.benchmark_items(more, block_chars=300)
    assert len(parts) > 1 and sorted(i.item_id for p in parts for i in D.read_items(p)) == list(range(30))
    leaks = D.find_leaks(spark.createDataFrame([(k, f"so: Item number {k} of a benchmark - with some words.") for k in range(30)], "doc_id long, text string"), more.limit(30))
    assert leaks.where("array_contains(transform(items, x -> x.item_id), doc_id)").count() == 30


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "The museum opened yesterday."), (2, "Yes!"), (3, "yes yes"), (4, "a"), (5, "It was a cold night in the town."), (6, "it was a cold night in the townhall, they say")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "A"), (3, "a cold night in the town")], "item_id long, text string")
    got = {r["doc_id"]: [(x["item_id"], x["distance"]) for x in r["items"]] for r in D.find_leaks(docs, bench).collect()}
    assert got == {1: [], 2: [(1, 0)], 3: [], 4: [(2, 0)], 5: [(3, 0)], 6: []}


def test_many_blocks_give_what_one_gives(spark, monkeypatch):
    """Blocks in turn, with texts held back and without, find what one automaton of all items finds; texts of many batches, too."""
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.repartition(3)
    rows = lambda df: sorted(map(str, df.collect()))
    one, kept = rows(D.find_leaks(docs, bench)), rows(D.drop_leaks(docs, bench))
    whole = D.benchmark_items
    parts = whole(bench, block_chars=500)
    assert len(parts) > 4
    monkeypatch.setattr(D, "benchmark_items", lambda *a, **k: parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(D.find_leaks(docs, bench)) == one and rows(D.drop_leaks(docs, bench)) == kept
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import pyarrow as pa

    table = docs.select("doc_id", "text").toPandas()
    batches = pa.Table.from_pandas(table, preserve_index=False).to_batches(max_chunksize=9)
    for held in (0, 5_000, 10**9):
        got = [(i, hits) for batch, found in D.BlockSearch(parts, held).search(iter(batches), 1) for i, hits in zip(batch.column(0).to_pylist(), found, strict=True)]
        matcher = D.Matcher([i for p in parts for i in D.read_items(p)])
        assert got == [(i, matcher.matches(D.normalised(t))) for i, t in zip(table.doc_id.tolist(), table.text, strict=True)]
    assert any(hits for _, hits in got)
