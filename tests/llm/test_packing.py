import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cadenza.llm.packing import Tokens, Windows, pack_documents

FILE = public_tokenizers.path("word_bpe_49k.json")


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, got, size):
    tokenizer = Tokenizer.from_file(FILE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = ids_of(tokenizer, text)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert bytes(r["ids"]) == part and zlib.crc32(part) == zlib.crc32(bytes(r["ids"]))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pack_documents(docs, FILE, 512, most_open=4, most_waste=16).collect()
    padding = check([(r["doc_id"], r["text"]) for r in docs.collect()], got, 512)
    assert padding < 0.04 * sum(r["length"] for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a\x1cb  é <|endoftext|> x<|endoftext|>y 'S don't"), (4, "word " * 3000), (5, "   z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as length", "8 as ids")
    check(rows, pack_documents(df, FILE, 64, most_open=2, most_waste=2).collect(), 64)
    assert pack_documents(df.limit(0), FILE).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert sum(r["length"] for r in pack_documents(twice, FILE).collect()) == 6


def test_words_apart_give_the_ids_of_the_whole():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aB é́ß漢字12'sİ.,!\n\t \u0085-") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    tokenizer = Tokenizer.from_file(FILE)
    for few in (0, 10**6):
        for text, raw in zip(texts, Tokens(FILE, few).batch(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == ids_of(tokenizer, text)[:-1]


def test_windows_bound_their_padding():
    rnd = random.Random(4)
    out = []
    w = Windows(100, 3, 5, out.append)
    for k in range(500):
        w.add((k, 0, np.arange(rnd.randint(1, 180))))
        assert len(w.open) <= 3
    w.merge()
    for window in out:
        n = sum(len(p[2]) for p in window)
        assert n >= 95 or n & (n - 1) == 0


def test_ids_do_not_depend_on_the_words_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(1).sortWithinPartitions("doc_id")
    rows = [sorted(map(tuple, pack_documents(docs, FILE, **more).collect())) for more in ({}, {"most_words": 10})]
    assert rows[0] == rows[1] and len(rows[0]) > 0
