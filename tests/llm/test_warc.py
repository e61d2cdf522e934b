import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cadenza.llm import warc
from cadenza.llm.queries import ORACLE_SQL, op12_warc_normaliser
from tests.compare import compare


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    compare(spark, f"/root/testdata/{sf}", op12_warc_normaliser, ORACLE_SQL["op12_warc_normaliser"])


def rows_of(spark, rows, least=0, file_bytes=256 << 20):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as id", "3 as record_type", "4 as _key")
    index = warc.archive_pages(pages, least_bytes=least, file_bytes=file_bytes)
    out = warc.read_records(index).select(warc.page_of(F.col("record_id")).alias("page"), "record_type", warc.page_of(F.col("refers_to")).alias("refers"), "payload", "payload_bytes", "payload_digest", "target_uri", "damage").collect()
    return index, sorted(out, key=str)


def test_odd_rows_round_trip(spark):
    long = "".join(random.Random(1).choices("abc <>\r\n\0é", k=600_000))
    rows = [(1, "http://a/", "x"), (2, None, "x"), (2, "http://b/", "y"), (3, "http://c/\r\nWARC-Type: info", None), (4, "", ""), (5, "u", long), (6, "v", long), (None, "w", "x"), (None, "w", "only"), (None, "w", "only"), (7, "dup", "z"), (7, "dup", "z"), (8, "k", "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "ü", "日本")]
    index, got = rows_of(spark, rows, file_bytes=1 << 16)
    assert len(got) == len(rows) and not any(r["damage"] for r in got)
    texts = {}
    for i, _, html in rows:
        texts.setdefault((html or "").encode(), []).append(i)
    want = []
    for data, ids in texts.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            own = i == top
            want.append((i, "response" if own else "revisit", None if own else top, data if own else None, len(data), digest(data)))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert {r["target_uri"] for r in got} >= {"http://c/ WARC-Type: info", "ü", "http://a/"}
    # The sidecar says the same as the index.
    for path in {r["path"] for r in index.collect()}:
        fs, inner = warc.filesystem(path)
        lines = fs.open_input_stream(inner + ".idx").read().decode().splitlines()[1:]
        assert [tuple(map(int, x.split(" ")[:2])) for x in lines] == sorted((r["offset"], r["length"]) for r in index.where(F.col("path") == path).collect())


def test_small_payloads_stay_responses(spark):
    _, got = rows_of(spark, [(1, "a", "ab"), (2, "a", "ab"), (3, "a", "abc"), (4, "a", "abc")], least=3)
    assert sorted((r["page"], r["record_type"], r["refers"]) for r in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_empty_table(spark):
    index, got = rows_of(spark, [])
    assert got == [] and index.count() == 0


def test_normalise_own_members_and_damage(spark, tmp_path):
    """Archives of several members, or with a damaged end: whole records are kept and each is a member of its own."""
    records = [warc.record_bytes("response", f"urn:page:{k}", "http://x/", "2024-01-01T00:00:00Z", b"p" * k * 1000, digest(b"p" * k * 1000), None) for k in range(1, 6)]
    whole = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))
    bad = {"whole": whole, "cut": zlib.compress(b"".join(records), wbits=31)[:-40], "text": gzip.compress(records[0] + b"not a record\r\n\r\n"), "raw": b"no gzip at all", "none": b"", "longer": gzip.compress(records[0].replace(b"\r\n\r\nHTTP", b"\r\n\r\nHTT") + records[1])}
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([(str(tmp_path / n), n) for n in bad], "path string, name string")
    index = warc.normalise(manifest).collect()
    fine = [r for r in index if r["damage"] is None]
    assert {r["path"].rpartition("/")[2] for r in index if r["damage"]} == {"cut", "text", "raw", "longer"}
    assert len(fine) >= 5 + 1
    for r in fine:
        raw = open(r["path"], "rb").read()[r["offset"] : r["offset"] + r["length"]]
        unpacker = zlib.decompressobj(31)
        assert unpacker.decompress(raw) in records and unpacker.eof and not unpacker.unused_data
    out = warc.read_records(warc.normalise(manifest)).collect()
    assert sum(r["damage"] is not None for r in out) == 4 and sum(r["payload_bytes"] is not None for r in out) == len(fine)


def test_a_wrong_digest_is_seen(spark, tmp_path):
    (tmp_path / "a").write_bytes(gzip.compress(warc.record_bytes("response", "urn:page:1", "u", "d", b"one", digest(b"two"), None)))
    out = warc.read_records(warc.normalise(spark.createDataFrame([(str(tmp_path / "a"),)], "path string"))).collect()
    assert [r["damage"] for r in out] == ["the payload isn't that of its digest"]
