import hashlib
import re

from cadenza.llm import secrets
from cadenza.llm.queries import ORACLE_SQL, op8_secret_ledger
from tests.compare import compare

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ("assign", "access", "hex")
    return [sum(k == j for _, k, _ in out) for j in range(3)], ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_secret_ledger(spark, sf).collect()
    assert len(got) == len(texts)
    hits = 0
    for r in got:
        n, spans = brute(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == n
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        hits += sum(n)
    assert hits > 10


def test_sql(spark):
    compare(spark, "/root/testdata/sf0.01", op8_secret_ledger, ORACLE_SQL["op8_secret_ledger"])


def test_sql_over_odd_texts(spark, tmp_path):
    web = "eyJ" + "w" * 12 + "." + "x" * 12 + "." + "y" * 12
    texts = [None, "", web, f"é{web}.{web} {web}", "xeyJ" + "w" * 12, "-----BEGIN RSA PRIVATE KEY-----" * 2, "ghp_" + "a1" * 20 + " xghp_" + "a" * 40, "\n".join(["TOKEN : 'abcdefghijklmnop'", "AKIA" + "Q" * 20, "ﬀ" * 5 + "0123456789abcdef" * 2]), "pa\u017fsword=abcdefghijklmnop api_\u212aey=abcdefghijklmnop", "secret=short secret=longenough123 token=x"]
    rows = [(None if k == 2 else k // 2, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/parts")
    next(tmp_path.glob("parts/*.parquet")).rename(tmp_path / "documents.parquet")
    compare(spark, str(tmp_path), op8_secret_ledger, ORACLE_SQL["op8_secret_ledger"])


def test_only_unseen_blobs_are_scanned(spark):
    schema = "doc_id long, text string"
    key = "AKIA" + "Z" * 16
    first = spark.createDataFrame([(1, key), (2, key), (None, "ﬀ secret: abcdefghijklmnop"), (3, None), (3, None), (4, ""), (5, "token: short token=\"" + "0a" * 10)], schema).selectExpr("*", "1 as path", "2 as blob")
    paths, ledger = secrets.scan_unseen(first)
    assert paths.count() == 7 and ledger.count() == 4
    found = {r["path"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.findings(paths, ledger).collect()}
    assert found == {1: [("access", 0, 20)], 2: [("access", 0, 20)], None: [("assign", 2, 26)], 3: [], 4: [], 5: [("assign", 13, 40), ("hex", 20, 40)]}
    more = spark.createDataFrame([(1, key), (9, "new " + key)], schema)
    paths, entries = secrets.scan_unseen(more, ledger)
    assert entries.count() == 1
    assert secrets.findings(paths, ledger.unionByName(entries)).where("size(spans) = 1").count() == 2
    assert secrets.scan_unseen(more, ledger, rules_version="next")[1].count() == 2
    assert secrets.scan_unseen(first.limit(0))[1].count() == 0


def test_long_runs_take_linear_time(spark):
    import time

    compiled = secrets.compiled_rules(secrets.RULES)
    for unit in ("eyJaaaaaaaaaa-", "eyJaaaaaaaaaa.", "password", "token  ", "AKIA", "ghp_", "-----BEGIN "):
        text = unit * (1_000_000 // len(unit))
        began = time.time()
        secrets.spans_of(text, compiled)
        assert time.time() - began < 5, unit
    token = "eyJ" + "w" * 20 + "." + "x" * 20 + "." + "y" * 20
    assert secrets.spans_of(f"x {token} y", compiled) == [("web", 2, 2 + len(token))]
    df = spark.createDataFrame([(1, "secret = abcdefghijklmnop " * 40_000)], "doc_id long, text string")
    paths, entries = secrets.scan_unseen(df)
    assert secrets.findings(paths, entries).selectExpr("size(spans)").first()[0] == 40_000


def test_keys_are_found_in_any_file(spark):
    from pyspark.sql import functions as F

    from cadenza.llm.common import KeySet

    df = spark.range(3000).select("id", F.substring(F.unhex(F.sha2(F.col("id").cast("string"), 256)), 1, 16).alias("key"))
    keys = KeySet.of(df.where("id % 3 = 0").select("key"), "t", 1000, file_rows=100)
    rows = df.select("id", "key", keys.file_of(F.col("key")).alias("file")).toArrow()
    got = keys.has(rows.column("key"), rows.column("file").to_numpy(), most_open=2)
    assert keys.files == 10 and got.tolist() == [i % 3 == 0 for i in rows.column("id").to_pylist()]
    none = KeySet.of(df.limit(0).select("key"), "t", 0)
    assert not none.has(rows.column("key"), rows.column("file").to_numpy() * 0).any()


def test_long_repeats(spark):
    n = 100_000
    texts = [r * (n // len(r)) for r in ("ab.", "1.", "@", "1", "-", "AKIA", "token=", "eyJ", "-----BEGIN ", "gho_")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    paths, entries = secrets.scan_unseen(docs)
    got = {r["path"]: [s["kind"] for s in r["spans"]] for r in secrets.findings(paths, entries).collect()}
    assert len(got) == len(texts) and got[3] == ["hex"] and got[5] == ["access"] and not got[2]
