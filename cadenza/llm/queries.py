"""The thin queries opN_<name>: each applies its operator to a whole table."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, embeddings, langid, licenses, lm, packing, pii, secrets, sharding, simhash, spelling, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_shard_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file(), 4096, 2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, most_differing=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = licenses.scan(docs, licenses.train(docs))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return out.select("doc_id", F.size("licenses").alias("n_licenses"), F.size(sure).alias("n_confirmed"), F.array_join(F.array_distinct(F.transform(sure, lambda x: x["family"])), ",").alias("families"), "licenses")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lm.train(docs.where(_fold(10) != 0))
    held = docs.select("doc_id", F.coalesce(_fold(10) == 0, F.lit(False)).alias("held_out"), "text")
    out = lm.score_documents(held, model)
    return out.select("doc_id", F.coalesce(_fold(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


_drawn_keys: dict[str, str] = {}


def pii_key(spark: SparkSession) -> str:
    """The key of the pseudonyms: spark.cadenza.pii.key of the session, which must be kept secret; without it one drawn for the application."""
    return spark.conf.get("spark.cadenza.pii.key", None) or _drawn_keys.setdefault(spark.sparkContext.applicationId, token_hex(32))


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), count_col="n_replaced")


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.learn(docs.where(_fold(5) != 0))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, language_model(docs))
    return out.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # Two deliveries: some rows first, then the whole table, of which only blobs that the ledger lacks are scanned.
    _, ledger = secrets.scan_unseen(docs.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0))
    paths, entries = secrets.scan_unseen(docs, ledger)
    found = secrets.findings(paths, ledger.unionByName(entries))
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in secrets.RULES if r.base)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), least_length=7, least_count=2, least_ratio=10, modulus=31)


def op12_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.archive_pages(_table(spark, sf_dir, "pages"), least_bytes=0), payloads=False)
    refers = warc.page_of(F.col("refers_to"))
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings"), 32)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_shard_minimax, op2_pack_best_fit, op3_simhash_near_dedup, op4_license_scan, op5_kneser_ney, op6_pii_feistel, op7_language_id, op8_secret_ledger, op9_embedding_near_dedup, op10_decontaminate, op11_spelling_variants, op12_warc_normaliser, op13_embedding_whitening, pipeline)}
#: Vector links and secrets can be told in SQL; the others hold a tokenizer, a trained model, XXH64 or a search for a capacity.
ORACLE_SQL: dict[str, str] = {
    # Where matches lie follows from the lengths of what is between them; a match of web begins after the one character before it.
    "op8_secret_ledger": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT r, 0 AS k, 'assign' AS kind, 12 AS least, regexp_split_to_array(t, p) AS gaps, regexp_extract_all(t, p) AS hits, regexp_extract_all(t, p, 2) AS judged, NULL AS lead
  FROM d, (SELECT '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p)
  UNION ALL SELECT r, 1, 'access', 18, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS h, h, NULL FROM d
  UNION ALL SELECT r, 2, 'hex', 16, regexp_split_to_array(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') AS h, h, NULL FROM d
  UNION ALL SELECT r, 3, 'pem', 0, regexp_split_to_array(t, p), regexp_extract_all(t, p) AS h, h, NULL FROM d, (SELECT '-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----' AS p)
  UNION ALL SELECT r, 4, 'hub', 0, regexp_split_to_array(t, p), regexp_extract_all(t, p) AS h, h, NULL FROM d, (SELECT '\bgh[oprsu]_[A-Za-z0-9]{36,}' AS p)
  UNION ALL SELECT r, 5, 'web', 0, regexp_split_to_array(t, p), regexp_extract_all(t, p) AS h, h, regexp_extract_all(t, p, 1)
  FROM d, (SELECT '(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}' AS p)),
m AS (SELECT r, k, kind, least, i, length(gaps[i]) AS g, length(hits[i]) AS n, length(judged[i]) AS j, coalesce(length(lead[i]), 0) AS l FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM s)),
f AS (SELECT r, k, kind, least, j, sum(g + n) OVER w AS b, sum(g + n) OVER w - n + l AS a FROM m WINDOW w AS (PARTITION BY r, k ORDER BY i)),
o AS (SELECT r, k, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS x FROM f WHERE j >= least),
e AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(x, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY a, k) AS spans FROM o GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN e USING (r)""",
    # Base32 by five hexadecimal digits at a time: four characters.
    "op12_warc_normaliser": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS k, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT k, max(page_id) AS top FROM p GROUP BY k),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1), '' ORDER BY i, s DESC) AS b
  FROM (SELECT h, i, CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) AS v FROM (SELECT DISTINCT h FROM p), range(8) r(i)), (VALUES (0), (5), (10), (15)) x(s) GROUP BY h)
SELECT page_id, n AS payload_bytes, b AS payload_digest, CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p JOIN t USING (k) JOIN d USING (h)""",
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x), n AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT vec_id, coalesce(k, 0) AS n_links, m AS component_id, vec_id = m AS kept FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id""",
}
