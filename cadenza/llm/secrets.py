"""Secret scans over an incremental ledger of content-addressed text versions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import KeySet, stored

SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, of which group has least characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


#: In the order that breaks ties. [0-9a-f] runs of 16 are the same as runs of which shorter ones are dropped.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", base=False),
    Rule("hub", r"\bgh[oprsu]_[A-Za-z0-9]{36,}", base=False),
    # From the start of a run only and without going back into one, so that long runs take linear time.
    Rule("web", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", base=False),
)
RULES_VERSION = "2"


def spans_of(text: str | None, compiled: list[tuple]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of a text, by start, then in the order of the rules."""
    found = []
    for k, (rule, rx) in enumerate(compiled):
        for m in rx.finditer(text or ""):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), k, m.end()))
    return [(compiled[k][0].kind, a, b) for a, k, b in sorted(found)]


def compiled_rules(rules: tuple[Rule, ...]) -> list[tuple]:
    return [(r, re.compile(r.pattern, re.ASCII)) for r in rules]


def blob_id(text: Column) -> Column:
    """The address of a text: the SHA-256 of its UTF-8 bytes; a null text is as an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def row_key(path: Column, blob: Column) -> Column:
    """16 bytes that stand for a path and a blob."""
    known = F.when(path.isNull(), F.lit("n")).otherwise(F.concat(F.lit("p"), path.cast("string")))
    return F.substring(F.unhex(F.sha2(F.concat_ws("|", F.hex(blob), known), 256)), 1, 16)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan the texts that the ledger doesn't have under this version of the rules.

    versions has a row per path and historical version. Returns (paths, entries): paths holds path and blob
    of every row, entries the new ledger rows (blob, rules_version, spans), one for each blob scanned,
    with or without findings; append them to the ledger.

    Blobs are found and compared by address. Each unseen blob is scanned from the row with its smallest path. The rows to
    skip or to scan, whichever are fewer, are kept as sorted keys in the shared folder, which tasks look up where the texts are
    read: no text is shuffled. Null paths, null and empty texts, repeated rows and an empty table are fine.
    """
    text = F.col(text_col)
    paths = stored(versions.select(F.col(path_col).alias("path"), blob_id(text).alias("blob")), "paths")
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rules_version") == rules_version).select("blob"), "blob", "left_anti")
    first = stored(first.select(F.col("path").alias("_path"), F.col("blob").alias("_blob")), "blobs")
    same = paths["path"].eqNullSafe(first["_path"]) & (paths["blob"] == first["_blob"])
    n, unseen = paths.count(), first.count()
    skip = unseen * 2 > n  # the same rows are scanned either way
    some = stored(paths.join(first, same, "left_anti" if skip else "left_semi").select(row_key(F.col("path"), F.col("blob")).alias("key")).distinct(), "row-keys")
    keys = KeySet.of(some, "row-set", some.count())
    rows = versions.select(blob_id(text).alias("blob"), row_key(F.col(path_col), blob_id(text)).alias("key"), text.alias("text")).select("blob", "key", keys.file_of(F.col("key")).alias("file"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compiled_rules(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            batch = batch.filter(pa.array(keys.has(batch.column(1), batch.column(2).to_numpy()) != skip))
            got = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(x.as_py(), compiled)] for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], ["blob", "spans"])

    scanned = rows.mapInArrow(work, f"blob binary, spans {SPANS}")
    entries = scanned.dropDuplicates(["blob"]).select("blob", F.lit(rules_version).alias("rules_version"), "spans")
    return paths, stored(entries, "ledger")


def findings(paths: DataFrame, ledger: DataFrame, rules_version: str = RULES_VERSION) -> DataFrame:
    """path, blob and spans of every row of paths, from the ledger's entries of this rule version."""
    entries = ledger.where(F.col("rules_version") == rules_version).select("blob", "spans")
    clean = entries.where("size(spans) > 0")
    return paths.join(clean, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
