"""Benchmark decontamination: pigeonhole pieces, then Myers bit-parallel edit distance."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import map_file, new_folder, store_file

_GAP = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Lower case; every run of what is neither letter nor digit is one space."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def best_distance(pattern: str, text: str, most: int) -> int:
    """The least edit distance of the pattern to any part of the text, or most + 1 if it is larger.

    Myers' bit-parallel recurrence, a whole column in one integer.
    """
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return min(best, most + 1)


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int
    whole: bool = False  # too short to be sought inside a document: only one that is nothing else holds it


def pieces(item: Item) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into its error budget plus one pieces of nearly equal length."""
    n, k = len(item.text), item.budget + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, item.text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Matcher:
    """Finds items in texts with at most their budget of edits."""

    def __init__(self, items: list[Item]):
        self.items = items
        at: dict[str, list[tuple[int, int]]] = {}
        self.short: dict[str, list[int]] = {}
        for k, item in enumerate(items):
            if item.whole:
                self.short.setdefault(item.text, []).append(item.item_id)
                continue
            for offset, piece in pieces(item):
                at.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(item_id, distance) of every item that a normalised text holds, by item."""
        if not self.items or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text) if len(self.automaton) else ():
            for k, offset in where:
                item = self.items[k]
                a = max(0, end + 1 - size - offset - item.budget)
                b = min(len(text), end + 1 - size - offset + len(item.text) + item.budget)
                spans = windows.setdefault(k, [])
                if spans and spans[-1][0] <= a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
        out = []
        for k, spans in windows.items():
            item = self.items[k]
            best = item.budget + 1
            if not item.budget:  # unchanged, from word to word
                best = 0 if f" {item.text} " in f" {text} " else 1
            for a, b in spans:
                if item.budget and b - a >= len(item.text) - item.budget and best:
                    best = min(best, best_distance(item.text, text[a:b], item.budget))
            if best <= item.budget:
                out.append((item.item_id, best))
        return sorted(out + [(i, 0) for i in self.short.get(text, [])])


def benchmark_items(benchmark: DataFrame, error_rate: float = 0.05, least_piece: int = 16, least_chars: int = 20, id_col: str = "item_id", text_col: str = "text", block_chars: int = 2_000_000) -> list[str]:
    """The paths of files in the shared folder with the benchmark's items, normalised, in blocks of about block_chars characters.

    Tasks write and read them; the driver knows the paths only. An item's budget is error_rate of its length, but no more than leaves pieces of
    least_piece characters. Items of under least_chars characters count as whole (see Item). Null items and
    those without a letter or digit match nothing and are left out.
    """
    chars = benchmark.agg(F.sum(F.length(text_col))).first()[0]
    blocks = max(1, -(-(chars or 0) // block_chars))
    folder = new_folder(benchmark.sparkSession, "benchmark")

    def work(table: pa.Table) -> pa.Table:
        k = table.column("block")[0].as_py()
        items = []
        for i, t in sorted(zip(table.column("i").to_pylist(), table.column("t").to_pylist(), strict=True)):
            text = normalised(t)
            if text:
                short = len(text) < least_chars
                items.append(Item(i, text, 0 if short else max(0, min(int(len(text) * error_rate), len(text) // least_piece - 1)), short))
        store_file(f"{folder}/{k}", pickle.dumps(items))
        return pa.table({"block": pa.array([k], pa.int32())})

    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    made = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(work, "block int")
    return [f"{folder}/{r['block']}" for r in made.orderBy("block").collect()]


def read_items(path: str) -> list[Item]:
    return pickle.loads(map_file(path).tobytes())


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_items, items (array of item_id and distance, by item) and contaminated of every row.

    A document is contaminated if it holds an item with edits for at most error_rate of its characters,
    after case, punctuation and white space are levelled. Pieces of all items are sought in one pass of a
    multi-pattern automaton; a pigeonhole piece must occur unchanged wherever an item does, so no match
    within the budget is missed. Items without a budget must stand from word to word; items of under 20 characters match only a
    document that is nothing else, as they occur in ordinary text. A benchmark of many blocks (see benchmark_items) is one pass over the documents, too (see BlockSearch).

    Null and empty texts hold nothing. Null ids and repeated rows each keep their row. Other columns are
    ignored.
    """
    kind = "array<struct<item_id:bigint,distance:int>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_leaks(benchmark_items(benchmark, error_rate)), f"doc_id long, items {kind}")
    return found.select("doc_id", F.size("items").alias("n_items"), "items", (F.size("items") > 0).alias("contaminated"))


class BlockSearch:
    """The task side of find_leaks: searches texts for the items of all blocks, one block's automaton at a time.

    Batches are held up to about held_bytes of text and then searched block by block, so memory is that of one automaton and those
    texts, however large the benchmark. Every second round takes the blocks backwards and so starts with the automaton at hand.
    A benchmark of one block holds nothing back.
    """

    def __init__(self, paths: list[str], held_bytes: int = 64_000_000):
        self.paths, self.held_bytes = list(paths), held_bytes
        self._at, self._matcher = None, None

    def matcher(self, path: str) -> Matcher:
        if self._at != path:
            self._at, self._matcher = None, None  # before the next one is built
            self._at, self._matcher = path, Matcher(read_items(path))
        return self._matcher

    def search(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int]]]]]:
        """Each batch with the (item_id, distance) found in each of its texts, by item."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(column).nbytes
            if len(self.paths) < 2 or size >= self.held_bytes:
                yield from self._searched(held, column)
                held, size = [], 0
        yield from self._searched(held, column)

    def _searched(self, held: list[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int]]]]]:
        found = [[[] for _ in range(len(batch))] for batch in held]
        if held and self.paths and self._at == self.paths[-1]:
            self.paths.reverse()
        for path in self.paths if held else ():
            matcher = self.matcher(path)
            for batch, own in zip(held, found, strict=True):
                for hits, x in zip(own, batch.column(column), strict=True):
                    hits += matcher.matches(normalised(x.as_py()))
        for batch, own in zip(held, found, strict=True):
            yield batch, [sorted(hits) for hits in own]


def _leaks(paths: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
        for batch, found in BlockSearch(paths).search(batches, 1):
            got = [[{"item_id": i, "distance": d} for i, d in hits] for hits in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], ["doc_id", "items"])

    return work


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    at, paths = docs.columns.index(text_col), benchmark_items(benchmark, error_rate)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in BlockSearch(paths).search(batches, at):
            yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
