"""An interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays.

Words are told apart by 48 bits of XXH64: of v different words about v * v / 2**49 share a hash with another and count as
one word (0.2 of 10 million; 2000 of a billion, or two in a million). All other sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import file_exists, map_file, new_folder, store_file

#: Hashes that stand for the start of a text (a context only) and its end (a token only).
START, END = 1, 2
SUB = 256  # parts of a shard's array, each with 32-bit keys of its own
WORD_COLUMNS = ("c", "follows", "n1", "n2", "n3")


class WordHashes:
    """48-bit hashes of a text's lower-cased words and, last, of its end."""

    def __init__(self, most_words: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.most = most_words

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        got = list(map(self.known.get, words))
        if None in got:
            room = len(self.known) < self.most
            for k, h in enumerate(got):
                if h is None:
                    got[k] = h = xxhash.xxh64_intdigest(words[k], 42) >> 16
                    if room:
                        self.known[words[k]] = h
        got.append(END)
        return np.array(got, np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of word hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _short(h: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8, 6 * n).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys and the starts of equal ones in it."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _pair_counts(shards: int, flush: int = 3_000_000):
    """Counts the pairs of neighbours of a partition's texts; a row per so many tokens and shard that has a pair among them."""

    def out(firsts: list, seconds: list) -> pa.RecordBatch:
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        key = mixed(a, b)
        order, starts = _grouped(key)
        count = np.diff(np.r_[starts, len(order)]).astype("<u4")
        pick = order[starts]
        a, b = a[pick], b[pick]
        edges = np.searchsorted(key[pick] >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64) * np.uint64((1 << 32) // shards))
        own = np.flatnonzero(np.diff(edges))
        blobs = [_short(a[x:y]) + _short(b[x:y]) + count[x:y].tobytes() for x, y in zip(edges[own], edges[own + 1], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        firsts, seconds, count = [], [], 0
        for batch in batches:
            for x in batch.column(0):
                h = hashes(x.as_py())
                firsts.append(np.r_[np.uint64(START), h[:-1]])
                seconds.append(h)
                count += len(h)
                if count >= flush:
                    yield out(firsts, seconds)
                    firsts, seconds, count = [], [], 0
        if count:
            yield out(firsts, seconds)

    return work


def _counts_of_counts(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)] + [int((count > 4).sum())]


def _merge_pairs(folder: str, shards: int):
    """Adds up a shard's pairs, stores its array, hands on what each word has as first and as second."""

    def work(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [(x.as_py(), len(x.as_py()) // 16) for x in table.column("blob")]
        a = np.concatenate([_long(r[: 6 * n], n) for r, n in parts])
        b = np.concatenate([_long(r[6 * n : 12 * n], n) for r, n in parts])
        c = np.concatenate([np.frombuffer(r, "<u4", n, 12 * n) for r, n in parts])
        del parts
        key = mixed(a, b)
        order, starts = _grouped(key)
        count = np.add.reduceat(c[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        pick = order[starts]
        a, b, key = a[pick], b[pick], key[pick]
        store_file(f"{folder}/pairs-{shard}", _pair_file(key, count, shards))
        rows = []
        stats = np.array(_counts_of_counts(count), "<i8").tobytes()
        whole = np.uint64(1 << 48) // np.uint64(shards)
        for h, first in ((a, True), (b, False)):
            order, starts = _grouped(h)
            add = lambda x, o=order, s=starts: np.add.reduceat(x[o].astype(np.int64), s) if len(s) else np.zeros(0, np.int64)
            zero = np.zeros(len(starts), np.int64)
            word = h[order[starts]]
            if first:
                cols = [np.where(word == START, add(count), 0), zero, add(count == 1), add(count == 2), add(count > 2)]
            else:
                cols = [add(count), add(np.ones(len(count))), zero, zero, zero]
            edges = np.searchsorted(word // whole, np.arange(shards + 1, dtype=np.uint64))
            for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                if y > x:
                    rows.append((k, _short(word[x:y]) + b"".join(v[x:y].astype("<u8").tobytes() for v in cols), b""))
        rows.append((0, b"", stats))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary()), "stats": pa.array([r[2] for r in rows], pa.binary())})

    return work


def _pair_file(key: np.ndarray, count: np.ndarray, shards: int) -> bytes:
    """Part offsets, 32-bit keys in order, counts as bytes, and the counts from 255 with their places."""
    bits = np.uint64(shards.bit_length() - 1)
    inner = key << bits
    offsets = np.searchsorted(inner >> np.uint64(56), np.arange(SUB + 1, dtype=np.uint64)).astype("<i8")
    low = ((inner >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    big = np.flatnonzero(count >= 255)
    return b"".join([np.array([len(key), len(big)], "<i8").tobytes(), offsets.tobytes(), big.astype("<i8").tobytes(), count[big].astype("<i8").tobytes(), low.tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes()])


def _merge_words(folder: str):
    """Adds up a shard's words, stores their array, returns one row of sums."""

    def work(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        width = 6 + 8 * len(WORD_COLUMNS)
        parts = [(x.as_py(), len(x.as_py()) // width) for x in table.column("blob")]
        h = np.concatenate([_long(r, n) for r, n in parts])
        cols = [np.concatenate([np.frombuffer(r, "<u8", n, 6 * n + 8 * n * k) for r, n in parts]).astype(np.int64) for k in range(len(WORD_COLUMNS))]
        del parts
        order, starts = _grouped(h)
        cols = [np.add.reduceat(c[order], starts) if len(starts) else np.zeros(0, np.int64) for c in cols]
        h = h[order[starts]]
        store_file(f"{folder}/words-{shard}", b"".join([np.array([len(h)], "<i8").tobytes(), h.astype("<u8").tobytes(), cols[0].astype("<i8").tobytes(), *(c.astype("<u4").tobytes() for c in cols[1:])]))
        word = h != START
        sums = [int(word.sum()), int(cols[0][word].sum()), *_counts_of_counts(cols[1][word & (cols[1] > 0)]), int(cols[1].sum())]
        pairs = [np.frombuffer(x.as_py(), "<i8") for x in table.column("stats") if len(x.as_py())]
        sums += [int(x) for x in np.sum(pairs, 0)] if pairs else [0] * 5
        return pa.table({f"s{k}": pa.array([v], pa.int64()) for k, v in enumerate(sums)})

    return work


def discounts(t: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and above, from how many have count 1 to 4.

    Where the counts can't tell (a zero among them), 0.5, 1 and 1.5.
    """
    if not all(t[:4]):
        return [0.5, 1.0, 1.5]
    y = t[0] / (t[0] + 2 * t[1])
    return [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


@dataclass
class Model:
    """Where a model's arrays are, and its sums. Small: it goes to the tasks, the arrays are mapped there."""

    folder: str
    shards: int
    words: int
    tokens: int
    follow_counts: list[int]
    pairs: int
    pair_counts: list[int]
    most_open: int = 4096
    _maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def _opened(self, kind: str, k: int) -> np.ndarray:
        """A shard's file, mapped; the maps opened first are let go beyond most_open. A shard without any pair or word has no file."""
        while len(self._maps) >= self.most_open:
            self._maps.pop(next(iter(self._maps)))
        path = f"{self.folder}/{kind}-{k}"
        return map_file(path) if file_exists(path) else np.zeros(16 + 8 * (SUB + 1), np.uint8)

    def _words(self, k: int) -> tuple:
        if ("w", k) not in self._maps:
            raw = self._opened("words", k)
            n = int(raw[:8].view("<i8")[0]) if len(raw) else 0
            at, out = 8, []
            for dtype, size in (("<u8", 8), ("<i8", 8), *(("<u4", 4),) * 4):
                out.append(raw[at : at + size * n].view(dtype))
                at += size * n
            self._maps["w", k] = tuple(out)
        return self._maps["w", k]

    def _pairs(self, k: int) -> tuple:
        if ("p", k) not in self._maps:
            raw = self._opened("pairs", k)
            n, big = raw[:16].view("<i8").tolist()
            at, out = 16, []
            for dtype, size, m in (("<i8", 8, SUB + 1), ("<i8", 8, big), ("<i8", 8, big), ("<u4", 4, n), ("u1", 1, n)):
                out.append(raw[at : at + size * m].view(dtype))
                at += size * m
            self._maps["p", k] = tuple(out)
        return self._maps["p", k]

    def word_stats(self, h: np.ndarray) -> np.ndarray:
        """WORD_COLUMNS of each of the ascending hashes; zeros for an unknown one."""
        out = np.zeros((len(WORD_COLUMNS), len(h)), np.int64)
        edges = np.searchsorted(h // (np.uint64(1 << 48) // np.uint64(self.shards)), np.arange(self.shards + 1, dtype=np.uint64))
        for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            if self.tokens and y > x:
                keys, *cols = self._words(k)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h[x:y]), len(keys) - 1)
                    hit = keys[at] == h[x:y]
                    for c, col in enumerate(cols):
                        out[c, x:y] = np.where(hit, col[at], 0)
        return out

    def pair_counts_of(self, key: np.ndarray) -> np.ndarray:
        """How often each of the ascending pair hashes was seen."""
        out = np.zeros(len(key), np.int64)
        if not self.tokens:
            return out
        bits = self.shards.bit_length() - 1
        inner = key << np.uint64(bits)
        low = ((inner >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        part = (key >> np.uint64(56 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for x, y in zip(starts, [*starts[1:], len(part)], strict=True):
            offsets, big, counts, keys, small = self._pairs(int(part[x]) // SUB)
            a, b = offsets[int(part[x]) % SUB : int(part[x]) % SUB + 2]
            if b > a:
                some = keys[a:b]
                at = np.minimum(np.searchsorted(some, low[x:y]), b - a - 1)
                got = np.where(some[at] == low[x:y], small[a + at], 0).astype(np.int64)
                if len(big) and (over := np.flatnonzero(got == 255)).size:
                    got[over] = counts[np.searchsorted(big, a + at[over])]
                out[x:y] = got
        return out

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, the base's log10 and the model's log10 of each text (word hashes)."""
        length = np.array([len(h) for h in texts])
        h = np.concatenate(texts)
        first = np.r_[0, np.cumsum(length)[:-1]]
        before = np.r_[np.uint64(START), h[:-1]]
        before[first] = START
        uniq, inv = np.unique(np.r_[h, before], return_inverse=True)
        stats = self.word_stats(uniq)
        word, ctx = inv[: len(h)], inv[len(h) :]
        c = stats[0][word]
        base = np.log10((c + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        d1, d2 = discounts(self.follow_counts), discounts(self.pair_counts)
        t, n = self.follow_counts, max(self.pairs, 1)
        spare = (d1[0] * t[0] + d1[1] * t[1] + d1[2] * sum(t[2:])) / n if self.pairs else 1.0
        off = np.array([0.0, *d1])[np.minimum(stats[1], 3)]
        p1 = np.maximum(stats[1] - off, 0) / n + spare / (self.words + 1)
        total = np.maximum(stats[0], 1)
        gamma = np.where(stats[0] > 0, (d2[0] * stats[2] + d2[1] * stats[3] + d2[2] * stats[4]) / total, 1.0)
        key = mixed(before, h)
        order = np.argsort(key, kind="stable")
        seen = np.empty(len(h), np.int64)
        seen[order] = self.pair_counts_of(key[order])
        p = np.maximum(seen - np.array([0.0, *d2])[np.minimum(seen, 3)], 0) / total[ctx] + gamma[ctx] * p1[word]
        return length, np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


def train(docs: DataFrame, text_col: str = "text", shard_tokens: int = 8_000_000) -> Model:
    """A bigram model of all texts of docs, stored in the shared folder.

    Tasks count pairs of neighbouring words and shuffle them, by the hash of the pair, as packed sorted
    arrays; a frequent word's pairs so spread over all shards. Each shard's pairs are added up and
    stored, and what they say about single words is shuffled and added up in the same way. Only sums
    reach the driver. shard_tokens sets the number of shards (a power of two) from the corpus size.

    A null text counts as empty: it has the end as its one token. Whoever chooses docs decides on null ids; op5 doesn't learn from them.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).alias("text"))
    spaces = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, spaces / 6 / shard_tokens)))))
    folder = new_folder(spark, "lm")
    parted = text.mapInArrow(_pair_counts(shards), "shard int, blob binary")
    pairs = parted.groupBy("shard").applyInArrow(_merge_pairs(folder, shards), "shard int, blob binary, stats binary")
    sums = pairs.groupBy("shard").applyInArrow(_merge_words(folder), ", ".join(f"s{k} long" for k in range(13)))
    s = [x or 0 for x in sums.agg(*(F.sum(f"s{k}") for k in range(13))).first()]
    return Model(folder, shards, s[0], s[1], s[2:7], s[7], s[8:13])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = 500_000) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every text.

    Null texts count as empty. Null ids are kept. Repeated rows each get a row; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids: list = []
        held: list[np.ndarray] = []
        count = 0

        def out() -> pa.RecordBatch:
            cols = model.score(held)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, cols)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for i, x in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                held.append(hashes(x.as_py()))
                count += len(held[-1])
                if count >= batch_tokens:
                    yield out()
                    ids, held, count = [], [], 0
        if held:
            yield out()

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(work, "doc_id long, n_tokens long, n_known long, base_score double, score double")
