"""Packing: bounded-space best-fit packing of token ids into fixed windows."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ODD = tuple(map(chr, range(0x1C, 0x20)))
#: Words of printable ASCII and Latin letters without a special token: their normal form is the lower-case one,
#: and how the tokenizer parts them is as simple as _PARTS. All others go through the whole tokenizer.
_PLAIN = re.compile("[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
_LETTER = "a-z\u00df-\u00f6\u00f8-\u017e"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Tokens:
    """Ids of texts by a lower-casing byte-level tokenizer that parts words at white space.

    They come as little-endian uint32 bytes. Words between white space are encoded once and kept, up to
    so many of at most 64 characters; so are their parts, which the tokenizer's model encodes one by one.
    """

    def __init__(self, tokenizer_file: str, most_words: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.most = most_words

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            word = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode().decode("latin-1")))
            ids = [t.id for t in self.model.tokenize(word)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.parts) < self.most and len(part) <= 64:
                self.parts[part] = got
        return got

    def _words(self, words: list[str]) -> dict[str, bytes]:
        out, odd = {}, []
        for w in words:
            if _PLAIN.fullmatch(w):
                out[w] = b"".join(map(self._part, _PARTS.findall(w.lower())))
            else:
                odd.append(w)
        out.update(zip(odd, self._encode(odd), strict=True))
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [None if any(c in x for c in _ODD) else x.split() for x in texts]
        known = self.known
        fresh = self._words([w for w in set().union(*(words for words in split if words)) if w not in known])
        if len(self.known) + len(fresh) <= self.most:
            known.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
            fresh = {w: ids for w, ids in fresh.items() if len(w) > 64}
        get = known.get
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out += self._encode([text])
            elif fresh:
                out.append(b"".join([get(w) or fresh.get(w, b"") for w in words]))
            else:
                out.append(b"".join(map(known.__getitem__, words)))
        return out


class Windows:
    """A fixed number of open windows; a finished one is handed to emit as a list of pieces."""

    def __init__(self, size: int, most_open: int, most_waste: int, emit):
        self.size, self.most_open, self.most_waste, self.emit = size, most_open, most_waste, emit
        self.open: list[list] = []
        self.used: list[int] = []

    def _close(self, k: int) -> None:
        self.emit(self.open.pop(k))
        self.used.pop(k)

    def add(self, piece: tuple) -> None:
        """piece: (document, start, ids). Whole windows are cut off first; what is left is placed best-fit."""
        doc, start, ids = piece
        n = len(ids)
        whole = n - n % self.size
        for k in range(0, whole, self.size):
            self.emit([(doc, start + k, ids[k : k + self.size])])
        if whole == n:
            return
        start, ids, n = start + whole, ids[whole:], n - whole
        best, room = -1, self.size + 1
        for k, used in enumerate(self.used):
            if n <= self.size - used < room:
                best, room = k, self.size - used
        if best < 0 and len(self.open) >= self.most_open:
            full = max(range(len(self.open)), key=self.used.__getitem__)
            gap = self.size - self.used[full]
            if gap > self.most_waste:  # too much to pad: the document is cut to fill it
                self.open[full].append((doc, start, ids[:gap]))
                start, ids, n = start + gap, ids[gap:], n - gap
            self._close(full)
        if best < 0:
            self.open.append([])
            self.used.append(0)
            best = len(self.open) - 1
        self.open[best].append((doc, start, ids))
        self.used[best] += n
        if self.used[best] == self.size:
            self._close(best)

    def merge(self) -> None:
        """Join the windows left open, cutting at the window size; the last is cut at powers of two."""
        for k in [k for k in range(len(self.open)) if self.size - self.used[k] <= self.most_waste][::-1]:
            self._close(k)
        order = sorted(range(len(self.open)), key=self.used.__getitem__, reverse=True)
        pieces = [p for k in order for p in self.open[k]]
        total = sum(self.used)
        self.open, self.used = [], []
        sizes = []
        while total:
            take = self.size if total >= self.size - self.most_waste else 1 << (total.bit_length() - 1)
            sizes.append(min(take, total))
            total -= sizes[-1]
        at = 0
        for size in sizes:
            window = []
            while size:
                doc, start, ids = pieces[at]
                window.append((doc, start, ids[:size]))
                size -= (took := len(window[-1][2]))
                if took == len(ids):
                    at += 1
                else:
                    pieces[at] = (doc, start + took, ids[took:])
            self.emit(window)


def pack_documents(docs: DataFrame, tokenizer_file: str, size: int = 4096, end_id: int = 2, most_open: int = 64, most_waste: int = 32, id_col: str = "doc_id", text_col: str = "text", most_words: int = 500_000) -> DataFrame:
    """Pack the ids of all documents, each followed by end_id, into windows of at most size ids.

    Returns a row per piece: doc_id, start (ids of its document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens (ids of its document), sequence_id and offset (in the sequence).

    Every partition is packed on its own in one pass: most_open windows stay open; a remainder goes into
    the one it fills best. If none has room, the fullest is emitted; if that would pad more than
    most_waste ids, the document is cut to fill it. At the end the open windows are merged, and the last
    one is cut at powers of two, which need no padding. Nothing is shuffled, so a lost task is packed again
    to the same result.

    A null text counts as empty and has the one id end_id. Null ids are kept as null. Repeated rows are
    packed each. An empty table gives no rows. Other columns are ignored. A task keeps the ids of at most most_words
    words and of as many parts of words (some 250 bytes for a word with its part); others are encoded each time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer_file, most_words)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        sequences = 0

        def emit(window: list[tuple]) -> None:
            nonlocal sequences
            offset = 0
            for (doc, n), start, ids in window:
                rows.append((doc, start, len(ids), ids.tobytes(), n, (part << 32) + sequences, offset))
                offset += len(ids)
            sequences += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        windows = Windows(size, most_open, most_waste, emit)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            k = 0
            while k < len(ids):
                some, chars = [], 0
                while k + len(some) < len(ids) and (chars < 1_000_000 or not some):
                    some.append(texts[k + len(some)].as_py() or "")
                    chars += len(some[-1])
                for doc, raw in zip(ids[k : k + len(some)], tokens.batch(some), strict=True):
                    got = np.frombuffer(raw + end, "<u4")
                    windows.add(((doc, len(got)), 0, got))
                k += len(some)
                if rows:
                    yield flush()
        windows.merge()
        if rows:
            yield flush()

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(pack, SCHEMA)
