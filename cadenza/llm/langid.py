"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass
class Features:
    """Hashed counts of the character n-grams of a lower-cased text."""

    size: int = 1 << 15
    most: int = 3

    def __call__(self, text: str, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The hashes that occur and how often. Long texts are counted in parts that overlap."""
        chars = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), "<u4")
        total = np.zeros(self.size, np.int64) if len(chars) > 3000 else None
        found = []
        for a in range(0, len(chars), part):
            c = chars[a : a + part + self.most - 1]
            own = min(part, len(chars) - a)
            h = c * np.uint32(0x9E3779B1)
            for n in range(1, self.most + 1):
                if n > 1:
                    h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :]
                k = (h * np.uint32(0xC2B2AE35) >> np.uint32(32 - self.size.bit_length() + 1))[:own]
                if total is None:
                    found.append(k)
                else:
                    total += np.bincount(k, minlength=self.size)
        if total is None:
            return np.unique(np.concatenate(found), return_counts=True)
        at = np.flatnonzero(total)
        return at, total[at]


@dataclass
class Ftrl:
    """Follow-the-regularised-leader for a softmax over sparse vectors, with L1 and L2 penalties."""

    classes: int
    size: int
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.002

    def __post_init__(self):
        self.z, self.n = np.zeros((self.classes, self.size)), np.zeros((self.classes, self.size))

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[:, at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[:, at])) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        after = n + g * g
        self.z[:, at] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = after


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


@dataclass
class LanguageModel:
    features: Features
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, tf = self.features(text)
        x = np.log1p(tf) * self.idf[at]
        return at, x / (np.sqrt(x @ x) or 1.0)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.vector(text)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; und and 0 for a text that has no letter."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on held-out texts, from 1/256 to 256.

    As in Platt's calibration the targets are not 1 but (n + 1) / (n + 2) of n texts, the rest for the other classes: where
    all texts are told right the loss is least at a probability that so many texts can vouch for, not at the grid's edge.
    """
    n, k = logits.shape if len(labels) else (0, 0)
    if k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - (target * x).sum(1)).mean())

    return float(min(np.geomspace(1 / 256, 256, 257), key=loss))


def _document_counts(features: Features):
    """How many texts of a partition have each hash; the last row counts the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(features.size + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                at, _ = features(x.as_py())
                n[at] += 1
                n[-1] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["hash", "n"])

    return work


def _fit(features: Features, languages: list[str], idf: np.ndarray, epochs: int):
    """Trains on the rows (text, lang, draw) of one task; a row with temperature and weights comes out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(features, languages, idf, np.zeros((0, 0)), 1.0)
        rows = []
        for batch in batches:
            for text, lang, draw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                at, x = model.vector(text)
                rows.append((draw, languages.index(lang), at.astype(np.int32), x.astype(np.float32)))
        rows.sort(key=lambda r: r[:2])
        # Every fifth text of a language is held out, the fifth first, so that one of few texts is learnt from.
        seen = [0] * len(languages)
        held, learnt = [], []
        for r in rows:
            seen[r[1]] += 1
            (held if seen[r[1]] % 5 == 0 and len(rows) >= 50 else learnt).append(r)
        ftrl = Ftrl(len(languages), features.size)
        for _ in range(epochs):
            for _, label, at, x in learnt:
                ftrl.step(at, x, label)
        w = ftrl.weights().T.astype(np.float32)
        t = temperature_of(np.array([x @ w[at] for _, _, at, x in held]), np.array([r[1] for r in held], int)) if held else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([w.tobytes()], pa.binary())], ["temperature", "weights"])

    return work


def learn(labelled: DataFrame, features: Features | None = None, per_language: int = 2000, epochs: int = 4, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn languages from rows of text and language; rows with a null in either are left out.

    Inverse document frequencies are counted over all rows. The classifier is fitted by one task on a
    sample of at most per_language different texts of each language, those with the smallest hashes; every fifth of a language
    calibrates the temperature (1 with fewer than 50 rows, which are all learnt from). Copies count once, so that a language of
    few texts has them all in the sample, however many rows there are. No labelled row: a model that answers und.
    """
    features = features or Features()
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null and text <> ''")
    # About how many different texts; a twentieth off at most times, for which the share has room.
    count = {r["lang"]: max(r["n"], 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    languages = sorted(count)
    if not languages:
        return LanguageModel(features, [], np.zeros(features.size), np.zeros((features.size, 0)), 1.0)
    n = np.zeros(features.size + 1, np.int64)
    for r in rows.select("text").mapInArrow(_document_counts(features), "hash int, n long").groupBy("hash").agg(F.sum("n").alias("n")).collect():
        n[r["hash"]] = r["n"]
    idf = np.log((1 + n[-1]) / (1 + n[:-1])) + 1
    share: Column = F.lit(None)
    for lang, k in count.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.3 * per_language / k + 20 / k))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("draw"), "text"), F.lit(1 << 50))
    drawn = rows.withColumn("draw", draw).where(F.col("draw") / (1 << 50) < share).dropDuplicates(["lang", "draw"])
    # The share lets little more than the sample through, so a language's rows fit one task.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    sample = drawn.withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang", "draw")
    fitted = sample.repartition(1).mapInArrow(_fit(features, languages, idf, epochs), "temperature double, weights binary").first()
    return LanguageModel(features, languages, idf, np.frombuffer(fitted["weights"], np.float32).reshape(features.size, len(languages)), fitted["temperature"])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, by its whole text alone.

    und with score 0 for a null text, one without letters, or a model that learnt nothing. Null ids and
    repeated rows each keep their row; an empty table gives no rows; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is told with at least this probability."""
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x in batch.column(at):
                lang, score = model.predict(x.as_py())
                keep.append(lang != UNKNOWN and score >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
