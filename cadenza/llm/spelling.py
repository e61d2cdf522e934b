"""Spelling variants: words one edit apart, found by a relational frontier over two distributed tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stored

LETTERS = "[A-Za-zÀ-ÿ]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sides of a word: 0 as written, 1 reversed.
SIDES = (0, 1)


def runs(docs: DataFrame, least_length: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and run: the maximal runs of letters of whole texts, of at least so many code points, with A-Z in lower case. Null texts have none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("run")).select("doc_id", F.translate("run", CAPITALS, SMALL).alias("run"))


def worn(doc_id: Column, run: Column, modulus: int = 31) -> Column:
    """The run as it is, or without one code point where modulus divides the CRC-32 h of "doc_id:run": that at h % length. A null id is as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """word and n of the words (column word) of at least so many code points and occurrences."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _first(side: int, lengths: np.ndarray) -> np.ndarray:
    """The depth from which on a word's path is asked for: by words as long, or longer by one, where these start (see _start)."""
    return lengths // 2 if side == 0 else (lengths + 1) // 2


def _start(side: Column) -> Column:
    """The depth at which the frontier of a word starts: an edit lies behind the first half, or, reversed, behind the rest."""
    half = F.floor(F.length("word") / 2)
    return F.when(side == 0, half).otherwise(F.length("word") - half).cast("int")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefixes(words: DataFrame) -> DataFrame:
    """word, side, depth, node and next of the prefixes of each word that a frontier can reach, in time linear in the words' lengths.

    node is a hash of side and prefix: a rolling sum modulo 2^64, mixed. If two prefixes ever share one, the
    trie has further paths there and loses none; found words are compared in full. next is the code point after the prefix, -1 at the word's end.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 4096) for k in range(0, len(batch), 4096)):
                words = part.column(0)
                texts = words.to_pylist()
                lengths = np.array([len(t) for t in texts], np.int64)
                starts = np.cumsum(lengths) - lengths
                codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                place = np.arange(len(codes)) - np.repeat(starts, lengths)
                power = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64)])
                for side in SIDES:
                    own = codes if side == 0 else codes[np.repeat(starts + lengths - 1, lengths) - place]
                    sums = np.r_[np.uint64(0), np.cumsum(_mixed(own.astype(np.uint64) + np.uint64(1)) * power[place])]
                    first = _first(side, lengths)
                    count = lengths - first + 1
                    word = np.repeat(np.arange(len(texts)), count)
                    depth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[word]
                    at = starts[word] + depth
                    node = _mixed(sums[at] - sums[starts[word]] + (depth * 2 + side + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                    ends = depth == lengths[word]
                    after = np.where(ends, -1, np.r_[own, np.uint32(0)][np.where(ends, 0, at)].astype(np.int64)).astype(np.int32)
                    columns = [words.take(pa.array(word)), pa.array(np.full(len(word), side, np.int32)), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(after)]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "side", "depth", "node", "next"])

    return words.select("word").mapInArrow(work, "word string, side int, depth int, node long, next int")


def _oriented(word: Column, side: Column) -> Column:
    return F.when(side == 0, word).otherwise(F.reverse(word))


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of both tries and the start states of all words, as stored tables.

    Nodes are the prefixes after which words differ (one ending there differs too), so an edge holds all code points up to the next of them, and a
    path has few edges however long its word. An edge of the last node of a word leads to the word itself.
    edges: node, first (code point of the label, or empty), label, child, after (marks of what follows the child), found (the word, or null).
    states: word, side, position, node, edits.
    """
    paths = prefixes(words)
    nodes = paths.groupBy(F.col("node").alias("_node")).agg(F.min("next").alias("a"), F.max("next").alias("b"), F.bit_or(F.expr("shiftleft(1L, cast(if(next < 0, 63, next % 63) as int))")).alias("after")).where("a <> b").select("_node", "after")
    nodes = stored(nodes, "spelling-nodes")
    steps = paths.join(nodes, F.col("node") == F.col("_node")).select("word", "side", F.struct("depth", "node", "after").alias("s"))
    chains = steps.groupBy("word", "side").agg(F.sort_array(F.collect_list("s")).alias("s"))
    chains = stored(chains, "spelling-chains")
    oriented = chains.withColumn("o", _oriented(F.col("word"), F.col("side")))
    exploded = oriented.select("word", "s", "o", F.posexplode(F.col("s")).alias("k", "at")).withColumn("to", F.get("s", F.col("k") + 1))
    depth, end = F.col("at.depth"), F.coalesce(F.col("to.depth"), F.length("o"))
    label = F.substring("o", depth + 1, end - depth)
    edges = exploded.select(F.col("at.node").alias("node"), label.alias("label"), F.col("to.node").alias("child"), F.col("to.after").alias("after"), F.when(F.col("to").isNull(), F.col("word")).alias("found")).distinct()
    edges = stored(edges.select("node", F.substring("label", 1, 1).alias("first"), "label", "child", "after", "found"), "spelling-edges")
    ahead = F.filter("s", lambda x: x["depth"] >= _start(F.col("side")))
    states = chains.select("word", "side", F.get(ahead, F.lit(0)).alias("at")).where("at is not null")
    states = states.select("word", "side", F.col("at.depth").alias("position"), F.col("at.node").alias("node"), F.lit(0).alias("edits"))
    return edges, states


def _meets() -> Column:
    """Whether an edge can lead a state on: it begins with the next code point, or else, without an edit so far, with a greater one or with that after the next."""
    begins = F.col("first")
    return (begins == F.col("next")) | ((F.col("edits") == 0) & (F.col("next") != "") & ((begins > F.col("next")) | (begins == F.col("second"))))


def _steps() -> Column:
    """What a state becomes along an edge, as an array with nulls: structs of near (a word reached), moved (code points used up) and edits.

    The edit is made at the first code point that differs, so a word is reached in one way only: a greater code point replaces it, or it is left out. With an
    edit made, what is left must go on as some path behind the child does; the child's marks tell of most states that they can't.
    """
    rest, label = F.col("rest"), F.col("label")
    size, left = F.length(label), F.length(rest)
    one = lambda near, moved, edits: F.struct(near.cast("string").alias("near"), moved.cast("int").alias("moved"), edits.cast("int").alias("edits"))
    none, fresh = F.lit(None), F.col("edits") == 0
    ahead = lambda n: F.substring(rest, F.lit(1), n)
    differ = lambda part: F.levenshtein(part, label, 1) == 1

    def goes_on(moved: Column) -> Column:
        code = F.ascii(F.substring(rest, moved + 1, F.lit(1)))
        return F.getbit(F.col("after"), F.when(left == moved, 63).otherwise(code % 63)) == 1

    exact = F.startswith(rest, label)
    replaced = F.when((left >= size) & (label > ahead(size)) & goes_on(size) & ((size == 1) | differ(ahead(size))), one(none, size, F.lit(1)))
    left_out = F.when((left > size) & goes_on(size + 1) & differ(ahead(size + 1)), one(none, size + 1, F.lit(1)))
    inner = F.when(exact, F.array(F.when(fresh | goes_on(size), one(none, size, F.col("edits"))))).when(fresh, F.array(replaced, left_out))
    arrived = F.when(fresh, (((left == size) & (label > rest)) | (left == size + 1)) & differ(rest)).otherwise(rest == label)
    return F.when(F.col("found").isNull(), inner).when(arrived, F.array(one(F.col("found"), F.lit(0), F.lit(1))))


def neighbours(words: DataFrame) -> DataFrame:
    """word and near, once each: all ordered pairs of words (column word, without repeats) that differ by one inserted, deleted or replaced code point.

    Two words one edit apart share all before the edit and all behind it. So a word's frontier starts in the trie of words at its first half without
    an edit, and in the trie of reversed words at its second half; one of both meets each neighbour. Level by level the states
    (word, position, node, edits) are joined with the edges of their nodes: each becomes the states that reach the edge's end with one edit at most, and those
    that reach a word with one are neighbours. Each level is stored. There are as many levels as differing places on a path at most. As being near
    goes both ways, a frontier only leaves a code point out or puts a greater one in its place.

    Null words are left out; an empty table gives no rows.
    """
    words = words.where("word is not null").select("word")
    edges, states = trie(words)
    pairs = None
    while True:
        rest = F.substring(_oriented(F.col("word"), F.col("side")), F.col("position") + 1, F.length("word"))
        state = states.select("word", "side", "position", F.col("node").alias("_node"), "edits", rest.alias("rest"))
        state = state.select("*", F.substring("rest", 1, 1).alias("next"), F.substring("rest", 2, 1).alias("second"))
        moved = state.join(edges, (F.col("node") == F.col("_node")) & _meets()).select("word", "side", "position", "child", F.explode(_steps()).alias("s")).where("s is not null")
        level = moved.select("word", "side", (F.col("position") + F.col("s.moved")).alias("position"), F.col("child").alias("node"), F.col("s.edits").alias("edits"), F.col("s.near").alias("near"))
        level = stored(level, "spelling-level")
        found = level.where("near is not null").select("word", "near")
        pairs = found if pairs is None else pairs.unionAll(found)
        states = level.where("near is null").drop("near")
        if states.isEmpty():
            break
    # Both sides may meet a neighbour, and hashes of prefixes may have led astray.
    pairs = stored(pairs.distinct().where(F.levenshtein("word", "near", 1) == 1), "spelling-pairs")
    return pairs.unionAll(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def variants(counts: DataFrame, least_ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of counts (word, n; one row a word).

    Near words differ by one code point inserted, deleted or replaced. A word's form is its near word of largest n
    (ties: the smallest by code points) if that n is at least least_ratio times the word's; root follows forms to the last, and is the word itself where there is none.
    """
    counts = stored(counts.select("word", "n"), "spelling-words")
    sized = neighbours(counts).join(counts.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("w"))).alias("top"))
    own = counts.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "top")
    far = -F.col("top.m") >= F.col("n") * least_ratio
    own = stored(own.select("word", "n", "n_near", F.when(far, F.col("top.w")).alias("form"), F.when(far, -F.col("top.m")).alias("form_n")), "spelling-forms")
    root = stored(own.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # counts grow along a chain, so chains are short; each round halves what is left of them
        on = root.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = stored(root.join(on, F.col("root") == F.col("_word"), "left"), "spelling-roots")
        done = joined.where("_root is not null").isEmpty()
        root = joined.select("word", F.coalesce("_root", "root").alias("root"))
        if done:
            break
    out = own.join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, least_ratio: int = 10, modulus: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the worn runs of letters of all documents; see runs, worn and variants.

    Null and empty texts have no words, a null id is as an empty one, repeated rows count again, other columns are ignored; an
    empty table gives no rows. Words of any length are taken whole.
    """
    words = runs(docs, least_length, id_col, text_col).select(worn(F.col("doc_id"), F.col("run"), modulus).alias("word"))
    return variants(word_counts(words, least_length, least_count), least_ratio)
