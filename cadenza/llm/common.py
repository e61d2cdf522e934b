"""What the training-data operators share: the shared folder, stored tables, components, links in groups."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only where that setting is absent (tests on one machine) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext.getCheckpointDir()
        if not jvm_dir:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-cadenza-"))
            jvm_dir = spark.sparkContext.getCheckpointDir()
        root = jvm_dir
    return root.rstrip("/")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Rows go to Python tasks in batches of at most about so many bytes from now on, if the session hasn't set its own limit.

    Spark's default is 64 MB; a task has its batch in Spark's memory and in Python's, and so what it makes of it. Results are
    lazy, so the setting stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared one that no other run uses."""
    return f"{shared_dir(spark)}/cadenza-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage.

    Later stages then read it instead of computing it again, also after an executor is lost.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str | None:
    """The local form of a path that is in a mounted file system, else None."""
    if path.startswith("file:"):
        path = path[5:]
        return "/" + path.lstrip("/")
    return path if path.startswith("/") else None


def store_file(path: str, data: bytes) -> None:
    """Write a file of the shared folder from a task: whole or not at all, so that retries are safe."""
    at = local_path(path)
    if at:
        part = f"{at}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, at)
        return
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, inner)


def file_exists(path: str) -> bool:
    at = local_path(path)
    if at:
        return os.path.exists(at)
    from pyarrow.fs import FileSystem, FileType

    fs, inner = FileSystem.from_uri(path)
    return fs.get_file_info(inner).type == FileType.File


def map_file(path: str) -> np.ndarray:
    """The bytes of a shared file, memory-mapped.

    A file of a mounted file system is mapped where it lies. From another store it is first copied
    to a nameless temporary file, which goes when the worker ends.
    """
    at = local_path(path)
    if at:
        return np.memmap(at, dtype=np.uint8, mode="r") if os.path.getsize(at) else np.zeros(0, np.uint8)
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(inner) as f:
        while block := f.read(1 << 22):
            copy.write(block)
        copy.flush()
        size = copy.tell()
        return np.memmap(copy, dtype=np.uint8, mode="r") if size else np.zeros(0, np.uint8)


class KeySet:
    """A set of 128-bit keys as sorted arrays in the shared folder, mapped by the tasks that ask.

    file_of(key) tells the file of a key in a plan; each file is bounded.
    """

    def __init__(self, folder: str, files: int):
        self.folder, self.files, self._maps = folder, files, {}

    @classmethod
    def of(cls, keys: DataFrame, name: str, rows: int, file_rows: int = 4_000_000) -> KeySet:
        """The set of the column key of keys (16 bytes each, without repeats); rows: how many there are."""
        out = cls(new_folder(keys.sparkSession, name), max(1, -(-rows // file_rows)))
        folder = out.folder

        def work(table: pa.Table) -> pa.Table:
            raw = np.frombuffer(b"".join(table.column("key").to_pylist()), "<u8").reshape(-1, 2)
            raw = raw[np.lexsort((raw[:, 1], raw[:, 0]))]
            k = table.column("file")[0].as_py()
            store_file(f"{folder}/{k}", raw[:, 0].tobytes() + raw[:, 1].tobytes())
            return pa.table({"file": pa.array([k], pa.int32())})

        keys.select("key", out.file_of(F.col("key")).alias("file")).groupBy("file").applyInArrow(work, "file int").agg(F.count("*")).collect()
        return out

    def file_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.files)).cast("int")

    def having(self, key: Column) -> Column:
        """Whether the set has a key, asked where the rows are: they move nowhere."""

        @F.arrow_udf("boolean")
        def has(keys: pa.Array, files: pa.Array) -> pa.Array:
            return pa.array(self.has(keys, files.to_numpy()))

        return has(key, self.file_of(key))

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def has(self, keys: pa.Array, files: np.ndarray, most_open: int = 256) -> np.ndarray:
        """Which of some keys the set has."""
        raw = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)
        out = np.zeros(len(raw), bool)
        for k in np.unique(files).tolist():
            at = np.flatnonzero(files == k)
            if k not in self._maps:
                if len(self._maps) >= most_open:
                    self._maps.pop(next(iter(self._maps)))
                self._maps[k] = map_file(f"{self.folder}/{k}").view("<u8") if file_exists(f"{self.folder}/{k}") else np.zeros(0, "<u8")
            n = len(self._maps[k]) // 2
            high, low = self._maps[k][:n], self._maps[k][n:]
            place = np.searchsorted(high, raw[at, 0])
            while True:  # keys of equal first half lie together
                inside = np.minimum(place, max(n - 1, 0))
                same = (place < n) & (high[inside] == raw[at, 0]) if n else np.zeros(len(at), bool)
                hit = same & (low[inside] == raw[at, 1]) if n else same
                out[at] |= hit
                same &= ~hit
                if not same.any():
                    break
                place = place + same
                at, place = at[same], place[same]
        return out


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def forests(links: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Links (a, b) of the same components, at most one per node and task: each task joins what it reads, so many links at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def thinned() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            nodes, at = np.unique(np.r_[a, b], return_inverse=True)
            root = roots(at[: len(a)], at[len(a) :], len(nodes))
            leaf = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], ["a", "b"])

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= most:
                held = [thinned()]
                count = len(held[0])
                if count > most // 2:
                    yield held.pop()
                    count = 0
        if count:
            yield thinned()

    return links.select("a", "b").mapInArrow(work, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component_id) for every node of links (a, b): component_id is the smallest node reachable.

    Tasks first thin the links that they read to forests. Then alternating large-star and small-star steps, each an
    aggregation and a join, until a round changes nothing. Each round's links are stored, so that the plan stays short; so are
    the least neighbours, whose joins can then split a hub's links among tasks. No links: no rows. Links with a null end are left out.
    """
    now = stored(forests(links.where("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        if now.isEmpty():
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "links-low")
        large = stored(both.join(low, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links-large")
        low = stored(large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m")), "links-low")
        joined = large.join(low, F.col("a") == F.col("_a"))
        small = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionAll(low.select(F.col("_a").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = stored(small, "links")
        # Stars only: no node is both a centre and a leaf, and every leaf has one centre.
        n, leaves = now.agg(F.count("*"), F.countDistinct("a")).first()
        if n == leaves and now.select(F.col("b").alias("_b")).distinct().join(now, F.col("a") == F.col("_b"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component_id")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct())


def with_anchors(rows: DataFrame, anchors: int = 8) -> DataFrame:
    """rows (g: group, id: unique in the group, further columns) with m (the group's size) and anchor (whether the row is an anchor of its group).

    All rows of a small group are anchors, of a larger one up to so many drawn by a hash.
    """
    drawn = rows.groupBy(F.col("g").alias("_g"), F.pmod(F.xxhash64("id"), F.lit(anchors))).agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("id", F.lit(1)), F.col("id").alias("i")))["i"].alias("i"))
    sizes = stored(drawn.groupBy("_g").agg(F.sum("c").alias("m"), F.collect_list("i").alias("drawn")), "group-sizes")
    return rows.join(sizes, F.col("g") == F.col("_g")).select(*rows.columns, "m", ((F.col("m") <= anchors) | F.array_contains("drawn", F.col("id"))).alias("anchor"))


def grouped_links(rows: DataFrame, near: Column, compare: Callable, block_weight: int, anchors: int = 8) -> DataFrame:
    """Links (a, b) between keys that join, in each group, what all its pairs of near rows would join.

    rows, a stored table, has g (group), id (unique in the group), k (key: what is linked), w (weight), m and anchor (see with_anchors) and
    further columns, by which near compares them with those of another row, named alike with a leading underscore.

    Every row is compared with the anchors of its group. In a group of many rows that are alike nearly all are then linked; those not in
    the group's largest class are compared with all its rows, block by block (about block_weight each), each two blocks in a cell of its own.
    compare takes batches of (cell, side, k, further columns) sorted by cell and gives links (a, b) between the two sides.
    """
    further = [c for c in rows.columns if c not in ("g", "id", "k", "w", "m", "anchor")]
    own = ["g", "id", "k", "w", *further]
    if rows.isEmpty():
        return rows.select(F.col("k").alias("a"), F.col("k").alias("b")).limit(0)
    chosen = rows.where("anchor").select(*(F.col(c).alias(f"_{c}") for c in own))
    meet = (F.col("g") == F.col("_g")) & ((F.col("m") > anchors) | (F.col("id") > F.col("_id"))) & (F.col("k") != F.col("_k")) & near
    first = stored(rows.join(chosen, meet).select(F.col("k").alias("a"), F.col("_k").alias("b")), "group-links")
    large = rows.where(F.col("m") > anchors)
    if large.isEmpty():
        return first
    member = stored(components(first), "group-classes")
    large = stored(large.join(member, F.col("k") == F.col("node"), "left").select(*own, F.coalesce("component_id", "k").alias("class")), "group-large")
    classes = large.groupBy("g", "class").agg(F.count("*").alias("n"))
    largest = stored(classes.groupBy(F.col("g").alias("_g")).agg(F.max_by("class", F.struct("n", "class")).alias("main")), "group-largest")
    large = stored(large.join(largest, F.col("g") == F.col("_g")).select(*own, (F.col("class") != F.col("main")).alias("apart")), "group-apart")
    blocks = lambda w: F.greatest(F.ceil(F.sum(w) / block_weight), F.lit(1)).cast("int")
    cut = stored(large.groupBy(F.col("g").alias("_g")).agg(blocks(F.when(F.col("apart"), F.col("w"))).alias("i_blocks"), blocks(F.col("w")).alias("j_blocks"), F.bool_or("apart").alias("any")).where("any"), "group-blocks")
    if cut.isEmpty():
        return first
    rows = large.join(cut, F.col("g") == F.col("_g"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.where("apart").withColumn("_i", block("i_blocks")).withColumn("_j", every("j_blocks")).withColumn("side", F.lit(0))
    two = rows.withColumn("_i", every("i_blocks")).withColumn("_j", block("j_blocks")).withColumn("side", F.lit(1))
    cells = one.unionByName(two).select(F.xxhash64("g", "_i", "_j").alias("cell"), "side", "k", *further)
    more = stored(cells.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(compare, "a long, b long"), "group-links")
    return first.unionAll(more)
