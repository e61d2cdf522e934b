"""Structured Streaming forms of what keeps state from row to row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter


def growing(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 100, names: str = "*") -> DataFrame:
    """The files of a folder that grows as an unbounded table; at most so many new ones a batch, so a backlog doesn't flood it."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).load(path)


def _each_once(stream: DataFrame, part: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str) -> None:
    """What part makes of each batch, as a folder a batch: a batch that is run again replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        part(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _partials(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The parts stored so far, of batches before one."""
    try:
        parts = spark.read.parquet(path)
    except AnalysisException:
        return None
    return parts if before is None else parts.where(F.col("batch") < before)


def _merging(stream: DataFrame, time: str, group: Column, keys: list[str], sums: dict[str, Column], path: str, checkpoint: str, wait: str) -> DataFrame | None:
    """Batches as partial aggregates of window (start, end) and keys: sums, the latest time, and late, the rows that came later than wait behind the latest one of earlier batches."""
    spark = stream.sparkSession

    def part(batch: DataFrame, number: int) -> DataFrame:
        parts = _partials(spark, path, number)
        latest = parts.agg(F.max("latest")).first()[0] if parts is not None else None
        late = F.sum((F.col(time) < F.lit(latest) - F.expr(f"INTERVAL {wait}")).cast("long")) if latest else F.lit(0).cast("long")
        made = batch.groupBy(group.alias("w"), *keys).agg(*(F.sum(v).alias(n) for n, v in sums.items()), F.max(time).alias("latest"), late.alias("late"))
        return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *sums, "latest", "late")

    _each_once(stream, part, path, checkpoint)
    return _partials(spark, path)


def tumbling(stream: DataFrame, time: str, width: str, sums: dict[str, Column], keys: list[str], path: str, checkpoint: str, wait: str = "10 seconds") -> DataFrame:
    """start, end, keys, sums, late and closed of each window of time, whatever order rows come in.

    Each batch is stored as partial sums of its windows; sums of these are the windows'. So no row is dropped and there is no state to outgrow memory: late rows are counted
    where they belong, and late says how many came behind the wait. A window is closed once its end lies the wait behind the latest time of all. The sums of windows whose
    rows came late were smaller when they closed, which the reader can see.
    """
    parts = _merging(stream, time, F.window(time, width), keys, sums, path, checkpoint, wait)
    latest = parts.agg(F.max("latest").alias("_latest"))
    merged = parts.groupBy("start", "end", *keys).agg(*(F.sum(n).alias(n) for n in sums), F.sum("late").alias("late"))
    return merged.join(F.broadcast(latest)).withColumn("closed", F.col("end") <= F.col("_latest") - F.expr(f"INTERVAL {wait}")).drop("_latest")  # one row


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], sums: dict[str, Column], path: str, checkpoint: str, wait: str = "10 seconds") -> DataFrame:
    """start, end, keys, sums, late and closed of each run of a key's rows without a gap; as tumbling.

    A batch's sessions are fragments; those of a key that overlap are one. end is the last row's time and the gap.
    """
    parts = _merging(stream, time, F.session_window(time, gap), keys, sums, path, checkpoint, wait)
    latest = parts.agg(F.max("latest").alias("_latest"))
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("_first", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    numbered = opened.withColumn("_run", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *(F.sum(n).alias(n) for n in sums), F.sum("late").alias("late")).drop("_run")
    return merged.join(F.broadcast(latest)).withColumn("closed", F.col("end") <= F.col("_latest") - F.expr(f"INTERVAL {wait}")).drop("_latest")  # one row


def tee(stream: DataFrame, branches: dict[str, Callable[[DataFrame, int], None]], spool: str, checkpoint: str, preroll: dict[str, int] | None = None) -> DataFrame:
    """Every batch to several branches, each once; branches that fail don't stop the others. Returns the ledger: branch, batch, error.

    A batch is stored once in the spool, in a folder of its number, so a repeated batch replaces itself. Each branch then gets all stored batches that the ledger
    doesn't have as done for it, in order: after a failure it starts again with the batch that failed, on the next batch. A branch gets a batch and its
    number, by which it can make its own writes repeatable; one that fails between its write and the ledger's is given the batch again. preroll: how many batches have to be
    there before a branch starts; it then gets them all.
    """
    spark = stream.sparkSession
    schema = "branch string, batch long, error string"

    def ledger() -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, at long").parquet(f"{spool}/ledger")
        except AnalysisException:
            return spark.createDataFrame([], f"{schema}, at long")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{spool}/rows/batch={number}")
        known = ledger().where("error is null").collect()  # a row a branch and batch
        done = {(r["branch"], r["batch"]) for r in known}
        entries = [(r["branch"], r["batch"], None) for r in known if r["at"] == number]  # of an earlier run of this batch
        for name, sink in branches.items():
            for k in range(number + 1) if number + 1 >= (preroll or {}).get(name, 0) else ():
                if (name, k) in done:
                    continue
                try:
                    sink(spark.read.schema(batch.schema).parquet(f"{spool}/rows/batch={k}"), k)
                    entries.append((name, k, None))
                except Exception as e:  # whatever a branch raises is its own
                    entries.append((name, k, f"{type(e).__name__}: {e}"[:1000]))
                    break
        spark.createDataFrame(entries, schema).coalesce(1).write.mode("overwrite").parquet(f"{spool}/ledger/at={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ledger().select("branch", "batch", "error")


#: The state store that the arbitrary-state operators need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def started(writer: DataStreamWriter) -> StreamingQuery:
    """A query started with the state store of ordered; the session's own setting stays."""
    conf = writer._spark.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        return writer.start()
    finally:
        if before is None:
            conf.unset(STORE[0])
        else:
            conf.set(STORE[0], before)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is now through the stream into a Parquet table, read again."""
    started(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
