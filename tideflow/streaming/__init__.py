"""The same operators on unbounded input, by Structured Streaming: event time with watermarks."""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideflow.operators.state import Key, Ref


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A directory as a stream; files_per_trigger is the back-pressure."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def ticker(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def never(spark: SparkSession) -> DataFrame:
    """A stream that gives nothing and does not end."""
    return ticker(spark).where("false")


class PushChannel:
    """A push source: send() drops a JSON file in a folder that any store of the engine holds, which the stream picks up; close() refuses what comes later."""

    def __init__(self, path: str, schema: str) -> None:
        self.path, self.schema, self.closed, self.taken = path.rstrip("/"), schema, False, False

    def send(self, *rows: dict) -> None:
        if self.closed:
            raise RuntimeError("the channel is closed")
        spark = SparkSession.active()
        at = spark._jvm.org.apache.hadoop.fs.Path
        store = at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        name = uuid.uuid4().hex
        hidden = at(f"{self.path}/.{name}")  # whole files only: the stream does not see names that begin with a dot
        file = store.create(hidden)
        try:
            file.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode()))
        finally:
            file.close()
        store.rename(hidden, at(f"{self.path}/{name}.json"))

    def try_send(self, *rows: dict) -> bool:
        if not self.closed:
            self.send(*rows)
        return not self.closed

    def close(self) -> None:
        self.closed = True

    def source(self, spark: SparkSession) -> DataFrame:
        if self.taken:
            raise RuntimeError("a channel has one reader")
        self.taken = True
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
        return read_stream(spark, self.path, self.schema, "json")


def distinct_within(stream: DataFrame, time: str, lateness: str, *keys: str) -> DataFrame:
    """One row for each key within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def sessions(stream: DataFrame, time: str, gap: str, lateness: str, *keys: str) -> DataFrame:
    w = F.session_window(time, gap)
    if not keys:  # append mode wants a key beside the window
        stream = stream.withColumn("_all", F.lit(0))
    return stream.withWatermark(time, lateness).groupBy(*(keys or ["_all"]), w.alias("session")).agg(F.count("*").alias("n")).select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def tumbling_counts(stream: DataFrame, time: str, every: str, lateness: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.window(time, every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def flat_map_with_key(stream: DataFrame, by: str, key: Key, fn: Callable[[Ref, Any], Iterator[tuple]], schema: str, order: list[str], time: str | None = None, idle: int | None = None) -> DataFrame:
    """Keyed state on unbounded input: fn(ref, row) yields output tuples; a cell for each value of `by` lives in the query's state store, from micro-batch to micro-batch and across restarts. Rows of a micro-batch come in the order of `order`.

    key.ttl: a value expires so long after it was last written; idle: a cell is evicted when its key has been idle longer. Both are measured by the numeric event time in `time`, so that a replay gives the same. Needs the RocksDB state store (`use_rocksdb`).
    """
    import pandas as pd
    from pyspark.sql import types as T
    from pyspark.sql.streaming import StatefulProcessor

    names = T.StructType.fromDDL(schema).names

    class Cell(StatefulProcessor):
        def init(self, handle) -> None:
            self.cell = handle.getValueState("cell", "value binary, seen long")

        def handleInputRows(self, group, rows, timers):  # noqa: N802
            ref, seen = Ref(key), None
            if self.cell.exists():
                held, seen = self.cell.get()
                ref.value, ref.written = pickle.loads(bytes(held))
            pdf = pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")
            out = []
            for row in pdf.itertuples(index=False):
                ref.now = int(getattr(row, time)) if time else 0
                if idle is not None and seen is not None and ref.now - seen > idle:
                    ref.value = ref.written = None
                out.extend(fn(ref, row))
                seen = ref.now
            self.cell.update((pickle.dumps((ref.value, ref.written)), seen))
            yield pd.DataFrame(out, columns=names)

        def close(self) -> None:
            pass

    return stream.groupBy(by).transformWithStateInPandas(Cell(), T.StructType.fromDDL(schema), "append", "none")


def map_with_key(stream: DataFrame, by: str, key: Key, fn: Callable[[Ref, Any], tuple], schema: str, order: list[str], time: str | None = None, idle: int | None = None) -> DataFrame:
    return flat_map_with_key(stream, by, key, lambda ref, row: iter((fn(ref, row),)), schema, order, time, idle)


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond counts needs the RocksDB state store; this sets it for the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def running_count_by(stream: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with how many of its key have come so far."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    kept = list(dict.fromkeys([key, *columns]))
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n long"
    return map_with_key(stream.select(*kept), key, Key("n", 0), lambda ref, row: (*row, ref.update_and_get(lambda n: n + 1)), schema, columns)


def fan_out(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Several sinks of one pass: each micro-batch is computed once; a sink can use the batch number to write once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", timeout: int = 120) -> None:
    """Handle all that is there and stop: the graceful drain of a stream. Offsets in the checkpoint make a rerun go on where this ended."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError("the stream did not drain in time")
    finally:
        query.stop()


class PauseGate:
    """Pause and resume a stream: pausing stops its query after the micro-batch at hand, resuming starts it anew from its checkpoint, so nothing is lost or done twice."""

    def __init__(self, start: Callable[[], StreamingQuery]) -> None:
        self._start = start
        self.query: StreamingQuery | None = start()

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def resume(self) -> None:
        if self.query is None:
            self.query = self._start()

    @property
    def paused(self) -> bool:
        return self.query is None
