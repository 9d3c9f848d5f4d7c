"""Generated flows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideflow.flow import OrderedFlow


def from_rows(spark: SparkSession, rows: list, schema: str, pos: str = "pos") -> OrderedFlow:
    """A list, in its order."""
    fields = T.StructType.fromDDL(schema)
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return OrderedFlow(spark.createDataFrame(data, T.StructType([T.StructField(pos, T.LongType(), False), *fields.fields])), (pos,))


def from_iterable(spark: SparkSession, items: Iterable, schema: str, chunk: int = 10_000, pos: str = "pos") -> OrderedFlow:
    """A driver-side iterator, in chunks; for what only the driver can produce."""
    df, start, it = None, 0, iter(items)
    while part := list(islice(it, chunk)):
        piece = from_rows(spark, part, schema, pos).df.withColumn(pos, F.col(pos) + start)
        df = piece if df is None else df.unionByName(piece)
        start += len(part)
    return OrderedFlow(df if df is not None else from_rows(spark, [], schema, pos).df, (pos,))


def generate(spark: SparkSession, fn: Callable[[], Iterator], schema: str) -> OrderedFlow:
    """What a function yields, in its order, run once on the driver."""
    return from_iterable(spark, fn(), schema)


def generate_in_parts(spark: SparkSession, parts: int, fn: Callable[[int], Iterator[tuple]], schema: str) -> OrderedFlow:
    """fn(part) yields the rows of each part; parts run on the executors. The order is by part, then as yielded."""
    from tideflow.plans.fold import arrow_rows

    fields = T.StructType.fromDDL(f"part int, pos long, {schema}")

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield from arrow_rows(((int(part), k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(fn(part))), fields)

    return OrderedFlow(spark.range(0, parts, 1, parts).mapInArrow(run, fields), ("part", "pos"))


def empty(spark: SparkSession, schema: str) -> OrderedFlow:
    return from_rows(spark, [], schema)


never = empty  # a batch cannot wait for ever; as a stream, see streaming.never


def ticker(spark: SparkSession, start: int, every: int, count: int, name: str = "t") -> OrderedFlow:
    """Ticks of event time: the first one interval after the start."""
    return OrderedFlow(spark.range(count).select((F.lit(start) + (F.col("id") + 1) * every).alias(name)), (name,))


def timer(spark: SparkSession, start: int, delay: int, name: str = "t") -> OrderedFlow:
    return ticker(spark, start, delay, 1, name)


def unfold(spark: SparkSession, seed: str, emit: str, step: str, go_on: str, most: int | None = 100, name: str = "value") -> OrderedFlow:
    """Recursive query over a state `s`: seed, what to emit, the next state and whether to go on, as SQL. A state that does not go on emits nothing. If after `most` values it would still go on, the query fails when it is read: nothing is cut off in silence."""
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max(int(spark.conf.get("spark.sql.cteRecursionLevelLimit")), most + 2)))
    states = f"WITH RECURSIVE u(pos, s) AS (SELECT 0L, {seed} UNION ALL SELECT pos + 1, {step} FROM u WHERE pos < {most} AND ({go_on}))"
    ended = f"IF(pos < {most}, true, raise_error('unfold has not ended after {most} values') IS NULL)"
    return OrderedFlow(spark.sql(f"{states} SELECT pos, {emit} AS {name} FROM u WHERE ({go_on}) AND {ended}"), ("pos",))


def iterate(spark: SparkSession, seed: str, step: str, count: int, name: str = "value") -> OrderedFlow:
    """seed, f(seed), f(f(seed)), ...: so many values. step: SQL over s."""
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max(int(spark.conf.get("spark.sql.cteRecursionLevelLimit")), count + 2)))
    df = spark.sql(f"WITH RECURSIVE u(pos, s) AS (SELECT 0L, {seed} UNION ALL SELECT pos + 1, {step} FROM u WHERE pos < {count - 1}) SELECT pos, s AS {name} FROM u")
    return OrderedFlow(df, ("pos",))


def repeatedly(spark: SparkSession, value: Column, count: int, name: str = "value") -> OrderedFlow:
    return OrderedFlow(spark.range(count).select(F.col("id").alias("pos"), value.alias(name)), ("pos",))


def cycle(spark: SparkSession, items: list, count: int, name: str = "value") -> OrderedFlow:
    """The items over and over: so many rows."""
    if not items:
        raise ValueError("nothing to cycle")
    return OrderedFlow(spark.range(count).select(F.col("id").alias("pos"), F.element_at(F.array(*map(F.lit, items)), (F.col("id") % len(items) + 1).cast("int")).alias(name)), ("pos",))


@contextmanager
def using(acquire: Callable[[], object], build: Callable[[object], DataFrame], release: Callable[[object], None]):
    """A frame that needs a resource: released once, if it was acquired, after the block that runs the action."""
    resource = acquire()
    try:
        yield build(resource)
    finally:
        release(resource)
