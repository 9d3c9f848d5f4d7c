"""State kept from row to row, for a whole flow or for each key, with expiry."""

from __future__ import annotations

import pickle
import time as clock
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideflow.flow import OrderedFlow
from tideflow.operators.select import _ddl
from tideflow.plans.fold import ordered_fold
from tideflow.plans.ordered import clean, neighbour, running
from tideflow.plans.scratch import written


@dataclass(frozen=True)
class Key:
    """A named state cell: its initial value, and how long a value lives after it was last written (in the flow's time unit)."""

    name: str
    initial: Any = None
    ttl: int | None = None


class Ref:
    """The cell a stateful function works on."""

    def __init__(self, key: Key) -> None:
        self.key, self.value, self.written, self.now = key, None, None, 0

    def _alive(self) -> bool:
        return self.written is not None and (self.key.ttl is None or self.now - self.written <= self.key.ttl)

    def get(self) -> Any:
        return self.value if self._alive() else self.key.initial

    def set(self, value: Any) -> None:
        self.value, self.written = value, self.now

    def get_or_set(self, make: Callable[[], Any]) -> Any:
        if not self._alive():
            self.set(make())
        return self.value

    def update_and_get(self, fn: Callable[[Any], Any]) -> Any:
        self.set(fn(self.get()))
        return self.value

    update = update_and_get


def flat_map_with(flow: OrderedFlow, key: Key, fn: Callable[[Ref, Any], Iterator[tuple]], schema: str, time: str | None = None, columns: list[str] | None = None, store: StateTable | None = None) -> DataFrame:
    """fn(ref, row) yields any number of output tuples; one cell for each partition key of the flow. Without keys there is one cell, and so one task, by nature. columns: those that fn reads, if not all. store: cells begin with what it holds, and what they come to is saved there."""
    if store is not None:
        return _with_store(flow, key, fn, schema, time, columns, store)

    def step(ref: Ref, row):
        ref.now = getattr(row, time) if time else 0
        yield from fn(ref, row)

    return ordered_fold(flow, lambda: Ref(key), step, schema, [*columns, *([time] if time else [])] if columns else None)


def map_with(flow: OrderedFlow, key: Key, fn: Callable[[Ref, Any], tuple], schema: str, time: str | None = None, columns: list[str] | None = None, store: StateTable | None = None) -> DataFrame:
    return flat_map_with(flow, key, lambda ref, row: iter((fn(ref, row),)), schema, time, columns, store)


def map_with_key(flow: OrderedFlow, by: str, key: Key, fn: Callable[[Ref, Any], tuple], schema: str, time: str | None = None, columns: list[str] | None = None, store: StateTable | None = None) -> DataFrame:
    """A cell for each value of `by`; keys are dealt over the cluster."""
    return map_with(flow.keyed(*flow.partition_by, by), key, fn, schema, time, columns, store)


def flat_map_with_key(flow: OrderedFlow, by: str, key: Key, fn: Callable[[Ref, Any], Iterator[tuple]], schema: str, time: str | None = None, columns: list[str] | None = None, store: StateTable | None = None) -> DataFrame:
    return flat_map_with(flow.keyed(*flow.partition_by, by), key, fn, schema, time, columns, store)


@dataclass(frozen=True)
class StateTable:
    """Where cells live between runs: a folder with a table of values for each run, of which the newest counts. dumps and loads are the codec of a cell, (value, time of the last write), to and from bytes."""

    path: str
    dumps: Callable[[Any], bytes] = pickle.dumps
    loads: Callable[[bytes], Any] = pickle.loads

    def load(self, spark: SparkSession) -> DataFrame | None:
        try:
            every = spark.read.parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return every.where(F.col("_run") == every.agg(F.max("_run")).first()[0]).drop("_run")


def _with_store(flow: OrderedFlow, key: Key, fn: Callable, schema: str, time: str | None, columns: list[str] | None, store: StateTable) -> DataFrame:
    """The stored cell of a key goes before its rows; the last row of a key is its cell. Both come out of one pass, which is written once."""
    spark, keys = flow.df.sparkSession, list(flow.partition_by)
    held, fields = store.load(spark), T.StructType.fromDDL(schema)
    rows = flow.df.select(*dict.fromkeys([*keys, *flow.order_by, *(columns or flow.df.columns), *([time] if time else [])])).withColumns({"_turn": F.lit(1), "_cell": F.lit(None).cast("binary")})
    if held is not None:
        rows = rows.unionByName(held.withColumnRenamed("cell", "_cell").withColumn("_turn", F.lit(0)), allowMissingColumns=True)
    ends = (rows.select(*keys).distinct() if keys else spark.range(1).select()).withColumn("_turn", F.lit(2))
    rows = rows.unionByName(ends, allowMissingColumns=True)
    names = list(dict.fromkeys([*keys, "_turn", *flow.order_by, *rows.columns]))
    turn, cell = names.index("_turn"), names.index("_cell")
    inner = namedtuple("Row", [n for n in names if n not in ("_turn", "_cell")], rename=True)

    def step(ref: Ref, row):
        if row[turn] == 0:
            ref.value, ref.written = store.loads(row[cell])
        elif row[turn] == 2:
            if ref.written is not None:
                yield (*[row[names.index(k)] for k in keys], store.dumps((ref.value, ref.written)), *[None] * len(fields))
        else:
            plain = inner(*[v for k, v in enumerate(row) if k not in (turn, cell)])
            ref.now = getattr(plain, time) if time else 0
            for got in fn(ref, plain):
                yield (*[None] * (len(keys) + 1), *got)

    kinds = "".join(f"_k{i} {flow.df.schema[k].dataType.simpleString()}, " for i, k in enumerate(keys))
    ordered = OrderedFlow(rows, ("_turn", *flow.order_by), flow.partition_by)
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    done = written(ordered_fold(ordered, lambda: Ref(key), step, f"{kinds}cell binary, {named}", names))
    cells = done.where("cell is not null").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "cell")
    cells.withColumn("_run", F.lit(clock.time_ns())).write.mode("append").parquet(store.path)
    return done.where("cell is null").select(*fields.names)


def epochs(flow: OrderedFlow, time: str, ttl: int, name: str = "epoch") -> OrderedFlow:
    """State that is evicted when a key idles longer than ttl, without a fold: rows of one epoch share one life of the state, so any window over (key, epoch) is the state's value."""
    df = neighbour(flow, {"_before": F.col(time)})
    fresh = F.coalesce((F.col(time) - F.col("_before") > ttl).cast("long"), F.lit(0))
    return flow.with_df(clean(running(flow.with_df(df.withColumn("_fresh", fresh)), {name: ("sum", F.col("_fresh"))}).drop("_before", "_fresh")))


def running_with_ttl(flow: OrderedFlow, by: str, time: str, ttl: int, name: str, kind: str, value: Column) -> OrderedFlow:
    """A keyed running sum, count, min or max whose state is evicted after idling longer than ttl."""
    lives = epochs(flow.keyed(by), time, ttl, "_epoch").df
    done = running(OrderedFlow(lives, flow.order_by, (by, "_epoch")), {name: (kind, value)})
    return flow.with_df(clean(done.drop("_epoch")))


def merge_state(flow_state: DataFrame, stored: DataFrame | None, key: str, combine: dict[str, Column]) -> DataFrame:
    """New state of each key from this run's and a stored state table (columns n_* and s_*): what a store keeps across runs. combine gives the expressions."""
    if stored is None:
        return flow_state
    new = flow_state.select(key, *[F.col(c).alias(f"n_{c}") for c in flow_state.columns if c != key])
    old = stored.select(key, *[F.col(c).alias(f"s_{c}") for c in stored.columns if c != key])
    return new.join(old, key, "full").select(key, *[x.alias(n) for n, x in combine.items()])


def schema_of(flow: OrderedFlow, extra: str) -> str:
    return f"{_ddl(flow.df)}, {extra}"
