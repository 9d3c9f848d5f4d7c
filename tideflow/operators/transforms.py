"""One row in, one row out; and rows put between, before or after."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideflow.flow import OrderedFlow, column
from tideflow.plans.ordered import clean, indexed, neighbour


def map_columns(flow: OrderedFlow, **exprs: Column) -> OrderedFlow:
    """Map: add or replace columns."""
    return flow.with_df(flow.df.withColumns(exprs))


def map_every(flow: OrderedFlow, n: int, **exprs: Column) -> OrderedFlow:
    """Apply the expressions to the rows at 0, n, 2n, ...; the others keep their values."""
    if n <= 0:
        raise ValueError("n must be positive")
    df = indexed(flow, "_idx")
    return flow.with_df(clean(df.withColumns({c: F.when(F.col("_idx") % n == 0, x).otherwise(F.col(c)) for c, x in exprs.items()}).drop("_idx")))


def map_result(flow: OrderedFlow, name: str, attempt: Column, failed: Column, error: Column | str = "failed") -> tuple[OrderedFlow, OrderedFlow]:
    """Split into rows that succeeded (with the result) and rows that failed (with `err`). attempt: an expression that gives null instead of raising; failed: when it did not succeed."""
    ok = flow.with_df(flow.df.where(~F.coalesce(failed, F.lit(True))).withColumn(name, attempt))
    bad = flow.with_df(flow.df.where(F.coalesce(failed, F.lit(True))).withColumn("err", error if isinstance(error, Column) else F.lit(error)))
    return ok, bad


def map_recover(flow: OrderedFlow, name: str, attempt: Column, recover: Column) -> OrderedFlow:
    """One row out for each row in: the attempt, or the recovery where it gave null."""
    return flow.with_df(flow.df.withColumn(name, F.coalesce(attempt, recover)))


def map_batches(flow: OrderedFlow, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int | None = None) -> DataFrame:
    """An opaque function over batches; each batch may give any number of rows. size: so many rows of a task in each batch (its last may hold fewer); without it, as the engine cuts them."""
    if size is not None and size <= 0:
        raise ValueError("size must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if size is None:
            yield from map(fn, batches)
            return
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= size:
                yield fn(held.iloc[:size].reset_index(drop=True))
                held = held.iloc[size:].reset_index(drop=True)
        if held is not None and len(held):
            yield fn(held)

    return flow.df.mapInPandas(run, schema)


def map_pooled(flow: OrderedFlow, make: Callable[[], Any], fn: Callable[[Any, Any], tuple], schema: str, close: Callable[[Any], None] = lambda item: None) -> DataFrame:
    """fn(resource, row) with a resource (a client, a buffer) that is made once in each task, used for all its rows and closed at its end."""
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resource = make()
        try:
            for pdf in batches:
                yield pd.DataFrame([fn(resource, row) for row in pdf.itertuples(index=False)], columns=fields.names)
        finally:
            close(resource)

    return flow.df.mapInPandas(run, fields)


def timestamp(flow: OrderedFlow, name: str = "observed_at", at: Column | str | None = None) -> OrderedFlow:
    """Tag rows with a time: an event-time column, or now."""
    return flow.with_df(flow.df.withColumn(name, F.current_timestamp() if at is None else column(at)))


def time_interval(flow: OrderedFlow, time: str, name: str = "elapsed") -> OrderedFlow:
    """Time since the row before, 0 for the first. time: a numeric time column."""
    df = neighbour(flow, {"_before": F.col(time)})
    return flow.with_df(clean(df.withColumn(name, F.coalesce(F.col(time) - F.col("_before"), F.lit(0))).drop("_before")))


def with_index(flow: OrderedFlow, name: str = "idx") -> OrderedFlow:
    """0-based position."""
    return flow.with_df(clean(indexed(flow, name)))


def intersperse(flow: OrderedFlow, **separator: Column) -> OrderedFlow:
    """A separator row between rows: a copy of the row after it with the given columns replaced, ordered before it by `sub`."""
    df = indexed(flow, "_idx")
    spread = df.withColumn("sub", F.explode(F.when(F.col("_idx") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    spread = spread.withColumns({c: F.when(F.col("sub") == 0, x).otherwise(F.col(c)) for c, x in separator.items()}).drop("_idx")
    return OrderedFlow(clean(spread), (*flow.order_by, "sub"), flow.partition_by)


def map_intersperse(flow: OrderedFlow, exprs: dict[str, Column], **separator: Column) -> OrderedFlow:
    return intersperse(map_columns(flow, **exprs), **separator)


def concat(*flows: OrderedFlow) -> OrderedFlow:
    """One after the other: `src` comes first in the order key."""
    if not flows:
        raise ValueError("nothing to concatenate")
    df = None
    for k, f in enumerate(flows):
        part = f.df.withColumn("src", F.lit(k))
        df = part if df is None else df.unionByName(part)
    return OrderedFlow(df, ("src", *flows[0].order_by), flows[0].partition_by)


def start_with(flow: OrderedFlow, prefix: OrderedFlow) -> OrderedFlow:
    return concat(prefix, flow)


def end_with(flow: OrderedFlow, suffix: OrderedFlow) -> OrderedFlow:
    return concat(flow, suffix)


def default_if_empty(flow: OrderedFlow, default: DataFrame) -> OrderedFlow:
    """The default rows, only if the flow has none."""
    none = flow.df.limit(1).agg((F.count("*") == 0).alias("_none"))
    return flow.with_df(flow.df.unionByName(default.join(F.broadcast(none.where("_none")), how="cross").drop("_none")))


def materialize(flow: OrderedFlow, error: str | None = None) -> OrderedFlow:
    """Rows as notifications: kind `next`, and a last row `complete`, or `error` with its message."""
    rows = flow.df.select("*", F.lit("next").alias("kind"), F.lit(None).cast("string").alias("err"), F.lit(0).alias("terminal"))
    one = flow.df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in flow.df.schema], F.lit("error" if error else "complete").alias("kind"), F.lit(error).cast("string").alias("err"), F.lit(1).alias("terminal"))
    return OrderedFlow(rows.unionByName(one), ("terminal", *flow.order_by), flow.partition_by)


def dematerialize(flow: OrderedFlow) -> OrderedFlow:
    """Rows before the first terminal notification; an error notification there fails the job when it is read."""
    from tideflow.plans.ordered import running

    df = running(flow, {"_ended": ("sum", (F.col("kind") != "next").cast("long"))})
    first_error = (F.col("kind") == "error") & (F.col("_ended") == 1)
    kept = df.where((F.col("_ended") == 0) | first_error).where(F.when(first_error, F.raise_error(F.coalesce("err", F.lit("error"))).isNotNull()).otherwise(F.lit(True)))
    return flow.with_df(clean(kept.drop("_ended", "err", "kind")))
