"""Running and buffering aggregates, and values of a whole flow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tideflow.flow import OrderedFlow
from tideflow.operators.select import chance
from tideflow.plans.fold import ordered_fold
from tideflow.plans.ordered import clean, running, running_by


def scan(flow: OrderedFlow, name: str, kind: str, value: Column, seed=None) -> OrderedFlow:
    """Running fold by sum, count, min, max or last; one row out for each row in."""
    df = running(flow, {name: (kind, value)})
    if seed is not None:
        join = {"sum": lambda c: c + F.lit(seed), "count": lambda c: c + F.lit(seed), "min": lambda c: F.least(c, F.lit(seed)), "max": lambda c: F.greatest(c, F.lit(seed)), "last": lambda c: F.coalesce(c, F.lit(seed))}[kind]
        df = df.withColumn(name, join(F.col(name)))
    return flow.with_df(clean(df))


def scan_with(flow: OrderedFlow, start: Callable, step: Callable, schema: str) -> DataFrame:
    """Running fold by any Python function: sequential within each partition key."""
    return ordered_fold(flow, start, step, schema)


def reduce(flow: OrderedFlow, name: str, aggregate: Column, seed) -> DataFrame:
    """One value, the seed for an empty flow (one for each partition key, if there are keys)."""
    grouped = flow.df.groupBy(*flow.partition_by) if flow.partition_by else flow.df
    return grouped.agg(F.coalesce(aggregate, F.lit(seed)).alias(name))


def reduce_ordered(flow: OrderedFlow, name: str, value: Column, seed: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """A fold that depends on the order, inside the engine; it gathers each key's rows, so it is meant for keyed flows."""
    item = F.struct(*flow.order_by, value.alias("_value"))
    return flow.df.groupBy(*flow.partition_by).agg(F.aggregate(F.sort_array(F.collect_list(item)), seed, lambda acc, x: step(acc, x["_value"])).alias(name))


def reduce_while(flow: OrderedFlow, name: str, kind: str, value: Column, go_on: Callable[[Column], Column], seed) -> DataFrame:
    """A running fold that ends with the first state for which go_on is false, that state included."""
    df = running(flow, {name: (kind, value)})
    df = df.withColumn("_stop", (~go_on(F.col(name))).cast("long"))
    stops = running(flow.with_df(df), {"_stopped": ("sum", F.col("_stop"))}, inclusive=False)
    kept = stops.where(F.coalesce(F.col("_stopped"), F.lit(0)) == 0)
    grouped = kept.groupBy(*flow.partition_by) if flow.partition_by else kept
    return grouped.agg(F.coalesce(F.max_by(name, F.struct(*flow.order_by)), F.lit(seed)).alias(name))


def group_by(flow: OrderedFlow, *columns: str, name: str = "items") -> DataFrame:
    """Rows of each key in order, as an array: a key's rows must fit a task, so for large keys use windows or running values."""
    rest = [c for c in flow.df.columns if c not in columns]
    ordered = [*flow.order_by, *[c for c in rest if c not in flow.order_by]]
    return flow.df.groupBy(*columns).agg(F.sort_array(F.collect_list(F.struct(*ordered))).alias(name))


def to_map(flow: OrderedFlow, key: str, value: str, as_map: bool = False) -> DataFrame:
    """The last value of each key; as_map: all in one map, for few keys."""
    last = flow.df.groupBy(key).agg(F.max_by(value, F.struct(*flow.order_by)).alias(value))
    return last.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("map")) if as_map else last


def frequencies(flow: OrderedFlow, key: str | Column, name: str = "n", as_map: bool = False) -> DataFrame:
    counts = flow.df.groupBy(key).agg(F.count("*").alias(name))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct(*counts.columns))).alias("map")) if as_map else counts


def running_count_by(flow: OrderedFlow, *key: str, name: str = "n") -> OrderedFlow:
    """Each row with how many of its key have come so far. A key may hold any share of the rows."""
    return flow.with_df(clean(running_by(flow, key, {name: ("count", F.lit(1))})))


def running_sum_by(flow: OrderedFlow, *key: str, value: Column, name: str = "total") -> OrderedFlow:
    return flow.with_df(clean(running_by(flow, key, {name: ("sum", value)})))


def running_frequencies(flow: OrderedFlow, key: str, values: list, name: str = "counts") -> OrderedFlow:
    """A map of the counts so far after each row, for a known, small set of key values."""
    df = running(flow, {f"_f{i}": ("sum", (F.col(key).eqNullSafe(F.lit(v))).cast("long")) for i, v in enumerate(values)})
    pairs = [x for i, v in enumerate(values) for x in (F.lit(v), F.col(f"_f{i}"))]
    return flow.with_df(clean(df.withColumn(name, F.map_filter(F.create_map(*pairs), lambda k, n: n > 0)).drop(*[f"_f{i}" for i in range(len(values))])))


def take_random(flow: OrderedFlow, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """A uniform sample of n rows (all, if fewer); by a hash of the key it is the same on every run."""
    return flow.df.orderBy(chance(seed, key) if key else F.rand(seed), *flow.order_by).limit(max(0, n))


def total(flow: OrderedFlow, value: Column, name: str = "total") -> DataFrame:
    return flow.df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def count(flow: OrderedFlow, name: str = "n") -> DataFrame:
    return flow.df.agg(F.count("*").alias(name))


def min_max(flow: OrderedFlow, value: Column) -> DataFrame:
    return flow.df.agg(F.min(value).alias("min"), F.max(value).alias("max"))


def min_by(flow: OrderedFlow, key: Column) -> DataFrame:
    """The row with the least key, of ties the first; no row for an empty flow."""
    return flow.df.orderBy(key.asc_nulls_last(), *flow.order_by).limit(1)


def max_by(flow: OrderedFlow, key: Column) -> DataFrame:
    """The row with the greatest key, of ties the first."""
    return flow.df.orderBy(key.desc_nulls_last(), *flow.order_by).limit(1)


def first(flow: OrderedFlow) -> DataFrame:
    return flow.df.orderBy(*flow.order_by).limit(1)


def last(flow: OrderedFlow) -> DataFrame:
    return flow.df.orderBy(*[F.desc(c) for c in flow.order_by]).limit(1)


def single(flow: OrderedFlow, default: Row | None = None) -> Row:
    """The only row; the default for none, if given; else an error."""
    rows = flow.df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    if not rows and default is None:
        raise ValueError("no row")
    return rows[0] if rows else default


def any_of(flow: OrderedFlow, predicate: Column, name: str = "any") -> DataFrame:
    return flow.df.agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias(name))


def all_of(flow: OrderedFlow, predicate: Column, name: str = "all") -> DataFrame:
    return flow.df.agg(F.coalesce(F.bool_and(predicate), F.lit(True)).alias(name))


def contains(flow: OrderedFlow, column: str, value, name: str = "contains") -> DataFrame:
    return any_of(flow, F.col(column).eqNullSafe(F.lit(value)), name)


def find(flow: OrderedFlow, predicate: Column) -> DataFrame:
    return flow.df.where(predicate).orderBy(*flow.order_by).limit(1)


def collect(flow: OrderedFlow) -> list[Row]:
    """All rows in order, on the driver: for results known to be small."""
    return flow.df.orderBy(*flow.order_by).collect()


def iterate(flow: OrderedFlow) -> Iterator[Row]:
    """All rows in order, one partition at a time."""
    return flow.df.orderBy(*flow.order_by).toLocalIterator()
