"""Filters, positions and duplicates."""

from __future__ import annotations

import math
from collections import deque
from functools import reduce as _fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.flow import OrderedFlow
from tideflow.plans.fold import ordered_beside
from tideflow.plans.ordered import by_order, clean, indexed, neighbour


def filter_rows(flow: OrderedFlow, predicate: Column) -> OrderedFlow:
    return flow.with_df(flow.df.where(predicate))


def reject(flow: OrderedFlow, predicate: Column) -> OrderedFlow:
    """Rows for which the predicate is not true; null counts as false."""
    return flow.with_df(flow.df.where(~F.coalesce(predicate, F.lit(False))))


def ignore_elements(flow: OrderedFlow) -> OrderedFlow:
    return flow.with_df(flow.df.where(F.lit(False)))


def take(flow: OrderedFlow, n: int) -> OrderedFlow:
    """The first n, of each partition if there are keys."""
    if flow.partition_by:
        return flow.with_df(flow.df.withColumn("_rn", F.row_number().over(by_order(flow))).where(F.col("_rn") <= n).drop("_rn"))
    return flow.with_df(flow.df.orderBy(*flow.order_by).limit(max(0, n)))


def drop(flow: OrderedFlow, n: int) -> OrderedFlow:
    return flow.with_df(clean(indexed(flow, "_idx").where(F.col("_idx") >= n).drop("_idx")))


skip = drop


def _first_failure(flow: OrderedFlow, predicate: Column) -> DataFrame:
    """The order key of the first row for which the predicate is not true, by one aggregate (for each partition key, if there are keys)."""
    broken = flow.df.where(~F.coalesce(predicate, F.lit(False)))
    return broken.groupBy(*flow.partition_by).agg(F.min(F.struct(*flow.order_by)).alias("_stop"))


def _until_false(flow: OrderedFlow, predicate: Column) -> DataFrame:
    stops = _first_failure(flow, predicate)
    if flow.partition_by:
        stops = stops.withColumnsRenamed({k: f"_k_{k}" for k in flow.partition_by})
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in flow.partition_by]
        return flow.df.join(stops, _fold(lambda a, b: a & b, same), "left").drop(*[f"_k_{k}" for k in flow.partition_by])
    return flow.df.join(F.broadcast(stops), how="cross")


def take_while(flow: OrderedFlow, predicate: Column) -> OrderedFlow:
    """Rows before the first one for which the predicate is not true."""
    return flow.with_df(_until_false(flow, predicate).where(F.col("_stop").isNull() | (F.struct(*flow.order_by) < F.col("_stop"))).drop("_stop"))


def drop_while(flow: OrderedFlow, predicate: Column) -> OrderedFlow:
    """The first row for which the predicate is not true, and all after it."""
    return flow.with_df(_until_false(flow, predicate).where(F.struct(*flow.order_by) >= F.col("_stop")).drop("_stop"))


def drop_last(flow: OrderedFlow, n: int) -> OrderedFlow:
    if n <= 0:
        return flow
    df = indexed(flow, "_idx")
    if flow.partition_by:
        sizes = df.groupBy(*flow.partition_by).agg(F.count("*").alias("_size"))
        df = df.join(sizes, list(flow.partition_by))
    else:
        df = df.join(F.broadcast(df.agg(F.count("*").alias("_size"))), how="cross")
    return flow.with_df(clean(df.where(F.col("_idx") < F.col("_size") - n).drop("_idx", "_size")))


def _first_of(boundary: OrderedFlow, time: str) -> DataFrame:
    return boundary.df.agg(F.min(time).alias("_gate"))


def take_until(flow: OrderedFlow, boundary: OrderedFlow, time: str) -> OrderedFlow:
    """Rows before the boundary's first; none if the boundary is empty (it closes at once)."""
    return flow.with_df(flow.df.join(F.broadcast(_first_of(boundary, time)), how="cross").where(F.col(time) < F.col("_gate")).drop("_gate"))


def drop_until(flow: OrderedFlow, boundary: OrderedFlow, time: str) -> OrderedFlow:
    """Rows from the boundary's first on; all if the boundary is empty."""
    return flow.with_df(flow.df.join(F.broadcast(_first_of(boundary, time)), how="cross").where(F.col("_gate").isNull() | (F.col(time) >= F.col("_gate"))).drop("_gate"))


def take_every(flow: OrderedFlow, n: int) -> OrderedFlow:
    if n <= 0:
        raise ValueError("n must be positive")
    return flow.with_df(clean(indexed(flow, "_idx").where(F.col("_idx") % n == 0).drop("_idx")))


def drop_every(flow: OrderedFlow, n: int) -> OrderedFlow:
    if n <= 0:
        raise ValueError("n must be positive")
    return flow.with_df(clean(indexed(flow, "_idx").where(F.col("_idx") % n != 0).drop("_idx")))


def chance(seed: int, key: str) -> Column:
    """32 hexadecimal digits that every run and every engine draws alike for a key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def random_sample(flow: OrderedFlow, rate: float, seed: int = 0, key: str | None = None) -> OrderedFlow:
    """Each row by itself with probability rate; by a hash of the key the choice is the same on every run."""
    if key is None:
        return flow.with_df(flow.df.sample(rate, seed) if rate < 1 else flow.df)
    return flow.with_df(flow.df.where(F.substring(chance(seed, key), 1, 8) < f"{int(rate * (1 << 32)):08x}") if rate < 1 else flow.df)


def distinct_by(flow: OrderedFlow, *columns: str) -> OrderedFlow:
    """The first row of each key, over the whole flow. A partial aggregate keeps one row of a key in each task, so a hot key is no hot task."""
    order = F.struct(*[F.col(c) for c in flow.order_by])
    firsts = flow.df.groupBy(*columns).agg(F.min_by(F.struct(*flow.df.columns), order).alias("_row"))
    return flow.with_df(firsts.select("_row.*"))


def distinct(flow: OrderedFlow) -> OrderedFlow:
    rest = [c for c in flow.df.columns if c not in flow.order_by]
    return distinct_by(flow, *rest)


def dedupe(flow: OrderedFlow, key: str, window: int = 0, seen: DataFrame | None = None) -> OrderedFlow:
    """window 0: one row for each key; 1: no key twice in a row; n: none of the last n keys that were passed on. seen: keys that count as passed before (a persisted set)."""
    if window < 0:
        raise ValueError("window must not be negative")
    if seen is not None:
        flow = flow.with_df(flow.df.join(seen.select(F.col(seen.columns[0]).alias("_seen")).distinct(), F.col(key).eqNullSafe(F.col("_seen")), "left_anti"))
    if window == 0:
        return distinct_by(flow, key, *flow.partition_by)
    if window == 1:
        df = neighbour(flow, {"_before": F.col(key)}, has="_has")
        return flow.with_df(clean(df.where(~F.col("_has") | ~F.col(key).eqNullSafe(F.col("_before"))).drop("_before", "_has")))
    def step(last: deque, row):
        value = getattr(row, key)
        if value in last:
            return None
        last.append(value)
        return ()

    return flow.with_df(ordered_beside(flow, lambda: deque(maxlen=window), step, "", [key]))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def ttl_dedupe(flow: OrderedFlow, key: str, time: str, ttl: int) -> OrderedFlow:
    """A key passes again when ttl or more has gone by since it last passed. Rows of a key are streamed in order; only key and time are read in Python."""

    def step(last: list, row):
        now = getattr(row, time)
        if last and now - last[0] < ttl:
            return None
        last[:] = [now]
        return ()

    keyed = flow.keyed(*dict.fromkeys([*flow.partition_by, key]))
    return flow.with_df(ordered_beside(keyed, list, step, "", [time]))


class BloomSet:
    """A Bloom filter for about n keys at a false-positive rate p: m = ceil(-n ln p / ln^2 2) bits, k = round(m / n ln 2) hashes."""

    def __init__(self, n: int, p: float) -> None:
        if n <= 0 or not 0 < p < 1:
            raise ValueError("n must be positive and p between 0 and 1")
        self.bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
        self.hashes = max(1, round(self.bits / n * math.log(2)))

    @classmethod
    def sized(cls, keys: DataFrame, key: str, p: float) -> BloomSet:
        """A filter for as many keys as the table holds: they are counted, so that the rate stays p at every size."""
        return cls(max(1, keys.select(key).distinct().count()), p)

    def _slots(self, df: DataFrame, key: str) -> DataFrame:
        a, b = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
        k = F.explode(F.sequence(F.lit(0), F.lit(self.hashes - 1)))
        return df.select("*", k.alias("_k")).withColumn("_slot", F.pmod(F.xxhash64(a, b, "_k"), F.lit(self.bits)))

    def built(self, keys: DataFrame, key: str) -> DataFrame:
        """The set bits, as a table: built by a distributed distinct, bounded by `bits`."""
        return self._slots(keys.select(key), key).select("_slot").distinct()

    def reject_seen(self, flow: OrderedFlow, bits: DataFrame, key: str, exact: DataFrame | None = None) -> OrderedFlow:
        """Rows whose key is surely not in the set. exact: the set's keys (its first column); a key that passes the filter is then looked up there, so that no row goes by a false positive."""
        ids = self._slots(flow.df.select(key).distinct(), key).join(bits.withColumn("_on", F.lit(1)), "_slot", "left")
        maybe = ids.groupBy(key).agg((F.count("_on") == self.hashes).alias("_in")).where("_in").select(F.col(key).alias("_seen"))
        if exact is not None:
            maybe = maybe.join(exact.select(F.col(exact.columns[0]).alias("_set")), F.col("_seen").eqNullSafe(F.col("_set")), "left_semi")
        return flow.with_df(flow.df.join(maybe, F.col(key).eqNullSafe(F.col("_seen")), "left_anti"))


def sort_by(flow: OrderedFlow, *columns: str) -> OrderedFlow:
    """Another order key; the old one breaks ties."""
    return OrderedFlow(flow.df, (*columns, *[c for c in flow.order_by if c not in columns]), flow.partition_by)


def top_k(flow: OrderedFlow, k: int, *by: Column) -> DataFrame:
    """Sort and take, as one bounded heap in each task."""
    return flow.df.orderBy(*by, *flow.order_by).limit(k)
