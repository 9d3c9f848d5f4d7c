"""Positions, neighbours and running values of an ordered flow, without bringing a global order into one task.

A flow with partition keys uses ordinary windows. A flow without any is laid out once by ranges of its order key, when
the operator is called; each range is handled by its own task, and what a range needs from those before it (a count, a
sum, a last value) is a prefix scan over one summary row for each range, joined back by broadcast: as many rows as there
are ranges, whatever the data. A flow that the engine estimates at no more than ONE_RANGE bytes is one range: nothing is
written then, and the window runs where the rows are sorted.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.plans.scratch import written

if TYPE_CHECKING:
    from tideflow.flow import OrderedFlow

PID, ROW = "_flow_range", "_flow_row"
#: Bytes, as the engine estimates them, up to which a flow without keys is one range.
ONE_RANGE = 16 << 20
_ROWS = Window.unboundedPreceding, Window.currentRow
#: name -> (aggregate, how a range's value meets what came before)
COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}


def placed(flow: OrderedFlow) -> DataFrame:
    """The flow's rows with their range and their place in it. Written once, as both passes must see one layout."""
    if flow.partition_by or PID in flow.df.columns:
        return flow.df
    if fits_one_range(flow.df):
        return flow.df.withColumn(PID, F.lit(0))
    spread = flow.df.repartitionByRange(*flow.order_by).sortWithinPartitions(*flow.order_by)
    number = F.monotonically_increasing_id()
    return written(spread.withColumn(ROW, number)).withColumn(PID, F.shiftright(ROW, 33).cast("int")).withColumn(ROW, F.col(ROW).bitwiseAND((1 << 33) - 1))


def fits_one_range(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_RANGE


def _one(flow: OrderedFlow, df: DataFrame) -> bool:
    """Whether each window partition holds all that its rows need: keys, or a single range."""
    return bool(flow.partition_by) or ROW not in df.columns


def keys(flow: OrderedFlow) -> list[str]:
    return list(flow.partition_by) or [PID]


def by_order(flow: OrderedFlow) -> Window:
    return Window.partitionBy(*keys(flow)).orderBy(*flow.order_by)


def clean(df: DataFrame) -> DataFrame:
    return df.drop(PID, ROW)


def running(flow: OrderedFlow, specs: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add running values: {column: (sum | count | min | max | last, expression)} over the rows up to this one, or before it."""
    df = placed(flow)
    frame = by_order(flow).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inputs = {name: f"_in_{name}" for name in specs}
    df = df.withColumns({inputs[n]: x for n, (_, x) in specs.items()})
    local = df.withColumns({n: COMBINE[kind][0](F.col(inputs[n])).over(frame) for n, (kind, _) in specs.items()})
    if _one(flow, df):
        return local.drop(*inputs.values())
    ends = {n: (F.max_by(inputs[n], F.when(F.col(inputs[n]).isNotNull(), F.col(ROW))) if kind == "last" else COMBINE[kind][0](F.col(inputs[n]))) for n, (kind, _) in specs.items()}
    totals = df.groupBy(PID).agg(*[x.alias(f"_t_{n}") for n, x in ends.items()])
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    over = {n: (F.sum if kind == "count" else COMBINE[kind][0])(F.col(f"_t_{n}")).over(before) for n, (kind, _) in specs.items()}
    carried = totals.select(PID, *[x.alias(f"_c_{n}") for n, x in over.items()])
    joined = local.join(F.broadcast(carried), PID, "left")
    return joined.withColumns({n: COMBINE[kind][1](F.col(n), F.col(f"_c_{n}")) for n, (kind, _) in specs.items()}).drop(*inputs.values(), *[f"_c_{n}" for n in specs])


def indexed(flow: OrderedFlow, name: str = "idx") -> DataFrame:
    """Add the 0-based position (within the partition keys, if any)."""
    df = placed(flow)
    if _one(flow, df):
        return df.withColumn(name, (F.row_number().over(by_order(flow)) - 1).cast("long"))
    sizes = df.groupBy(PID).agg(F.count("*").alias("_n"))
    starts = sizes.select(PID, F.coalesce(F.sum("_n").over(Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return df.join(F.broadcast(starts), PID).withColumn(name, F.col("_start") + F.col(ROW)).drop("_start")


def neighbour(flow: OrderedFlow, values: dict[str, Column], after: bool = False, has: str | None = None) -> DataFrame:
    """Add values of the row before (or after) this one; `has` names a column that tells whether there is one."""
    df = placed(flow)
    packed = F.struct(*[x.alias(n) for n, x in values.items()], F.lit(True).alias("_is"))
    df = df.withColumn("_me", packed)
    step = F.lead if after else F.lag
    df = df.withColumn("_near", step("_me").over(by_order(flow)))
    if not _one(flow, df):
        edge = df.groupBy(PID).agg((F.min_by if after else F.max_by)("_me", ROW).alias("_edge"))
        beyond = Window.orderBy(PID).rowsBetween(1, Window.unboundedFollowing) if after else Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
        carried = edge.select(PID, (F.first if after else F.last)("_edge", ignorenulls=True).over(beyond).alias("_beyond"))
        df = df.join(F.broadcast(carried), PID, "left").withColumn("_near", F.coalesce("_near", "_beyond")).drop("_beyond")
    df = df.withColumns({n: F.col(f"_near.{n}") for n in values})
    if has:
        df = df.withColumn(has, F.coalesce(F.col("_near._is"), F.lit(False)))
    return df.drop("_me", "_near")


def running_by(flow: OrderedFlow, by: tuple[str, ...], specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running sums and counts of each key, where a key may hold any share of the rows: the flow is laid out by ranges of (key, order), so a hot key spans many, and a range's first key takes over what it came to in the ranges before, one summary row for each range."""
    if fits_one_range(flow.df):
        frame = Window.partitionBy(*by).orderBy(*flow.order_by).rowsBetween(Window.unboundedPreceding, 0)
        return flow.df.withColumns({n: COMBINE[kind][0](x).over(frame) for n, (kind, x) in specs.items()})
    df = placed(type(flow)(flow.df, (*by, *flow.order_by)))
    inputs = {name: f"_in_{name}" for name in specs}
    key = F.struct(*by)
    df = df.withColumns({inputs[n]: x for n, (_, x) in specs.items()})
    frame = Window.partitionBy(PID, *by).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({n: COMBINE[kind][0](F.col(inputs[n])).over(frame) for n, (kind, _) in specs.items()})
    totals = df.groupBy(PID, *by).agg(F.min(ROW).alias("_at"), *[COMBINE[kind][0](F.col(inputs[n])).alias(f"_t_{n}") for n, (kind, _) in specs.items()])
    ends = totals.groupBy(PID).agg(F.min_by(key, "_at").alias("_head"), F.max_by(key, "_at").alias("_tail"), *[F.max_by(f"_t_{n}", "_at").alias(f"_t_{n}") for n in specs])
    earlier = ends.select(F.col(PID).alias("_before"), "_tail", *[F.col(f"_t_{n}").alias(f"_e_{n}") for n in specs])
    carried = ends.select(PID, "_head").join(earlier, F.col("_head").eqNullSafe(F.col("_tail")) & (F.col("_before") < F.col(PID)))
    carried = carried.groupBy(PID).agg(F.first("_head").alias("_head"), *[F.sum(f"_e_{n}").alias(f"_c_{n}") for n in specs])
    joined = local.join(F.broadcast(carried.withColumnRenamed(PID, "_to")), (F.col(PID) == F.col("_to")) & key.eqNullSafe(F.col("_head")), "left")
    return joined.withColumns({n: COMBINE[kind][1](F.col(n), F.col(f"_c_{n}")) for n, (kind, _) in specs.items()}).drop("_to", "_head", *inputs.values(), *[f"_c_{n}" for n in specs])
