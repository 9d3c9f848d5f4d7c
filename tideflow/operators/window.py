"""Batches, sliding windows, sessions and runs: rows get the number of their window, and a window's rows can be gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.flow import OrderedFlow
from tideflow.plans.fold import ordered_beside
from tideflow.plans.ordered import clean, indexed, neighbour, running


def batch(flow: OrderedFlow, count: int | None = None, measure: Column | None = None, limit: float | None = None, every: int | None = None, time: str | None = None, drop_partial: bool = False, name: str = "batch") -> OrderedFlow:
    """Number the batches. count: so many rows; measure and limit: until the sum reaches the limit; every and time: at ticks of a clock that starts with the flow. Triggers may be combined: whichever comes first closes a batch; the clock is not reset by full batches. drop_partial leaves out the last batch if nothing but the end of the flow closed it."""
    if count is None and measure is None and every is None:
        raise ValueError("a batch needs a trigger")
    if measure is not None or (count is not None and every is not None):
        return _folded_batch(flow, count, measure, limit, every, time, drop_partial, name)
    if every is not None:
        begin = flow.df.groupBy(*flow.partition_by).agg(F.min(time).alias("_t0"))
        joined = flow.df.join(begin, list(flow.partition_by)) if flow.partition_by else flow.df.join(F.broadcast(begin), how="cross")
        return flow.with_df(joined.withColumn(name, F.floor((F.col(time) - F.col("_t0")) / every)).drop("_t0"))
    df = indexed(flow, "_idx").withColumn(name, F.floor(F.col("_idx") / count))
    if drop_partial:
        keys = [*flow.partition_by, name]
        full = df.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") == count).drop("_size")
        df = df.join(full, keys, "left_semi")
    return flow.with_df(clean(df.drop("_idx")))


def _folded_batch(flow, count, measure, limit, every, time, drop_partial, name):
    if measure is not None and limit is None:
        raise ValueError("measure needs a limit")
    if every is not None and time is None:
        raise ValueError("every needs a time column")
    measured = measure is not None
    df = flow.df.withColumn("_m", measure.cast("double") if measured else F.lit(0.0))

    def step(state, row):
        if every is not None:
            now = getattr(row, time)
            if state["tick"] is None:
                state["tick"] = now + every
            if now >= state["tick"]:
                state["tick"] += every * ((now - state["tick"]) // every + 1)
                if state["n"]:
                    state.update(batch=state["batch"] + 1, n=0, sum=0.0)
        batch = state["batch"]
        state["n"] += 1
        state["sum"] += row[-1]
        closed = (count is not None and state["n"] >= count) or (measured and state["sum"] >= limit)
        if closed:
            state.update(batch=batch + 1, n=0, sum=0.0)
        return batch, closed

    folded = ordered_beside(flow.with_df(df), lambda: {"batch": 0, "n": 0, "sum": 0.0, "tick": None}, step, f"{name} bigint, _closed boolean", [*([time] if time else []), "_m"])
    if drop_partial:  # only the end of the flow can cut a batch short; one that a tick flushed is whole
        end = folded.groupBy(*flow.partition_by).agg(F.max(name).alias("_end"), F.max_by("_closed", F.struct(*flow.order_by)).alias("_whole"))
        folded = folded.join(end, list(flow.partition_by)) if flow.partition_by else folded.join(F.broadcast(end), how="cross")
        folded = folded.where((F.col(name) < F.col("_end")) | F.col("_whole")).drop("_end", "_whole")
    return flow.with_df(folded.drop("_m", "_closed"))


def buffer_with(flow: OrderedFlow, selector: OrderedFlow, time: str, name: str = "buffer") -> OrderedFlow:
    """Number the buffers that a selector's rows flush; what comes after its last row is lost, as the selector's end ends the output. A row at a tick's own time goes after it."""
    ticks = selector.df.select(F.col(time).alias("_t"), F.lit(0).alias("_side"))
    items = flow.df.select("*", F.col(time).alias("_t"), F.lit(1).alias("_side"))
    both = OrderedFlow(items.unionByName(ticks, allowMissingColumns=True), ("_t", "_side", *[c for c in flow.order_by if c != time]))
    df = running(both, {name: ("sum", (F.col("_side") == 0).cast("long"))})
    ends = selector.df.agg(F.count("*").alias("_all"))
    return flow.with_df(clean(df.where("_side = 1").join(F.broadcast(ends), how="cross").where(F.col(name) < F.col("_all")).drop("_t", "_side", "_all")))


def sliding_window(flow: OrderedFlow, size: int, step: int, name: str = "window") -> OrderedFlow:
    """Full windows of `size` rows that start at 0, step, 2 step, ...: each row once for every window it lies in. No order is brought into one task: a window is a group."""
    if not 0 < step <= size:
        raise ValueError("0 < step <= size")
    df = indexed(flow, "_idx")
    least = F.greatest(F.lit(0), F.ceil((F.col("_idx") - (size - 1)) / step))
    spread = df.withColumn(name, F.explode(F.sequence(least.cast("long"), F.floor(F.col("_idx") / step)))).withColumn("pos", F.col("_idx") - F.col(name) * step)
    if flow.partition_by:
        sizes = df.groupBy(*flow.partition_by).agg(F.count("*").alias("_all"))
        spread = spread.join(sizes, list(flow.partition_by))
    else:
        spread = spread.join(F.broadcast(df.agg(F.count("*").alias("_all"))), how="cross")
    kept = spread.where(F.col(name) * step + size <= F.col("_all")).drop("_all", "_idx")
    return OrderedFlow(clean(kept), ("pos",), (*flow.partition_by, name))


def _islands(flow: OrderedFlow, new: Callable[[DataFrame], DataFrame], name: str) -> OrderedFlow:
    df = new(flow)
    numbered = running(flow.with_df(df), {name: ("sum", F.col("_new").cast("long"))})
    return flow.with_df(clean(numbered.withColumn(name, F.col(name) - 1).drop("_new")))


def session_window(flow: OrderedFlow, time: str, gap: int, name: str = "session") -> OrderedFlow:
    """A new session begins when nothing has come for the gap or longer."""
    return _islands(flow, lambda f: neighbour(f, {"_before": F.col(time)}, has="_has").withColumn("_new", ~F.col("_has") | (F.col(time) - F.col("_before") >= gap)).drop("_before", "_has"), name)


def chunk_by(flow: OrderedFlow, key: str, name: str = "chunk") -> OrderedFlow:
    """Number the runs of adjacent equal keys."""
    return _islands(flow, lambda f: neighbour(f, {"_before": F.col(key)}, has="_has").withColumn("_new", ~F.col("_has") | ~F.col(key).eqNullSafe(F.col("_before"))).drop("_before", "_has"), name)


def chunk_while(flow: OrderedFlow, column: str, keep: Callable[[Column, Column], Column], name: str = "chunk") -> OrderedFlow:
    """A run goes on while keep(previous, current) is true."""
    return _islands(flow, lambda f: neighbour(f, {"_before": F.col(column)}, has="_has").withColumn("_new", ~F.col("_has") | ~F.coalesce(keep(F.col("_before"), F.col(column)), F.lit(False))).drop("_before", "_has"), name)


def within(flow: OrderedFlow, chunk: str, stage: Callable[[OrderedFlow], OrderedFlow]) -> OrderedFlow:
    """Run a stage on each chunk by itself."""
    inner = stage(OrderedFlow(flow.df, flow.order_by, (*flow.partition_by, chunk)))
    return OrderedFlow(inner.df, inner.order_by, flow.partition_by)


def pairwise(flow: OrderedFlow, *columns: str) -> OrderedFlow:
    """Each row but the first with prev_* of the row before it."""
    df = neighbour(flow, {f"prev_{c}": F.col(c) for c in columns}, has="_has")
    return flow.with_df(clean(df.where("_has").drop("_has")))


def gathered(flow: OrderedFlow, *window: str, name: str = "items") -> DataFrame:
    """The rows of each window as one array."""
    from tideflow.operators.aggregate import group_by

    return group_by(flow, *flow.partition_by, *window, name=name)


def unbatch(df: DataFrame, items: str, order_by: tuple[str, ...]) -> OrderedFlow:
    """Array elements as rows again."""
    rest = [c for c in df.columns if c != items]
    return OrderedFlow(df.select(*rest, F.posexplode(items).alias("pos", items)), (*order_by, "pos"))
