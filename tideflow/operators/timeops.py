"""Flow control by event time. Times are numeric columns (say, microseconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.flow import OrderedFlow
from tideflow.plans.fold import ordered_beside
from tideflow.plans.ordered import clean, neighbour


def _greedy(flow: OrderedFlow, time: str, busy: Column | int) -> OrderedFlow:
    """Keep a row unless it comes within the busy time of the last one kept. Rows of a key are streamed in order; only the times are read in Python."""
    busy_flow = flow.with_df(flow.df.withColumn("_busy", busy if isinstance(busy, Column) else F.lit(busy)))

    def step(last: list, row):
        now, until = getattr(row, time), row[-1]
        if last and now < last[0]:
            return None
        last[:] = [now + until]
        return ()

    return flow.with_df(ordered_beside(busy_flow, list, step, "", [time, "_busy"]).drop("_busy"))


def throttle(flow: OrderedFlow, time: str, window: int) -> OrderedFlow:
    """Leading edge: a row passes if `window` or more has gone by since the last that passed."""
    return _greedy(flow, time, window)


def exhaust_map(flow: OrderedFlow, time: str, duration: Column | int) -> OrderedFlow:
    """Rows that come while the sub-stream of the last accepted row is active are dropped."""
    return _greedy(flow, time, duration)


def switch_map(flow: OrderedFlow, time: str, delays: Column, name: str = "delay") -> OrderedFlow:
    """Each row starts a sub-stream with items at the given delays (an array); a newer row cancels what has not come yet."""
    df = neighbour(flow, {"_next": F.col(time)}, after=True)
    items = df.withColumn(name, F.explode(delays)).where(F.col("_next").isNull() | (F.col(time) + F.col(name) < F.col("_next"))).drop("_next")
    return OrderedFlow(clean(items), (*flow.order_by, name), flow.partition_by)


def debounce(flow: OrderedFlow, time: str, silence: int) -> OrderedFlow:
    """Rows with no newer one within the silence; the last row passes."""
    df = neighbour(flow, {"_next": F.col(time)}, after=True, has="_has")
    return flow.with_df(clean(df.where(~F.col("_has") | (F.col("_next") - F.col(time) >= silence)).drop("_next", "_has")))


def sample(flow: OrderedFlow, time: str, every: int, origin: int = 0, name: str = "tick") -> OrderedFlow:
    """The latest row of each tick that has one; the last, open tick gives none."""
    tick = F.floor((F.col(time) - origin) / every)
    best = flow.df.withColumn(name, tick).groupBy(name, *flow.partition_by).agg(F.max_by(F.struct(*flow.df.columns), F.struct(*flow.order_by)).alias("_row"))
    ends = flow.df.groupBy(*flow.partition_by).agg(F.max(tick).alias("_open"))
    joined = best.join(ends, list(flow.partition_by)) if flow.partition_by else best.join(F.broadcast(ends), how="cross")
    return flow.with_df(joined.where(F.col(name) < F.col("_open")).select(name, "_row.*"))


def rate_limit(flow: OrderedFlow, time: str, rate: float, burst: int = 1, mode: str = "drop", unit: int = 1_000_000) -> OrderedFlow:
    """Token bucket of `rate` rows a unit of time. drop: rows without a token go; wait: all stay, with `emit_at`."""
    if rate <= 0 or burst < 1 or mode not in ("drop", "wait"):
        raise ValueError("rate and burst must be positive, mode drop or wait")
    per = rate / unit

    def step(state, row):
        now = float(getattr(row, time))
        if state["at"] is not None:
            state["tokens"] = min(burst, state["tokens"] + max(0.0, now - state["at"]) * per)
        state["at"] = now if state["at"] is None else max(now, state["at"])
        if mode == "drop" and state["tokens"] < 1:
            return None
        state["tokens"] -= 1
        return () if mode == "drop" else (int(now + (0 if state["tokens"] >= 0 else -state["tokens"] / per)),)

    return flow.with_df(ordered_beside(flow, lambda: {"tokens": float(burst), "at": None}, step, "emit_at bigint" if mode == "wait" else "", [time]))


def circuit_breaker(flow: OrderedFlow, time: str, ok: str, threshold: int = 5, cooldown: int = 10_000_000, probes: int = 1, half_open_timeout: int | None = None, name: str = "state") -> OrderedFlow:
    """What a breaker makes of calls with a known result: `state` is the state met, `allowed` whether the call was made. It opens after so many failures in a row, half-opens after the cooldown, and closes after so many successes there; if those have not come within half_open_timeout, it opens again and the cooldown starts anew."""

    def step(s, row):
        now, good = getattr(row, time), bool(getattr(row, ok))
        if s["state"] == "half-open" and half_open_timeout is not None and now - s["half"] >= half_open_timeout:
            s.update(state="open", since=now, bad=0)
        if s["state"] == "open" and now - s["since"] >= cooldown:
            s.update(state="half-open", good=0, half=now)
        met = s["state"]
        if met != "open":
            if good:
                s["bad"] = 0
                s["good"] += 1
                if met == "half-open" and s["good"] >= probes:
                    s["state"] = "closed"
            else:
                s["bad"] += 1
                if met == "half-open" or s["bad"] >= threshold:
                    s.update(state="open", since=now, bad=0)
        return met, met != "open"

    return flow.with_df(ordered_beside(flow, lambda: {"state": "closed", "bad": 0, "good": 0, "since": 0, "half": 0}, step, f"{name} string, allowed boolean", [time, ok]))


def micros(column: str) -> Column:
    """A timestamp without zone as microseconds since 1970, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def tumbling(df: DataFrame, time: str, every: int, name: str = "window") -> DataFrame:
    return df.withColumn(name, F.floor(F.col(time) / every))
