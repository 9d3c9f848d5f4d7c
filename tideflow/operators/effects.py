"""Functions that may fail, side effects with outcomes, and what a run came to."""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideflow.flow import OrderedFlow
from tideflow.functions.errors import OnError, RetryStrategy, Supervision, error_strategy, exponential_backoff, fixed_backoff, within_seconds
from tideflow.operators.select import _ddl
from tideflow.plans.scratch import written


def map_python(flow: OrderedFlow, fn: Callable[[Any], tuple], schema: str, on_error: OnError | None = None, timeout: float | None = None, supervise: Supervision | None = None) -> DataFrame:
    """An opaque function of a row, over Arrow batches, under an error policy (the run's, if none is named), with a deadline in seconds for each try, and with restarts. Prefer column expressions."""
    out, policy = T.StructType.fromDDL(schema), error_strategy(on_error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = lambda row: policy.run(fn, row, timeout)
        if supervise is not None:
            inner, watched = call, supervise.supervised(lambda row: inner(row))
            call = lambda row: (lambda got: got[1] if got[0] else (False, None))(watched(row))
        for pdf in batches:
            got = [call(row) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame([r for ok, r in got if ok], columns=out.names)

    return flow.df.mapInPandas(run, out)


def map_cached(flow: OrderedFlow, keys: list[str], compute: Callable[[DataFrame], DataFrame], cache: CacheTable | None = None) -> OrderedFlow:
    """Memoised map: the distinct keys, nulls among them, are computed once and joined back; rows whose key gives nothing get nulls. With a cache, keys that it holds are not computed, and what is computed is put there."""
    distinct = flow.df.select(*keys).distinct()
    if cache is None:
        values = compute(distinct)
    else:
        held = cache.load(flow.df.sparkSession)
        values = written(compute(_null_safe(distinct, held.select(*keys), keys, "left_anti") if held is not None else distinct))
        cache.put(values)
        if held is not None:
            values = _null_safe(held, distinct, keys, "left_semi").unionByName(values)
    return flow.with_df(_null_safe(flow.df, values, keys, "left"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys that may be null; the right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    joined = left.join(other, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how)
    return joined.drop(*[f"_r_{k}" for k in keys])


@dataclass
class CacheTable:
    """The backend of map_cached: a folder of computed values by key, each alive for `ttl` seconds (for ever, if None) after it was put there; of several values of a key the last counts. clock: seconds since 1970, for tests."""

    path: str
    keys: tuple[str, ...]
    ttl: float | None = None
    clock: Callable[[], float] = clock.time

    def load(self, spark: SparkSession) -> DataFrame | None:
        try:
            kept = spark.read.parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if self.ttl is not None:
            kept = kept.where(F.col("_put_at") > self.clock() - self.ttl)
        rest = [c for c in kept.columns if c not in (*self.keys, "_put_at")]
        return kept.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_put_at").alias("_v")).select(*self.keys, *[F.col(f"_v.{c}").alias(c) for c in rest])

    def put(self, values: DataFrame) -> None:
        values.withColumn("_put_at", F.lit(float(self.clock()))).write.mode("append").parquet(self.path)


_dry_run = False


@contextmanager
def dry_run() -> Iterator[None]:
    """No effect is applied in flows that are built within the block, whatever their policies say."""
    global _dry_run
    before, _dry_run = _dry_run, True
    try:
        yield
    finally:
        _dry_run = before


@dataclass(frozen=True)
class EffectPolicy:
    """required: a failure fails the run's outcome. attempts and backoff: inline retries. key: a column; a row whose key was applied before is not applied again (null or empty: never skipped). dry: nothing is applied. attempt_timeout: seconds that a try may take."""

    required: bool = True
    attempts: int = 1
    backoff: Callable[[int], float] = field(default=fixed_backoff(0))
    key: str | None = None
    dry: bool = False
    attempt_timeout: float | None = None


def best_effort(policy: EffectPolicy = EffectPolicy()) -> EffectPolicy:
    return replace(policy, required=False)


def effect(flow: OrderedFlow, fn: Callable[[Any], Any], policy: EffectPolicy = EffectPolicy(), applied_before: DataFrame | None = None) -> OrderedFlow:
    """One outcome for each row: result, err, applied, deduped. The outcomes are written once, so reading them again applies nothing again; a task that is run again may, so effects should be idempotent or keyed."""
    df = flow.df
    if policy.key:
        first = F.struct(*flow.order_by)
        named = F.col(policy.key).isNotNull() & (F.col(policy.key).cast("string") != "")
        firsts = df.where(named).groupBy(policy.key).agg(F.min(first).alias("_first"))
        df = df.join(firsts, policy.key, "left").withColumn("_dup", named & (F.col("_first") != first)).drop("_first")
        if applied_before is not None:
            known = applied_before.select(F.col(applied_before.columns[0]).alias("_known")).distinct().withColumn("_was", F.lit(True))
            df = df.join(known, F.col(policy.key) == F.col("_known"), "left").withColumn("_dup", F.col("_dup") | F.coalesce("_was", F.lit(False))).drop("_known", "_was")
    else:
        df = df.withColumn("_dup", F.lit(False))
    df = df.withColumnRenamed("_dup", "dup_")
    names = flow.df.columns
    out = T.StructType.fromDDL(f"{_ddl(flow.df)}, result string, err string, applied boolean, deduped boolean")
    dry = policy.dry or _dry_run

    def attempt(row) -> tuple:
        if row.dup_:
            return None, None, False, True
        if dry:
            return None, None, False, False
        for k in range(max(1, policy.attempts)):
            try:
                result = within_seconds(fn, row, policy.attempt_timeout)
                return None if result is None else str(result), None, True, False
            except Exception as error:
                last = error
                if k + 1 < policy.attempts:
                    clock.sleep(policy.backoff(k))
        return None, str(last) or type(last).__name__, False, False

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(*[getattr(r, c) for c in names], *attempt(r)) for r in pdf.itertuples(index=False)], columns=out.names)

    return flow.with_df(written(df.select(*names, "dup_").mapInPandas(run, out)))


def try_effect(flow: OrderedFlow, fn: Callable[[Any], Any], policy: EffectPolicy = EffectPolicy(), applied_before: DataFrame | None = None) -> tuple[OrderedFlow, OrderedFlow]:
    """Outcomes without and with an error; deduped and dry rows count as without."""
    done = effect(flow, fn, policy, applied_before)
    return done.with_df(done.df.where("err is null")), done.with_df(done.df.where("err is not null"))


@dataclass
class RunSummary:
    outcome: str
    error: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0
    finalizer_errors: list[str] = field(default_factory=list)


def outcome_of(error: str | None, required_failures: int, best_effort_failures: int) -> str:
    """failure for a run error or a failed required effect; partial_success for failed best-effort effects; else success."""
    if error is not None or required_failures:
        return "failure"
    return "partial_success" if best_effort_failures else "success"


def run_outcomes(outcomes: DataFrame, group: str, required: str = "required") -> DataFrame:
    """The outcome of each group of effect outcomes, as a column expression over two counts."""
    failed = F.col("err").isNotNull()
    counts = outcomes.groupBy(group).agg(F.count("*").alias("effects"), F.count_if(failed & F.col(required)).alias("required_failures"), F.count_if(failed & ~F.col(required)).alias("best_effort_failures"))
    return counts.withColumn("outcome", F.when(F.col("required_failures") > 0, "failure").when(F.col("best_effort_failures") > 0, "partial_success").otherwise("success"))


def run(action: Callable[[], Any], effects: list[tuple[DataFrame, EffectPolicy]] = (), finalizers: list[Callable[[RunSummary], None]] = ()) -> RunSummary:
    """Run an action and sum it up; finalizers see the summary, in order, and cannot change the outcome."""
    began, error = clock.time(), None
    try:
        action()
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
    failures = [(policy.required, df.where("err is not null").count()) for df, policy in effects] if error is None else []
    required, other = (sum(n for r, n in failures if r is x) for x in (True, False))
    summary = RunSummary(outcome_of(error, required, other), error, {"required_failures": required, "best_effort_failures": other}, clock.time() - began)
    for f in finalizers:
        try:
            f(summary)
        except Exception as e:
            summary.finalizer_errors.append(str(e))
    return summary


def tap(flow: OrderedFlow, name: str, **aggregates) -> tuple[OrderedFlow, Observation]:
    """Watch rows go by: aggregates that are ready once an action has run, without a pass of their own."""
    seen = Observation(name)
    return flow.with_df(flow.df.observe(seen, *[x.alias(n) for n, x in aggregates.items()])), seen


def catch(primary: Callable[[], DataFrame], fallback: Callable[[Exception], DataFrame]) -> DataFrame:
    """The primary's rows, or the fallback's if it fails while it is run. A deviation: a distributed job has no defined rows "before" its error, so the primary is written whole or not at all, and none of its rows come before the fallback's. For rows that fail one by one see `catch_rows`."""
    try:
        return written(primary())
    except Exception as error:
        return fallback(error)


def catch_rows(flow: OrderedFlow, fn: Callable[[Any], tuple], schema: str, fallback: Callable[[str], DataFrame]) -> DataFrame:
    """What fn gives for the rows before the first one, in order, on which it fails, and then the rows of fallback(message); all of fn's rows if it never fails. Every row is tried once."""
    fields = T.StructType.fromDDL(schema)
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    order = [f"_o{k}" for k in range(len(flow.order_by))]
    kept = flow.df.select(*[F.col(c).alias(o) for c, o in zip(flow.order_by, order)], F.struct("*").alias("_all"))
    kinds = ", ".join(f"{o} {kept.schema[o].dataType.simpleString()}" for o in order)
    out, places = T.StructType.fromDDL(f"{kinds}, {named}, _err string"), flow.order_by

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                at = tuple(getattr(row, c) for c in places)
                try:
                    rows.append((*at, *fn(row), None))
                except Exception as error:
                    rows.append((*at, *[None] * len(fields), str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=out.names)

    tried = written(flow.df.mapInPandas(run, out))
    first = tried.where("_err is not null").orderBy(*order).select(F.struct(*order).alias("_at"), "_err").limit(1)
    if (failed := first.first()) is None:
        return tried.select(*fields.names)
    return tried.join(F.broadcast(first.select("_at")), how="cross").where(F.struct(*order) < F.col("_at")).select(*fields.names).unionByName(fallback(failed["_err"]))


def tap_error(action: Callable[[], Any], watch: Callable[[Exception], None]) -> Any:
    try:
        return action()
    except Exception as error:
        watch(error)
        raise


def finally_do(action: Callable[[], Any], done: Callable[[], None]) -> Any:
    try:
        return action()
    finally:
        done()


def retry_run(action: Callable[[], Any], strategy: RetryStrategy) -> Any:
    """Run again on errors that may pass; the last error is raised."""
    attempt = 0
    while True:
        try:
            return action()
        except Exception as error:
            attempt += 1
            if (strategy.attempts >= 0 and attempt >= strategy.attempts) or not strategy.retryable(error):
                raise
            strategy.on_retry(attempt, error)
            clock.sleep(strategy.backoff(attempt - 1))


__all__ = ["CacheTable", "EffectPolicy", "RunSummary", "best_effort", "catch", "catch_rows", "dry_run", "effect", "exponential_backoff", "finally_do", "fixed_backoff", "map_cached", "map_python", "outcome_of", "retry_run", "run", "run_outcomes", "tap", "tap_error", "try_effect"]
