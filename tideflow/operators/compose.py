"""Stages, named segments with snapshots, and runs in the background."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from tideflow.flow import OrderedFlow
from tideflow.operators.effects import RunSummary, run

Stage = Callable[[OrderedFlow], OrderedFlow]


def then(*stages: Stage) -> Stage:
    def composed(flow: OrderedFlow) -> OrderedFlow:
        for stage in stages:
            flow = stage(flow)
        return flow

    return composed


def through(flow: OrderedFlow, stage: Stage) -> OrderedFlow:
    return stage(flow)


def or_else(primary: Stage, fallback: Stage) -> Stage:
    """The fallback's rows where the primary gives none, or fails in the engine; the failure is logged. Mistakes in the stage's own code are raised."""
    from tideflow.plans.scratch import written

    def either(flow: OrderedFlow) -> OrderedFlow:
        try:
            got = primary(flow)
            kept = got.with_df(written(got.df))
            if not kept.df.isEmpty():
                return kept
        except PySparkException as error:
            logging.getLogger(__name__).warning("primary failed: %s", str(error).splitlines()[0])
        return fallback(flow)

    return either


@dataclass(frozen=True)
class SnapshotStore:
    """A folder with one table for each segment."""

    path: str

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def load(self, spark: SparkSession, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None


def segment(name: str, stage: Stage, store: SnapshotStore | None = None) -> Stage:
    """A named stage: jobs carry its name; with a store its result is written once and replayed afterwards."""

    def named(flow: OrderedFlow) -> OrderedFlow:
        spark = flow.df.sparkSession
        if store is not None and (kept := store.load(spark, name)) is not None:
            return flow.with_df(kept)
        outer = spark.sparkContext.getLocalProperty("spark.job.description")
        spark.sparkContext.setJobDescription(f"{outer} / {name}" if outer else name)
        try:
            got = stage(flow)
            if store is None:
                return got
            store.save(name, got.df)
            return got.with_df(store.load(spark, name))
        finally:
            spark.sparkContext.setJobDescription(outer)

    return named


def from_checkpoint(spark: SparkSession, store: SnapshotStore, name: str) -> DataFrame:
    if (kept := store.load(spark, name)) is None:
        raise FileNotFoundError(f"no snapshot of {name}")
    return kept


class RunHandle:
    """A run in the background: wait() for its summary and error, or look at them without waiting."""

    def __init__(self, action: Callable[[], object], finalizers: list[Callable[[RunSummary], None]] = ()) -> None:
        pool = ThreadPoolExecutor(1)
        self.value: object = None

        def keep() -> None:
            self.value = action()

        self._run = pool.submit(run, keep, (), list(finalizers))
        pool.shutdown(wait=False)

    def done(self) -> bool:
        return self._run.done()

    def wait(self, timeout: float | None = None) -> tuple[RunSummary, str | None]:
        summary = self._run.result(timeout)
        return summary, summary.error

    def err(self) -> str | None:
        """The run's error; None while it goes on."""
        return self._run.result().error if self.done() else None

    def summary(self) -> RunSummary:
        """The run's summary; an empty one while it goes on."""
        return self._run.result() if self.done() else RunSummary("success")


def run_async(action: Callable[[], object], finalizers: list[Callable[[RunSummary], None]] = ()) -> RunHandle:
    return RunHandle(action, finalizers)


def describe(df: DataFrame) -> list[dict[str, object]]:
    """The plan's nodes from the root down: name, depth, and whether each runs in the engine or in Python."""
    found = []

    def walk(node, depth: int) -> None:
        kind = node.getClass().getSimpleName()
        found.append({"node": node.nodeName().split(" (")[0], "depth": depth, "python": "Python" in node.getClass().getName() or kind.startswith(("MapIn", "FlatMapGroupsIn", "FlatMapCoGroupsIn"))})
        inner = node.inputPlan() if kind == "AdaptiveSparkPlanExec" else None
        children = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        for child in children:
            walk(child, depth + 1)

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return found


def is_native(df: DataFrame) -> bool:
    return not any(n["python"] for n in describe(df))
