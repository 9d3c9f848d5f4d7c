"""What went through a stage: counts from observations that ride along with a job, and progress of streams."""

from __future__ import annotations

import json
import logging
import time
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class StageMetrics:
    processed: int
    errors: int = 0
    seconds: float = 0.0
    latency: LatencyBuckets | None = None

    @property
    def throughput(self) -> float:
        return self.processed / self.seconds if self.seconds else 0.0

    @property
    def error_rate(self) -> float:
        tried = self.processed + self.errors
        return self.errors / tried if tried else 0.0

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"throughput": self.throughput, "error_rate": self.error_rate})


#: Upper bounds of the latency buckets in nanoseconds; one more bucket takes what is longer.
BUCKETS_NS = (100_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000, 500_000_000, 1_000_000_000, 5_000_000_000)


@dataclass
class LatencyBuckets:
    """How many items took how long, in the buckets above; buckets of tasks and stages add up."""

    counts: list[int] = field(default_factory=lambda: [0] * (len(BUCKETS_NS) + 1))
    total_ns: int = 0

    def add(self, ns: int, n: int = 1) -> None:
        self.counts[bisect_right(BUCKETS_NS, ns)] += n
        self.total_ns += ns * n

    def merge(self, other: LatencyBuckets) -> LatencyBuckets:
        return LatencyBuckets([a + b for a, b in zip(self.counts, other.counts)], self.total_ns + other.total_ns)

    def mean_ns(self) -> float:
        return self.total_ns / n if (n := sum(self.counts)) else 0.0

    def percentile_ns(self, share: float) -> float:
        """By a straight line within the bucket that holds it; the last bucket gives its lower bound."""
        n = sum(self.counts)
        if not n:
            return 0.0
        want, below = share * n, 0
        for k, c in enumerate(self.counts):
            if c and below + c >= want:
                low = BUCKETS_NS[k - 1] if k else 0
                return low if k == len(BUCKETS_NS) else low + (BUCKETS_NS[k] - low) * max(0.0, want - below) / c
            below += c
        return float(BUCKETS_NS[-1])


class MetricsHook:
    """Counts and latencies by stage: timed(stage, fn) wraps a Python function that runs in tasks; snapshot() is what came in so far."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._stages = spark, {}

    def timed(self, stage: str, fn: Callable) -> Callable:
        seen = self._stages.setdefault(stage, self.spark.sparkContext.accumulator({}, _Sum()))

        def call(*args):
            began = time.perf_counter_ns()
            try:
                got = fn(*args)
            except Exception:
                seen.add({"errors": 1})
                raise
            ns = time.perf_counter_ns() - began
            seen.add({"processed": 1, "ns": ns, bisect_right(BUCKETS_NS, ns): 1})
            return got

        return call

    def snapshot(self) -> dict[str, StageMetrics]:
        out = {}
        for stage, seen in self._stages.items():
            v = seen.value
            buckets = LatencyBuckets([v.get(k, 0) for k in range(len(BUCKETS_NS) + 1)], v.get("ns", 0))
            out[stage] = StageMetrics(v.get("processed", 0), v.get("errors", 0), v.get("ns", 0) / 1e9, buckets)
        return out

    def reset(self) -> None:
        self._stages.clear()

    def to_json(self) -> str:
        return json.dumps({k: json.loads(m.to_json()) for k, m in self.snapshot().items()})


class _Sum(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802
        for k, n in b.items():
            a[k] = a.get(k, 0) + n
        return a


class LogHook:
    """Says what happens to stages: on_start, on_item_error, on_done; to a logger unless told otherwise."""

    def __init__(self, say: Callable[[str], None] = logging.getLogger("tideflow").info) -> None:
        self.say = say

    def on_start(self, stage: str) -> None:
        self.say(f"{stage}: started")

    def on_error(self, stage: str, error: BaseException) -> None:
        self.say(f"{stage}: {type(error).__name__}: {error}")

    def on_done(self, stage: str, metrics: StageMetrics) -> None:
        self.say(f"{stage}: {metrics.processed} rows in {metrics.seconds:.3f} s")


class MultiHook:
    """Several hooks as one; a hook that lacks a method is passed over."""

    def __init__(self, *hooks) -> None:
        self.hooks = hooks

    def __getattr__(self, name: str):
        if not name.startswith("on_"):
            raise AttributeError(name)

        def tell(*args) -> None:
            for h in self.hooks:
                if (fn := getattr(h, name, None)) is not None:
                    fn(*args)

        return tell


def watched_run(df: DataFrame, stage: str, action: Callable[[DataFrame], object], hook) -> object:
    """Run an action on a frame and tell the hook: when it begins, if it fails, and how many rows went through."""
    frame, result = measured(df, stage)
    hook.on_start(stage)
    began = time.monotonic()
    try:
        got = action(frame)
    except Exception as error:
        hook.on_error(stage, error)
        raise
    hook.on_done(stage, result(time.monotonic() - began))
    return got


def measured(df: DataFrame, stage: str, failed: Column | None = None) -> tuple[DataFrame, Callable[[float], StageMetrics]]:
    """The frame, watched, and a function that gives the stage's metrics once an action has run (for so many seconds)."""
    seen = Observation(stage)
    bad = F.count_if(failed) if failed is not None else F.lit(0).cast("long")
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"), (F.max(F.lit(0)).cast("long") if failed is None else bad).alias("bad"))

    def result(seconds: float = 0.0) -> StageMetrics:
        got = seen.get
        return StageMetrics(got["n"] - (got["bad"] or 0), got["bad"] or 0, seconds)

    return watched, result


def percentiles(df: DataFrame, column: str, *shares: float) -> DataFrame:
    """Approximate percentiles of a latency column, merged from per-task sketches."""
    return df.agg(*[F.percentile_approx(column, s).alias(f"p{round(s * 100)}") for s in shares])


class ProgressLog(StreamingQueryListener):
    """Calls back with each micro-batch's row counts; several of these can be added to a session side by side."""

    def __init__(self, say: Callable[[str], None]) -> None:
        self.say = say

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.say(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.say(f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.say("idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.say(f"ended {event.exception or ''}".strip())
