"""Helpers for tests of flows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import Any

from pyspark.sql import Row

from tideflow.flow import OrderedFlow


def collect_rows(flow: OrderedFlow, *columns: str) -> list:
    """The rows in order: of one column its values, else tuples."""
    rows = flow.df.orderBy(*flow.order_by).select(*(columns or flow.df.columns)).collect()
    return [r[0] for r in rows] if len(columns) == 1 else [tuple(r) for r in rows]


def expect(flow: OrderedFlow, want: list, *columns: str) -> None:
    got = collect_rows(flow, *columns)
    assert got == want, f"{got} instead of {want}"


def expect_unordered(flow: OrderedFlow, want: list, *columns: str) -> None:
    got = Counter(map(repr, collect_rows(flow, *columns)))
    assert got == Counter(map(repr, want)), f"{sorted(got)} instead of {sorted(map(repr, want))}"


class RecordingHook:
    """Keeps what it is told, as (event, arguments)."""

    def __init__(self) -> None:
        self.events: list[tuple] = []

    def __getattr__(self, name: str):
        if not name.startswith("on_"):
            raise AttributeError(name)
        return lambda *args: self.events.append((name, *args))

    def names(self) -> list[str]:
        return [e[0] for e in self.events]


class TestClock:
    """Seconds that go on only when told to; call it for the time."""

    __test__ = False

    def __init__(self, now: float = 0.0) -> None:
        self.now = now

    def __call__(self) -> float:
        return self.now

    def advance(self, seconds: float) -> None:
        self.now += seconds


def fail_at(fn: Callable[[Any], Any], bad: Callable[[Any], bool], error: BaseException | None = None) -> Callable[[Any], Any]:
    """fn, but rows for which bad is true raise."""

    def call(row):
        if bad(row):
            raise error or ValueError("failed as asked")
        return fn(row)

    return call


def fail_every(fn: Callable[[Any], Any], n: int) -> Callable[[Any], Any]:
    """fn, but every n-th call in a task raises."""
    calls = 0

    def call(row):
        nonlocal calls
        calls += 1
        if calls % n == 0:
            raise ValueError("failed as asked")
        return fn(row)

    return call


def slowly(fn: Callable[[Any], Any], seconds: float) -> Callable[[Any], Any]:
    """fn, after a pause."""
    import time

    def call(row):
        time.sleep(seconds)
        return fn(row)

    return call


def same_rows(a: list[Row], b: list[Row]) -> bool:
    return Counter(map(repr, a)) == Counter(map(repr, b))
