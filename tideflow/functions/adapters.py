"""Plain functions in the shapes that operators and stages take."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame

import tideflow.operators as op
from tideflow.flow import OrderedFlow

Stage = Callable[[OrderedFlow], OrderedFlow]


def lift_pure(fn: Callable[[Any], Any]) -> Callable[[Any], tuple]:
    """A function of a row that gives one value, for map_python."""
    return lambda row: (fn(row),)


def lift_fallible(fn: Callable[[Any], Any]) -> Callable[[Any], tuple]:
    """As lift_pure, with the error's message beside the value instead of an exception: (value, None) or (None, message)."""

    def call(row: Any) -> tuple:
        try:
            return fn(row), None
        except Exception as error:
            return None, str(error) or type(error).__name__

    return call


def filter_func(predicate: Column) -> Stage:
    return lambda flow: op.filter_rows(flow, predicate)


def reject_func(predicate: Column) -> Stage:
    return lambda flow: op.reject(flow, predicate)


def tap_func(watch: Callable[[OrderedFlow], None]) -> Stage:
    """A stage that looks at the flow when it is built, and passes it on."""

    def stage(flow: OrderedFlow) -> OrderedFlow:
        watch(flow)
        return flow

    return stage


def tap_error_func(stage: Stage, watch: Callable[[Exception], None]) -> Stage:
    return lambda flow: op.tap_error(lambda: stage(flow), watch)


def finally_func(stage: Stage, done: Callable[[], None]) -> Stage:
    return lambda flow: op.finally_do(lambda: stage(flow), done)


def expand_map_func(edges: DataFrame, **options: Any) -> Callable[[DataFrame], DataFrame]:
    return lambda roots: op.expand_map(roots, edges, **options)


def each(fn: Callable[[Any], Iterator[tuple]]) -> Callable[[Any, Any], Iterator[tuple]]:
    """A function of a row, in the shape of those that keep state (which it leaves alone)."""
    return lambda ref, row: fn(row)
