"""The building block: a DataFrame with an explicit order key and, if wanted, partition keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OrderedFlow:
    """Rows of df in ascending order of order_by, which should be unique within partition_by. Immutable, so it can be used any number of times; lazy, but for operators that need the position in a large flow without keys, which lay it out in a scratch table when they are called."""

    df: DataFrame
    order_by: tuple[str, ...]
    partition_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.order_by:
            raise ValueError("an ordered flow needs an order key")
        if lost := [c for c in (*self.order_by, *self.partition_by) if c not in self.df.columns]:
            raise ValueError(f"no such column: {', '.join(lost)}")

    def with_df(self, df: DataFrame) -> OrderedFlow:
        return replace(self, df=df)

    def keyed(self, *columns: str) -> OrderedFlow:
        """The same rows, ordered within each value of the columns."""
        return replace(self, partition_by=columns)

    def ordered(self, *columns: str) -> OrderedFlow:
        return replace(self, order_by=columns)

    def then(self, operator: Callable, *args, **options):
        """operator(flow, ...): flow.then(take, 3)."""
        return operator(self, *args, **options)

    def select(self, *columns) -> DataFrame:
        return self.df.select(*columns)

    def __getattr__(self, name: str):
        """Every operator is a method too."""
        import tideflow.operators as ops

        if name.startswith("_") or not callable(found := getattr(ops, name, None)):
            raise AttributeError(name)
        return lambda *args, **options: found(self, *args, **options)


#: Column names that operators use between their steps; a flow can't begin with them.
RESERVED = frozenset(("_flow_range", "_flow_row", "_idx", "_before", "_has", "_near", "_me", "_beyond", "_side", "_t", "_a", "_b", "_stop", "_gate", "_broken", "_size", "_all", "_rn", "_busy", "_closed", "_m", "_seen", "_key", "_new", "_next", "_none", "_turn", "_cell"))


def flow(df: DataFrame, *order_by: str, partition_by: tuple[str, ...] | list[str] = ()) -> OrderedFlow:
    if taken := RESERVED & {c.lower() for c in df.columns}:
        raise ValueError(f"reserved column names: {', '.join(sorted(taken))}")
    return OrderedFlow(df, tuple(order_by), tuple(partition_by))


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
