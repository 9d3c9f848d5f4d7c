"""The one place where Python code runs over ordered rows: folds whose step no window expresses."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import islice
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideflow.plans.ordered import fits_one_range
from tideflow.plans.scratch import scratch_path, written

if TYPE_CHECKING:
    from tideflow.flow import OrderedFlow

#: Rows that one task of a fold without keys sorts, about.
RANGE_ROWS = 1 << 20
RANGE, STATE = "_fold_range", "_fold_state"


def ordered_fold(flow: OrderedFlow, start: Callable[[], Any], step: Callable[[Any, Any], Iterator[tuple]], schema: str, columns: list[str] | None = None) -> DataFrame:
    """Per partition key, in order: step(state, row) yields output tuples; `start` makes the (mutable) state.

    Rows are dealt by key, sorted by the engine, and streamed through Python in Arrow batches: many small keys cost no
    more than their rows, and a large key is never held in memory. A key is one task by nature; without keys the whole
    flow is, or, if it is large, one task after another. Only the named columns reach Python.
    """
    need = list(dict.fromkeys([*flow.partition_by, *flow.order_by, *(columns or flow.df.columns)]))
    keys, fields = list(flow.partition_by), T.StructType.fromDDL(schema)
    out = to_arrow_schema(fields)
    places = [need.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch], held: list) -> Iterator[pa.RecordBatch]:
        shape = namedtuple("Row", need, rename=True)
        for batch in batches:
            rows = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(values[p] for p in places)
                if not held or key != held[0]:
                    held[:] = key, start()
                rows.extend(step(held[1], shape(*values)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return _dealt(flow, flow.df.select(*need), run, fields)


def _dealt(flow: OrderedFlow, df: DataFrame, run: Callable[[Iterator[pa.RecordBatch], list], Iterator[pa.RecordBatch]], fields: T.StructType) -> DataFrame:
    """Run a fold where its rows are: run(batches, held) reads rows in order; `held` is empty, or the key and state so far, and is kept up to date."""
    keys = list(flow.partition_by)
    if not keys and not fits_one_range(df) and (ranges := -(-df.count() // RANGE_ROWS)) > 1:
        return _relayed(df, flow.order_by, ranges, run, fields)
    dealt = (df.repartition(*keys) if keys else df.repartition(1)).sortWithinPartitions(*keys, *flow.order_by)
    return dealt.mapInArrow(lambda batches: run(batches, []), fields)


def _relayed(df: DataFrame, order_by: tuple[str, ...], ranges: int, run: Callable, fields: T.StructType) -> DataFrame:
    """A large flow without keys: laid out once by ranges of its order key, then folded at once, a task for each range after the one before it. A task sorts its own range only, and begins with the state that the last one came to, which goes by way of a scratch table and the driver."""
    spark = df.sparkSession
    fields = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    full = T.StructType([*fields.fields, T.StructField(STATE, T.BinaryType())])
    out = to_arrow_schema(full)
    laid = written(df.repartitionByRange(ranges, *order_by).withColumn(RANGE, F.spark_partition_id()), RANGE)
    path = scratch_path(df, keep=True)

    def leg(before: bytes | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = cloudpickle.loads(before) if before else []
            for done in run(batches, held):
                yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(done.num_rows, pa.binary())], schema=out)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in out if f.name != STATE), pa.array([cloudpickle.dumps(held)], pa.binary())], schema=out)

        return go

    state = None
    for k in sorted(r[0] for r in laid.select(RANGE).distinct().collect()):
        part = laid.where(F.col(RANGE) == k).drop(RANGE).coalesce(1).sortWithinPartitions(*order_by)
        at = f"{path}/{RANGE}={k}"
        part.mapInArrow(leg(state), full).write.parquet(at)
        state = bytes(spark.read.schema(full).parquet(at).where(F.col(STATE).isNotNull()).first()[STATE])
    return spark.read.schema(full).parquet(path).where(F.col(STATE).isNull()).select(*[F.col(f"`{n}`") for n in fields.names])


def arrow_rows(rows: Iterator[tuple], fields: T.StructType, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most `size` rows, so that a long run of them is never held."""
    out, rows = to_arrow_schema(fields), iter(rows)
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(out)], schema=out)


def ordered_beside(flow: OrderedFlow, start: Callable[[], Any], step: Callable[[Any, Any], tuple | None], added: str, columns: list[str]) -> DataFrame:
    """As ordered_fold, for steps that keep a row, with `added` columns, or let it go (None): only the named columns are read in Python, all others pass through as they came, in Arrow batches."""
    keys, names = list(flow.partition_by), flow.df.columns
    need = list(dict.fromkeys([*keys, *flow.order_by, *columns]))
    more = T.StructType.fromDDL(added) if added else T.StructType([])
    fields = T.StructType([*flow.df.schema.fields, *more.fields])
    out, extra = to_arrow_schema(fields), to_arrow_schema(more)
    at, places = [names.index(c) for c in need], [need.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch], held: list) -> Iterator[pa.RecordBatch]:
        shape = namedtuple("Row", need, rename=True)
        for batch in batches:
            got = []
            for values in zip(*(batch.column(i).to_pylist() for i in at)):
                key = tuple(values[p] for p in places)
                if not held or key != held[0]:
                    held[:] = key, start()
                got.append(step(held[1], shape(*values)))
            kept = batch.filter(pa.array([g is not None for g in got], pa.bool_()))
            got = [g for g in got if g is not None]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) if c.type != f.type else c for c, f in zip(kept.columns, out)), *(pa.array([g[i] for g in got], f.type) for i, f in enumerate(extra))], schema=out)

    return _dealt(flow, flow.df, run, fields)
