"""Shared plumbing: scratch tables in the cluster's checkpoint folder, Arrow row mapping, bounded caches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch sent to Python. Documents may be long, so batches are kept short.
ARROW_ROWS = 500
#: Values of a column that a sample looks after one by one; their counts are broadcast.
MOST_GROUPS = 10_000


def session_of(df: DataFrame) -> SparkSession:
    """The frame's session, with short Arrow batches so that long texts fit a Python worker."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset and everything runs in one process (tests), under the machine's own temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/tideflow-{uuid.uuid4().hex}"


def materialise(df: DataFrame, zstd: bool = True) -> DataFrame:
    """Write the frame to the shared scratch folder as Parquet and read it back: this cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", "zstd" if zstd else "none").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the tables of materialised frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, columns: list[str], schema: T.StructType, make: Callable[[], Callable[..., list]]) -> DataFrame:
    """Per Arrow batch: fn(*lists of the columns) returns the output columns as lists. make() runs once in each task and returns fn."""
    session_of(df)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            fn = fn or make()
            got = fn(*(batch.column(i).to_pylist() for i in range(len(columns))))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(got, out)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def beside(df: DataFrame, columns: list[str], added: T.StructType, make: Callable[[], Callable[..., list]]) -> DataFrame:
    """All rows of df with all their columns and the added ones, in one pass and without a join: fn(*lists of the columns) gives the added columns as lists. An added name must not stand in df."""
    if taken := [f.name for f in added if f.name in df.columns]:
        raise ValueError(f"columns are there already: {', '.join(taken)}")
    session_of(df)
    schema = T.StructType([*df.schema.fields, *added.fields])
    out, more = arrow_schema(schema), arrow_schema(added)
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            fn = fn or make()
            got = fn(*(batch.column(i).to_pylist() for i in places))
            own = [c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, out)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type) for c, f in zip(got, more))], schema=out)

    return df.mapInArrow(run, schema)


def fold_of(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts; -1 where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts), F.lit(-1))


def bounded_sample(df: DataFrame, key: str, rows: int, by: str | None = None, least: int = 0) -> DataFrame:
    """About `rows` rows of df, chosen by a hash of the key (of the whole row where the key is null): a fixed choice, independent of partitioning. All rows if there are fewer. With `by`, about `least` rows more of each of its values that has them, so that a rare one is not missed; only the MOST_GROUPS most frequent values are looked after so."""
    total = df.count()
    if total <= rows:
        return df
    place = F.pmod(F.xxhash64(F.lit(17), F.col(key), F.when(F.col(key).isNull(), F.xxhash64(*df.columns))), F.lit(1 << 30))
    if by is None:
        return df.where(place < int((1 << 30) * (rows / total)))
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_size")).orderBy(F.desc("_size"), "_by").limit(MOST_GROUPS)
    share = F.lit(rows / total) + F.coalesce(F.lit(float(least)) / F.col("_size"), F.lit(0.0))
    return df.join(F.broadcast(sizes), df[by].eqNullSafe(F.col("_by")), "left").where(place < share * (1 << 30)).select(*df.columns)


class Memo(dict):
    """A dict that computes missing entries and starts afresh when it holds `most` of them, so that its memory is bounded."""

    def __init__(self, compute: Callable, most: int = 200_000) -> None:
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


def struct(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
