"""Sources and sinks the engine has no reader for: a partitioned read function and a per-partition write function.

Message brokers, key-value stores, HTTP pages and the like plug in here with the client library of the day; a client
is made inside each task. SQLite, which Python brings along, and cursor-paged HTTP are worked examples.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterator
from contextlib import closing
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def register_source(spark: SparkSession, name: str, schema: str, partitions: Callable[[dict], list], read: Callable[[dict, object], Iterator[tuple]]) -> None:
    """After this, spark.read.format(name).options(...).load() reads each of partitions(options) by read(options, partition)."""

    class Part(InputPartition):
        def __init__(self, value) -> None:
            self.value = value

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.options = options

        def partitions(self):
            return [Part(p) for p in partitions(self.options)]

        def read(self, partition):
            yield from read(self.options, partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)


def register_log(spark: SparkSession, name: str, schema: str, open_log: Callable[[dict], Any]) -> None:
    """A partitioned log with offsets, as batch and as stream: spark.read or spark.readStream .format(name). open_log(options) gives, in the driver and in each task, an object with partitions() -> list of names, span(partition) -> (first offset, offset after the last) and read(partition, start, end) -> tuples. Each partition's range is read by its own task; a stream's offsets live in its checkpoint."""

    class Part(InputPartition):
        def __init__(self, value) -> None:
            self.value = value

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.options = options

        def partitions(self):
            log = open_log(self.options)
            return [Part((p, *log.span(p))) for p in log.partitions()]

        def read(self, partition):
            yield from open_log(self.options).read(*partition.value)

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.options = options

        def initialOffset(self):  # noqa: N802
            log = open_log(self.options)
            return {str(p): log.span(p)[0] for p in log.partitions()}

        def latestOffset(self):  # noqa: N802
            log = open_log(self.options)
            return {str(p): log.span(p)[1] for p in log.partitions()}

        def partitions(self, start: dict, end: dict):
            names = {str(p): p for p in open_log(self.options).partitions()}
            return [Part((names[p], start.get(p, 0), upto)) for p, upto in end.items() if upto > start.get(p, 0)]

        def read(self, partition):
            yield from open_log(self.options).read(*partition.value)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

        def streamReader(self, schema):  # noqa: N802
            return Stream(dict(self.options))

    spark.dataSource.register(Source)


def write_with(df: DataFrame, open_sink: Callable[[], object], send: Callable[[object, list], None], close: Callable[[object], None] = lambda sink: None, batch: int = 500) -> int:
    """Send rows in batches, one sink for each task; returns how many. At least once: a task that fails is run again."""

    def run(batches):
        sink, n = open_sink(), 0
        try:
            rows = []
            for part in batches:
                for row in part.to_pylist():
                    rows.append(row)
                    n += 1
                    if len(rows) >= batch:
                        send(sink, rows)
                        rows = []
            if rows:
                send(sink, rows)
        finally:
            close(sink)
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": [n]})

    return int(df.mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0)


def sqlite_query(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """One task reads the rows of a query from a SQLite file that the executors can open."""
    name = f"sqlite_{abs(hash((path, query, schema))):x}"

    def read(options, part):
        with closing(sqlite3.connect(path)) as db:
            yield from db.execute(query)

    register_source(spark, name, schema, lambda options: [0], read)
    return spark.read.format(name).load()


def sqlite_insert(df: DataFrame, path: str, table: str) -> int:
    """Insert in one transaction for each batch; rows go through one task, as the file takes one writer."""
    marks = ", ".join("?" for _ in df.columns)
    columns = list(df.columns)

    def send(db, rows):
        with db:
            db.executemany(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({marks})", [tuple(r[c] for c in columns) for r in rows])

    return write_with(df.coalesce(1), lambda: sqlite3.connect(path), send, lambda db: db.close())


def http_pages(spark: SparkSession, first_url: str, fetch: Callable[[str], str], items: Callable[[dict], list], next_url: Callable[[dict], str], schema: str, name: str = "http_pages") -> DataFrame:
    """Cursor pagination until there is no next page; fetch(url) returns JSON text."""

    def read(options, part):
        url = first_url
        while url:
            page = json.loads(fetch(url))
            yield from (tuple(i) if isinstance(i, (list, tuple)) else (i,) for i in items(page))
            url = next_url(page)

    register_source(spark, name, schema, lambda options: [0], read)
    return spark.read.format(name).load()
