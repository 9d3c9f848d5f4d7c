"""Token counts of flat token files by a separator scan.

A flat token file is a run of unsigned ids without an index, each document closed by an end-of-document id. It comes
as blocks cut at any place (file, block, data). In each block the ends are found in one vectorised comparison. What a
block needs from those before it, how many documents have ended and where the last one did, is a prefix scan over
block summaries, in two levels (blocks in runs of RUN, then the runs of a file), so that no task sees more than RUN
summaries, or one per RUN blocks. Only summaries and positions are shuffled, never tokens.

A block may carry `labels`, a name for each end in it in order (as flatten_documents does, with the documents' ids); then
each document's name comes with its count, so that counts can be joined to documents whatever the blocks were.

Defined results: tokens after the last end are one unterminated document (terminated = false); an empty or null block
adds nothing; an empty table gives an empty result; two ends side by side enclose a document of no token. Extra
columns are ignored; an unterminated document has no label. Labels that are not as many as the ends raise an error. Blocks must be numbered once each within a file; a null file is a file by itself.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideflow.llm.byte_tokens import load
from tideflow.llm.common import arrow_schema, map_rows, materialise, session_of, struct

RUN = 1024
BLOCK_BYTES = 1 << 18


def scan_separators(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """blocks: file, block, data (little-endian ids of `width` bytes), labels (if there). One row per document: file, doc_no, start, n_tokens (without the end), terminated, and its label."""
    kind = blocks.schema["file"].dataType.simpleString()
    named = "labels" in blocks.columns
    label = blocks.schema["labels"].dataType.elementType.simpleString() if named else "string"
    if not named:
        blocks = blocks.withColumn("labels", F.lit(None).cast("array<string>"))

    def make():
        def fn(files, numbers, datas, labels):
            size, ends = [], []
            for data, names in zip(datas, labels):
                ids = np.frombuffer(data or b"", f"<u{width}")
                size.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id).tolist())
                if names is not None and len(names) != len(ends[-1]):
                    raise ValueError(f"{len(names)} labels for {len(ends[-1])} ends")
            return [files, numbers, size, ends, labels]

        return fn

    found = materialise(map_rows(blocks, ["file", "block", "data", "labels"], struct(f"file {kind}, block long, size long, ends array<int>, labels array<{label}>"), make))
    run = F.floor(F.col("block") / RUN)
    ended = F.size("ends").cast("long")
    brief = found.select("file", "block", run.alias("run"), "size", ended.alias("ended"), F.when(ended > 0, F.element_at("ends", -1)).cast("long").alias("last"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.coalesce(c, F.lit(0))
    local = brief.withColumn("at", first(F.sum("size").over(inside))).withColumn("docs", first(F.sum("ended").over(inside))).withColumn("open", F.max(F.col("at") + F.col("last") + 1).over(inside))
    runs = brief.groupBy("file", "run").agg(F.sum("size").alias("run_size"), F.sum("ended").alias("run_ended"))
    ends_of_run = local.groupBy("file", "run").agg(F.max(F.col("at") + F.col("last") + 1).alias("run_open"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.join(ends_of_run.withColumnsRenamed({"file": "f", "run": "r"}), F.col("file").eqNullSafe(F.col("f")) & (F.col("run") == F.col("r"))).drop("f", "r")
    runs = runs.withColumn("run_at", first(F.sum("run_size").over(before))).withColumn("run_docs", first(F.sum("run_ended").over(before)))
    runs = runs.withColumn("run_start", F.max(F.col("run_at") + F.col("run_open")).over(before)).select(F.col("file").alias("f"), F.col("run").alias("r"), "run_at", "run_docs", "run_start")
    carried = local.join(runs, F.col("file").eqNullSafe(F.col("f")) & (F.col("run") == F.col("r"))).select(
        F.col("file").alias("f"), F.col("block").alias("b"), (F.col("at") + F.col("run_at")).alias("at"), (F.col("docs") + F.col("run_docs")).alias("docs"),
        F.coalesce(F.col("run_at") + F.col("open"), F.col("run_start"), F.lit(0)).alias("start"),
    )
    placed = found.join(carried, F.col("file").eqNullSafe(F.col("f")) & (F.col("block") == F.col("b")))
    each = placed.select("file", "at", "docs", "start", "ends", "labels", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") == 0, F.col("start")).otherwise(F.col("at") + F.expr("ends[k - 1]") + 1)
    whole = each.select("file", (F.col("docs") + F.col("k")).alias("doc_no"), begin.alias("start"), (F.col("at") + F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("terminated"), F.expr("labels[k]").alias("label"))
    # what is open at a file's end: its size and ends in all, and where its last end was
    tail = placed.groupBy("file").agg(F.max(F.col("at") + F.col("size")).alias("size"), F.max(F.col("docs") + F.size("ends")).alias("docs"), F.max(F.greatest(F.col("start"), F.col("at") + F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1) + 1)).alias("start"))
    rest = tail.where(F.col("size") > F.col("start")).select("file", F.col("docs").cast("long").alias("doc_no"), "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"), F.lit(None).cast(label).alias("label"))
    every = whole.unionByName(rest)
    return every if named else every.drop("label")


def read_flat_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, width: int = 2, whole: bool = False) -> DataFrame:
    """Blocks of the flat token files under a path. Spark lists the files; each task reads its byte ranges, through pyarrow, which opens local, s3, gs and hdfs paths, so that a file may be of any size. whole: for stores that only Spark's readers open; a file is then one row on its way in, and must be well under 2 GB."""
    size = block_bytes // width * width
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    schema = struct("file string, block long, data binary")
    out = arrow_schema(schema)
    session_of(files)
    turn = lambda *row: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out)], schema=out)

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in range(max(1, -(-len(content) // size))):
                    yield turn(name, k, content[k * size : (k + 1) * size])

    if whole:
        return files.select("path", "content").mapInArrow(cut, schema)

    def ranges(batches):
        from pyarrow.fs import FileSystem

        for batch in batches:
            for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = FileSystem.from_uri(re.sub("^(file:)/+", r"\1///", name))
                with store.open_input_file(place) as f:
                    yield turn(name, k, f.read_at(size, k * size))

    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / size)).cast("int"))
    listed = files.select("path", F.explode(blocks).alias("block")).select("path", F.col("block").cast("long").alias("block"))
    return listed.repartition(F.col("path"), F.floor(F.col("block") / 64)).mapInArrow(ranges, schema)


def flatten_documents(docs: DataFrame, path: str, end_id: int, block_bytes: int = BLOCK_BYTES, width: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Flat files as blocks (file, block, data, labels): each task encodes its documents into one run of ids of `width` bytes, every document closed by end_id, cut into blocks without regard to documents. labels: for each end in the block the document that it closes, and which end of the document's it is (from 0; a text that holds end_id itself has several). An id that needs more bytes raises an error."""
    kind = docs.schema[key].dataType.simpleString()
    schema = struct(f"file int, block long, data binary, labels array<struct<doc:{kind},part:int>>")
    out = arrow_schema(schema)
    session_of(docs)
    size = max(1, block_bytes // width)

    def run(batches):
        encode, part = load(path), TaskContext.get().partitionId()
        rest, closed, number, done = bytearray(), deque(), 0, 0  # done: tokens that went out in blocks

        def blocks(least):
            nonlocal number, done
            rows = []
            while len(rest) >= least:
                data = bytes(rest[: size * width])
                del rest[: size * width]
                done += len(data) // width
                names = []
                while closed and closed[0][0] < done:
                    names.append(closed.popleft()[1])
                rows.append((part, number, data, names))
                number += 1
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(encode(t), "<u4"), np.uint32(end_id))
                if int(ids.max()) >> (8 * width):
                    raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
                before = done + len(rest) // width
                closed.extend((before + k, {"doc": name, "part": n}) for n, k in enumerate(np.flatnonzero(ids == end_id).tolist()))
                rest += ids.astype(f"<u{width}").tobytes()
            yield blocks(size * width)
        yield blocks(1)

    return materialise(docs.select(key, text).mapInArrow(run, schema))


def count_tokens(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and end in it: key, part (from 0; more than one only where the text itself holds end_id), n_tokens, whatever the partitioning."""
    found = scan_separators(flatten_documents(docs, path, end_id, key=key, text=text), end_id)
    return found.select(F.col("label.doc").alias(key), F.col("label.part").alias("part"), "n_tokens")
