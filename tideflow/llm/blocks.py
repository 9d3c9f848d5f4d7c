"""Block exchange: global questions about hashed keys, asked by blocks of documents.

Documents are gathered into blocks of a bounded number of bytes, each one row of a scratch table. A block asks about
its distinct keys (sorted 64-bit hashes, with a payload for each): the keys go, packed and compressed, to the part
their leading bits name; the part answers every block that asked, key by key in the order sent; the answers return to
the block's row. A key that stands in a third of all rows is one entry of each block, so no part grows with it, and
parts hold equal shares of the hash range. Memory is bounded by a block, or by a part's share: `parts_for` grows the
number of parts with the input.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import arrow_schema, materialise, session_of, struct

BLOCK_BYTES = 8 << 20
#: Keys a part holds, about; a part is handled whole by one task.
PART_KEYS = 2 << 20
LEAST_PARTS = 256
_U64 = np.uint64


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(values: np.ndarray) -> bytes:
    """Compressed byte planes of an array of fixed-size numbers."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()) if len(values) else b""


def unplanes(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(unsqueeze(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def gaps(sorted_keys: np.ndarray) -> bytes:
    return planes(np.diff(sorted_keys, prepend=_U64(0)))


def ungaps(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, "u8"), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15))
_BASE, _CHUNK = 0xD1342543DE82EF95, 1 << 16
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _CHUNK), _powers(_INVERSE, _CHUNK)


class Words:
    """Words (runs without the six ASCII white-space characters) of a list of texts, as 64-bit hashes: `hash`, the bounds `first` of each text's words, in numpy throughout."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        data = b"\n".join(texts) + b"\n" if texts else b""
        raw = np.frombuffer(data.lower() if lower else data, np.uint8)
        apart = _SEPARATOR[raw]
        inside = ~apart
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))) if len(raw) else np.zeros(0, np.int64)
        begin, end = edge[0::2], edge[1::2]
        # a word's hash is the polynomial of its bytes; prefix sums give it, with powers that repeat every chunk
        sums = np.zeros(len(raw) + 1, np.uint64)
        for a in range(0, len(raw), _CHUNK):  # chunk by chunk, so that only the sums are of the texts' whole length
            part = raw[a : a + _CHUNK]
            upto = sums[a + 1 : a + 1 + len(part)]
            np.cumsum(_BYTE_VALUE[part] * _UP[: len(part)], out=upto, dtype=np.uint64)
            upto += sums[a]
        self.hash = mix((sums[end] - sums[begin]) * _DOWN[begin % _CHUNK] + (end - begin).astype(np.uint64))
        for k in np.flatnonzero(begin // _CHUNK != np.maximum(end - 1, 0) // _CHUNK):  # the few words across a chunk's edge
            w = raw[begin[k] : end[k]]
            powers = _powers(_BASE, len(w))
            self.hash[k] = mix(np.array([(_BYTE_VALUE[w] * powers).sum(dtype=np.uint64)]) + _U64(len(w)))[0]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive entries, by doubling: a run of 2m is made of two of m."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    h = mix(h + _U64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    done, size, out = 0, 1, None
    while True:
        if n & size:
            if out is None:
                out, done = h, size
            else:
                tail = h[done:]
                count = min(len(out), len(tail))
                out, done = mix(out[:count] * _U64(0xD6E8FEB86659FD93) + tail[:count] + _U64(done)), done + size
        size *= 2
        if size > n:
            return out
        h = mix(h[: len(h) - size // 2] * _U64(0xA0761D6478BD642F) + h[size // 2 :] + _U64(size))


def make_blocks(docs: DataFrame, key: str, text: str, extra: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The scratch table: block, lane, n_words (about), data. Null keys go in like others. Documents of equal `extra` (an integer column; null: 0) share a lane, and blocks never mix lanes."""
    session_of(docs)
    schema = struct("block long, lane int, n_words long, data binary")
    out = arrow_schema(schema)
    columns = [F.col(key).alias("k"), F.col(text).cast("binary").alias("t"), (F.coalesce(F.col(extra).cast("int"), F.lit(0)) if extra else F.lit(0)).alias("x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, TaskContext.get().partitionId(), block_bytes, out)

    return materialise(docs.select(*columns).mapInArrow(run, schema), zstd=False)


def _cut(batches, part, block_bytes, out):
    made, lanes = 0, {}

    def close(lane):
        nonlocal made
        ids, texts, _ = lanes.pop(lane)
        row = [[part << 32 | made], [lane], [sum(t.count(b" ") + t.count(b"\n") + 1 for t in texts)], [squeeze(pickle.dumps((ids, texts)))]]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, out)], schema=out)

    for batch in batches:
        for k, t, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ids, texts, size = lanes.get(x) or ([], [], 0)
            ids.append(k)
            texts.append(t or b"")
            lanes[x] = (ids, texts, size + len(texts[-1]) + 64)
            if lanes[x][2] >= block_bytes:
                yield close(x)
    for x in list(lanes):
        yield close(x)


def open_block(data: bytes) -> tuple[list, list[bytes]]:
    """Keys and texts of a block."""
    return pickle.loads(unsqueeze(data))


def parts_for(keys: int) -> int:
    return max(LEAST_PARTS, -(-keys // PART_KEYS))


def bits_for(keys: int, spare: int = 24) -> int:
    """Bits of a hash that tell this many keys apart but for one lookup in 2^spare."""
    return min(64, max(8, int(keys).bit_length()) + spare)


def bounds(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's keys begin: part p has the p-th equal share of the range of 64-bit hashes."""
    edges = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def ask(blocks: DataFrame, question: Callable[[int, bytes], Iterator[tuple[np.ndarray, list[np.ndarray]]]], answer: Callable[[int, list[np.ndarray], list[list[np.ndarray]]], list[np.ndarray]], payload_kinds: list[str], parts: int) -> DataFrame:
    """Answers: block, kind, part, data.

    question(lane, data) yields for each kind 0, 1, ... the block's sorted distinct keys and payload arrays. answer(kind,
    keys by block, payloads by block) returns one array for each block, and may add one more: the part's own summary,
    returned with block -1.
    """
    session_of(blocks)
    sent = struct("kind int, part int, block long, data binary")
    sent_out = arrow_schema(sent)

    def send(batches):
        for batch in batches:
            for block, lane, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = []
                for kind, (keys, payload) in enumerate(question(lane, data)):
                    edge = bounds(keys, parts)
                    for p in np.flatnonzero(np.diff(edge)):
                        a, b = edge[p], edge[p + 1]
                        rows.append((kind, int(p), block, pickle.dumps([gaps(keys[a:b]), *[planes(x[a:b]) for x in payload]])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(sent_out)], schema=sent_out)

    back = struct("block long, kind int, part int, data binary")
    back_out = arrow_schema(back)

    def reply(table: pa.Table) -> pa.Table:
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        got = sorted(zip(table.column("block").to_pylist(), table.column("data").to_pylist()))
        parts_ = [pickle.loads(d) for _, d in got]
        found = answer(kind, [ungaps(d[0]) for d in parts_], [[unplanes(x, k) for x, k in zip(d[1:], payload_kinds)] for d in parts_])
        numbers = [b for b, _ in got] + [-1] * (len(found) - len(got))
        return pa.table([pa.array(numbers, pa.int64()), pa.array([kind] * len(numbers), pa.int32()), pa.array([part] * len(numbers), pa.int32()), pa.array([planes(x) for x in found], pa.binary())], schema=back_out)

    return blocks.select("block", "lane", "data").mapInArrow(send, sent).groupBy("kind", "part").applyInArrow(reply, back)


def tell(blocks: DataFrame, answers: DataFrame, schema: str, use: Callable[[int, int, bytes, list[np.ndarray]], list[tuple]], kinds: list[str]) -> DataFrame:
    """Bring the answers to their blocks. use(block, lane, data, answers for each kind, in the order of the keys asked) returns rows."""
    out_schema = struct(schema)
    out = arrow_schema(out_schema)
    mine = blocks.select("block", "lane", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), "data")
    theirs = answers.where("block >= 0").select("block", F.lit(0).alias("lane"), "kind", "part", "data")

    def meet(table: pa.Table) -> pa.Table:
        got = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "lane", "data", "block"))), key=lambda r: r[:2])
        if got[0][0] != -1:  # answers of a block that is not among these
            return pa.table([pa.array([], f.type) for f in out], schema=out)
        _, _, lane, data, block = got[0]
        replies = [np.concatenate([np.zeros(0, k), *[unplanes(r[3], k) for r in got[1:] if r[0] == i]]) for i, k in enumerate(kinds)]
        rows = use(block, lane, data, replies)
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return mine.unionByName(theirs).groupBy("block").applyInArrow(meet, out_schema)


def totals(blocks: DataFrame) -> int:
    """Words in all blocks, about: what the number of parts and of hash bits follows."""
    return int(blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
