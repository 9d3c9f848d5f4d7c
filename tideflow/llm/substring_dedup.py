"""Substring dedup by difference-cover anchors.

A window is WINDOW consecutive words of one document. A window that also starts earlier (a smaller doc_id, or earlier
in the same document) is a repeat, and every word that a repeat covers is removed.

Anchors: only the windows of ANCHOR words that start at cover positions (a word's place modulo PERIOD lies in COVER)
are hashed. COVER is a difference cover: for any two places there is a shift below PERIOD that puts both on cover
positions. As PERIOD - 1 + ANCHOR = WINDOW, two equal windows always share an anchor at the same offset. So a global
count of anchors (0.31 a word) leaves as candidates just the windows that hold a shared anchor; those are extended to
WINDOW words, and a second exchange finds which of them stands first.

Windows are compared by a 96-bit hash of their words, of which the leading bits follow the size of the input.

Defined results: null and empty texts have no word and lose none; texts shorter than a window lose nothing; repeated
rows with one doc_id, and those without, are ordered by the block that holds them. A null doc_id comes before all others;
an id that is no integer is refused. Extra columns
are ignored; texts are treated whole.
"""

from __future__ import annotations

import hashlib
import pickle
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideflow.llm.blocks import Words, ask, bits_for, make_blocks, open_block, parts_for, squeeze, tell, totals, unsqueeze, windows
from tideflow.llm.common import discard, map_rows, materialise, struct

WINDOW, ANCHOR, PERIOD = 20, 8, 13
#: A perfect difference set modulo 13; every residue is a difference of two of these.
COVER = (0, 1, 3, 9)
_U64 = np.uint64


def _places(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word its place in its document, and how many words follow it there, itself included."""
    sizes = np.diff(w.first)
    at = np.arange(len(w.hash)) - np.repeat(w.first[:-1], sizes)
    return at, np.repeat(sizes, sizes) - at


def _anchors(texts: list[bytes], bits: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, the index of each anchor's first word, and the anchors' hashes."""
    w = Words(texts)
    at, left = _places(w)
    where = np.flatnonzero(np.isin(at % PERIOD, COVER) & (left >= ANCHOR))
    return w, where, windows(w.hash, ANCHOR)[where] & ~_U64((1 << (64 - bits)) - 1)


def _window_keys(w: Words, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    first = windows(w.hash, WINDOW)[starts] & ~_U64((1 << (64 - bits)) - 1)
    return first, (windows(w.hash, WINDOW, seed=1)[starts] >> _U64(32)).astype("<u4")


def _order(ids: list, w: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and place of each window start. A null id is the least."""
    keys = np.array([-(2**63) if i is None else i for i in ids], np.int64)
    doc = np.searchsorted(w.first, starts, side="right") - 1
    return keys[doc], starts - w.first[doc]


def _candidates(w: Words, where: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Starts of windows that hold a shared anchor at an offset below PERIOD."""
    at, left = _places(w)
    edge = np.zeros(len(w.hash) + 1, np.int64)
    q = where[shared]
    np.add.at(edge, np.maximum(q - (PERIOD - 1), q - at[q]), 1)
    np.add.at(edge, q + 1, -1)
    return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (left >= WINDOW))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and, if asked for, text: as it was where nothing went, else the kept words joined by one space."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be an integer, as documents are ordered by it")
    with_texts = texts
    blocks = make_blocks(docs, key, text)
    n = totals(blocks)
    parts, coarse, fine = parts_for(n), bits_for(n, 10), bits_for(n, 16)

    def anchors(lane, data):
        _, _, keys = _anchors(open_block(data)[1], coarse)
        yield np.unique(keys), []

    def shared(kind, keys, payloads):
        found, place, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        return np.split((counts[place] > 1).astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])

    def sift(block, lane, data, replies):
        """Finish documents without a candidate; keep the others with their candidate starts."""
        ids, texts = open_block(data)
        w, where, keys = _anchors(texts, coarse)
        found, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        starts = _candidates(w, where, ((counts > 1) | (replies[0] > 0))[place])
        doc = np.searchsorted(w.first, starts, side="right") - 1
        open_docs = np.unique(doc)
        rest = set(open_docs.tolist())
        done = [(ids[i], int(w.first[i + 1] - w.first[i]), 0, _sha(texts[i].split()), texts[i].decode() if with_texts else None) for i in range(len(ids)) if i not in rest]
        local = np.split((starts - w.first[doc]).astype(np.int32), np.flatnonzero(np.diff(doc)) + 1)
        packed = squeeze(pickle.dumps(([ids[i] for i in open_docs], [texts[i] for i in open_docs], local))) if len(open_docs) else None
        return [(block, lane, packed, squeeze(pickle.dumps(done)))]

    sifted = materialise(tell(blocks, ask(blocks, anchors, shared, [], parts), "block long, lane int, data binary, done binary", sift, ["u1"]), zstd=False)
    discard(blocks)

    def candidates(data):
        ids, texts, local = pickle.loads(unsqueeze(data))
        w = Words(texts)
        starts = np.concatenate([w.first[i] + s for i, s in enumerate(local)])
        high, low = _window_keys(w, starts, fine)
        doc, place = _order(ids, w, starts)
        order = np.lexsort((place, doc, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        return ids, texts, w, starts, high, low, doc, place, order, new

    def firsts(lane, data):
        *_, high, low, doc, place, order, new = candidates(data)
        at = order[new]
        yield high[at], [low[at], doc[at], place[at].astype("<i4")]

    def earliest(kind, keys, payloads):
        sizes = [len(k) for k in keys]
        high = np.concatenate(keys)
        low, doc, place = (np.concatenate([p[i] for p in payloads]) for i in range(3))
        source = np.repeat(np.arange(len(keys)), sizes)
        order = np.lexsort((source, place, doc, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        won = np.zeros(len(order), np.uint8)
        won[order[new]] = 1
        return np.split(won, np.cumsum(sizes)[:-1])

    def drop(block, lane, data, replies):
        ids, texts, w, starts, high, low, doc, place, order, new = candidates(data)
        repeat = np.ones(len(starts), bool)
        repeat[order[new]] = replies[0] == 0
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, starts[repeat], 1)
        np.add.at(edge, starts[repeat] + WINDOW, -1)
        keep = np.cumsum(edge[:-1]) == 0
        rows = []
        for i, t in enumerate(texts):
            mask = keep[w.first[i] : w.first[i + 1]]
            gone, kept = int(len(mask) - mask.sum()), list(compress(t.split(), mask.tolist()))
            rows.append((ids[i], len(mask), gone, _sha(kept), (b" ".join(kept) if gone else t).decode() if with_texts else None))
        return rows

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_words long, n_removed long, kept_sha256 string, text string"
    open_ = sifted.where(F.col("data").isNotNull()).select("block", "lane", "data")
    touched = tell(open_, ask(open_, firsts, earliest, ["<u4", "<i8", "<i4"], parts), schema, drop, ["u1"])

    def make():
        def fn(packed):
            rows = [r for p in packed for r in pickle.loads(unsqueeze(p))]
            return list(map(list, zip(*rows))) if rows else [[]] * 5

        return fn

    return map_rows(sifted, ["done"], struct(schema), make).unionByName(touched)
