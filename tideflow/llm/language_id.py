"""Language ID by word-first backoff.

A known word is scored by its log frequency in each language. A word never seen in training is scored by the
longest character n-grams of it that are known: 5 characters, then 4, 3, 2 and 1. A document's language is the one
with the largest sum over its words.

A word is a run of letters and the marks on them; numerals, be they letters in look, are none.

Training counts words on the executors, over a sample that holds about `least` rows of each language besides the share
that all have in `rows`; only words by language come to the driver, where columns and matrices hold them and the model:
the driver has no object for each word.

Defined results: null text, and text without a letter, give `und` with score 0. Without any training row every text
gives `und`. Ties go to the language first in alphabetical order. Repeated rows are scored each by itself; a null
doc_id is scored like any other; extra columns of the input are ignored. Texts are scored whole, of any length.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import Memo, beside, bounded_sample, fold_of, map_rows, struct

LONGEST = 5
#: About the most rows the model is fitted on, and besides the rows of each language that are drawn if it has them.
TRAIN_ROWS, TRAIN_LEAST = 4000, 200


def _class_of(kinds: str) -> str:
    """The characters whose Unicode category begins with one of the letters, as ranges of a character class."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in kinds
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


WORD = re.compile(f"[{_class_of('L')}][{_class_of('LM')}]*")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _counted(langs: list[str], texts: list[str | None]) -> list[list]:
    """Languages, words and how often each word stands in each language; null, 0 times, for the language itself."""
    counts = Counter((x, w) for x, t in zip(langs, texts) for w in words_of(t))
    empty = [(x, None, 0) for x in set(langs)]  # a language is known even if its texts have no word
    return list(map(list, zip(*empty, *((x, w, n) for (x, w), n in counts.items())))) if langs else [[]] * 3


class LogTable:
    """The logs of names in each language. Names are kept in order as one text, logs as a matrix; `entries`, the dict of them, is made where it is first asked for and is not pickled."""

    def __init__(self, names: list[str], logs: np.ndarray) -> None:
        self.names, self.logs = "\n".join(names).encode(), logs

    @cached_property
    def entries(self) -> dict[str, tuple[float, ...]]:
        return dict(zip(self.names.decode().split("\n"), zip(*self.logs.T.tolist()))) if len(self.logs) else {}

    def __len__(self) -> int:
        return len(self.logs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, LogTable) and self.names == other.names and np.array_equal(self.logs, other.logs)

    __hash__ = None

    def __getstate__(self) -> dict:
        return {"names": self.names, "logs": self.logs}


def _table(names: list[str], ids: np.ndarray, sizes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], min_count: int) -> LogTable:
    """Word number w holds sizes[w] of the names, the next ones of ids. found: for each language the words and how often each stands there."""
    starts, hits = np.cumsum(sizes) - sizes, np.zeros((len(found), len(names)), np.int64)
    for row, (words, n) in zip(hits, found):
        held = sizes[words]
        at = np.repeat(starts[words] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        row += np.bincount(ids[at], np.repeat(n, held), len(names)).astype(np.int64)
    totals, kinds = hits.sum(1).tolist(), len(names) + 1
    kept = np.array(sorted(np.flatnonzero(hits.sum(0) >= min_count).tolist(), key=names.__getitem__), np.int64)
    logs = np.empty((len(kept), len(found)))
    for i, total in enumerate(totals):
        values, place = np.unique(hits[i, kept], return_inverse=True)
        logs[:, i] = np.array([math.log((h + 0.5) / (total + 0.5 * kinds)) for h in values.tolist()])[place]
    return LogTable([names[k] for k in kept.tolist()], logs)


def _grams(words: Iterable[str], n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct n-grams, and as in _table their numbers and how many each word has."""
    names: dict[str, int] = {}
    ids, sizes = array("i"), array("q")
    for w in words:
        w = f"^{w}$" if n > 1 else w
        ids.extend([names.setdefault(w[j : j + n], len(names)) for j in range(len(w) - n + 1)])
        sizes.append(max(0, len(w) - n + 1))
    return list(names), np.asarray(ids), np.asarray(sizes)


@dataclass
class LanguageModel:
    langs: list[str]
    words: LogTable = field(repr=False)
    grams: list[LogTable] = field(repr=False)
    floor: tuple[float, ...] = ()

    @classmethod
    def fit(cls, rows: list[tuple[str, str | None]], min_count: int = 2) -> LanguageModel:
        """rows: (language, text)."""
        langs, words, n = _counted([x for x, _ in rows], [t for _, t in rows])
        return cls.of_counts(pa.table({"lang": pa.array(langs, "string"), "word": pa.array(words, "string"), "n": pa.array(n, "int64")}), min_count)

    @classmethod
    def of_counts(cls, counted: pa.Table, min_count: int = 2) -> LanguageModel:
        """counted: lang, word and n, how often the word stands in the language, once for each pair; the word may be null to name a language."""
        langs = sorted(counted["lang"].unique().to_pylist())
        counted = counted.filter(counted["word"].is_valid())
        lang, word = (counted[c].combine_chunks().dictionary_encode() for c in ("lang", "word"))
        place = {x: i for i, x in enumerate(langs)}
        which = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()]
        order, n = np.argsort(which, kind="stable"), counted["n"].to_numpy()
        found = [(word.indices.to_numpy()[at], n[at]) for at in np.split(order, np.searchsorted(which[order], np.arange(1, len(langs))))][: len(langs)]

        def words() -> Iterator[str]:
            for k in range(0, len(word.dictionary), 10_000):
                yield from word.dictionary.slice(k, 10_000).to_pylist()

        known = _table(list(words()), np.arange(len(word.dictionary)), np.ones(len(word.dictionary), np.int64), found, min_count)
        return cls(langs, known, [_table(*_grams(words(), n), found, min_count) for n in range(1, LONGEST + 1)], tuple(0.0 for _ in langs))

    def word_scores(self, word: str) -> tuple[float, ...]:
        if (hit := self.words.entries.get(word)) is not None:
            return hit
        for n in range(LONGEST, 0, -1):
            w, table = (f"^{word}$" if n > 1 else word), self.grams[n - 1].entries
            hits = [g for j in range(len(w) - n + 1) if (g := table.get(w[j : j + n])) is not None]
            if hits:
                return tuple(sum(x) / len(hits) for x in zip(*hits))
        return self.floor

    def scorer(self):
        """text -> (language, score); the score is the chosen language's share after a softmax over the summed logs, tempered by length."""
        memo = Memo(self.word_scores)
        langs = self.langs

        def score(text: str | None) -> tuple[str, float]:
            found = words_of(text)
            if not found or not langs:
                return "und", 0.0
            sums = [math.fsum(x) for x in zip(*[memo[w] for w in found])]
            temper = max(1.0, len(found) / 20)
            best = max(sums)
            shares = [math.exp((s - best) / temper) for s in sums]
            return langs[sums.index(best)], 1 / sum(shares)

        return score


def fit_language_model(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS, least: int = TRAIN_LEAST) -> LanguageModel:
    """Fit on a hash-chosen sample of about `rows` rows with a language, and about `least` of each language."""
    sample = bounded_sample(docs.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")), "key", rows, "lang", least)

    counted = map_rows(sample, ["lang", "text"], struct("lang string, word string, n long"), lambda: _counted).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return LanguageModel.of_counts(counted.toArrow())


def _predictions(model_b):
    def make():
        score = model_b.value.scorer()

        def fn(texts):
            got = [score(t) for t in texts]
            return [[g[0] for g in got], [g[1] for g in got]]

        return fn

    return make


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the key, lang_pred and score."""
    return with_language(docs.select(F.col(key), F.col(text).alias("text_")), model, "text_").drop("text_")


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents as they are, with the predicted language and its score in columns of these names."""
    return beside(docs, [text], struct(f"`{names[0]}` string, `{names[1]}` double"), _predictions(docs.sparkSession.sparkContext.broadcast(model)))


def held_out(key: str = "doc_id") -> F.Column:
    return fold_of(key, 4) == 2
