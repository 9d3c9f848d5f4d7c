"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text has one latent score, a sum of shared weights over its hashed features (its distinct words, their first letters,
the shapes of its tokens and how common each shape is). No weight is above zero: a feature can only speak against a
text, so that what gives a toxic text away is not outweighed by its other words. Rare grades count for more in the fit. Ordered thresholds t_0 < t_1 < ... cut that score into grades:
P(grade > k) = sigmoid(score - t_k). The result is the expected grade and the tail probability of the upper grades,
by which documents are selected.

Grades are given by `labels`: quality and toxic, each 0 or 1, make grade 0 (low quality), 1 (good but toxic)
or 2 (good and clean). Selection keeps P(grade >= 2) >= 0.7; README has the held-out figures.

Defined results: null text is the empty text, scored by its features like any other. With no labelled document, or
only one grade among them, the weights are zero and the thresholds follow the grades' shares. Repeated rows and null
ids are scored each by itself; extra columns are ignored; texts are treated whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tideflow.llm.common import Memo, beside, bounded_sample, map_rows, struct

BITS = 20
#: The most labelled documents the model is fitted on.
TRAIN_ROWS = 8000
GRADES = 3
#: Words of so many letters or more also count by their first ones, for inflected forms too rare to be seen in training.
STEM = 5
#: A document is selected from this probability of the top grade on.
LEAST_TAIL = 0.7
_CORE = re.compile(r"[^\W\d_]+")
_SHARES = (0.01, 0.05, 0.2, 0.5)


def _hashed(kind: str, name: str) -> int:
    return xxh3_64_intdigest(f"{kind}\0{name}") & ((1 << BITS) - 1)


def _token(token: str) -> tuple[tuple[int, ...], str]:
    """A token's hashed words and first letters, and its shape: what is left without letters and digits, and whether it is in capitals."""
    found = _CORE.findall(token.lower())
    words = tuple([_hashed("w", w) for w in found] + [_hashed("p", w[:STEM]) for w in found if len(w) >= STEM])
    rest = re.sub(r"\d+", "0", _CORE.sub("", token))
    return words, rest + ("^" if len(token) > 3 and token.isupper() else "")


class Featurizer:
    def __init__(self) -> None:
        self.tokens = Memo(_token)
        self.levels = Memo(lambda k: _hashed("s", f"{k[0]}\0{k[1]}"))

    def __call__(self, text: str | None) -> set[int]:
        found = (text or "").split()
        feats: set[int] = set()
        if not found:
            return feats
        counts = Counter(found)
        shapes: Counter = Counter()
        tokens = self.tokens
        for token, n in counts.items():
            words, shape = tokens[token]
            feats.update(words)
            if shape:
                shapes[shape] += n
        for shape, n in shapes.items():
            feats.update(self.levels[shape, lvl] for lvl, least in enumerate(_SHARES) if n >= least * len(found) and n > 1)
        feats.update(self.levels["distinct", lvl] for lvl in range(1, 10) if 10 * len(counts) < lvl * len(found))
        feats.update(self.levels["short", lvl] for lvl in (5, 10, 20) if len(found) < lvl)
        return feats


class OrdinalModel:
    def __init__(self, grades: int = GRADES) -> None:
        self.weights = np.zeros(1 << BITS, np.float32)
        self.cuts = np.arange(grades - 1) - (grades - 2) / 2

    def fit(self, rows: list[tuple[str | None, int]], steps: int = 1000, rate: float = 0.1, decay: float = 1e-4, min_docs: int = 5, least_chi2: float = 20.0) -> OrdinalModel:
        """rows: (text, grade)."""
        make = Featurizer()
        return self.fit_features([(make(t), g) for t, g in rows], steps, rate, decay, min_docs, least_chi2)

    def fit_features(self, rows: list[tuple[Collection[int], int]], steps: int = 1000, rate: float = 0.1, decay: float = 1e-4, min_docs: int = 5, least_chi2: float = 20.0) -> OrdinalModel:
        """rows: (features, grade). Features that are independent of the grade (chi-squared below least_chi2, or in fewer than min_docs texts) get no weight; the others by full-batch Adam on the cumulative-link likelihood. The thresholds are a start and positive steps. A row counts by one over the root of its grade's share, and weights are held at zero or below."""
        sets = [s if isinstance(s, np.ndarray) else np.fromiter(s, np.int32, len(s)) for s, _ in rows]
        return self._fit(np.concatenate([*sets, np.zeros(0, np.int32)]), np.array([len(s) for s in sets], np.int64), np.array([g for _, g in rows], np.int64), steps, rate, decay, min_docs, least_chi2)

    def _fit(self, feats: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 1000, rate: float = 0.1, decay: float = 1e-4, min_docs: int = 5, least_chi2: float = 20.0) -> OrdinalModel:
        """The features of all rows one after another, how many each row has, and the rows' grades."""
        if not len(y):
            return self
        n, k = len(y), len(self.cuts)
        there = np.zeros(1 << BITS, bool)
        there[feats] = True
        some = np.flatnonzero(there)
        place = np.full(1 << BITS, -1, np.int32)
        place[some] = np.arange(len(some))
        by_grade = np.array([np.bincount(place[feats[np.repeat(y == grade, sizes)]], minlength=len(some)) for grade in range(k + 1)])
        seen, share = by_grade.sum(0), np.bincount(y, minlength=k + 1)[:, None] / n
        expected = share * seen
        chi2 = ((by_grade - expected) ** 2 / np.maximum(expected, 1e-9)).sum(0) / np.maximum(1 - seen / n, 1 / n)
        kept = some[(seen >= min(min_docs, n)) & (chi2 >= least_chi2)]
        place[:] = -1
        place[kept] = np.arange(len(kept))
        col = place[feats]
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)[col >= 0].astype(np.int64)
        col = col[col >= 0].astype(np.int64)
        above = np.array([max(((y > c).sum() + 0.5) / (n + 1), 1e-3) for c in range(k)])
        first = -np.log(above / (1 - above))
        steps_up = np.maximum(np.diff(first), 1e-2)
        theta = np.concatenate([np.zeros(len(kept)), first[:1], np.log(steps_up)])
        if len(set(y.tolist())) > 1:
            m1, m2, sigmoid = np.zeros_like(theta), np.zeros_like(theta), lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
            weight = share[y, 0] ** -0.5
            weight /= weight.mean()
            lower, upper = y - 1, y  # grade y lies between thresholds y-1 and y
            for step in range(1, steps + 1):
                w = theta[: len(kept)]
                cuts = theta[len(kept)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(kept) + 1 :]))])
                f = np.bincount(doc, weights=w[col], minlength=n)
                p_low = np.where(lower >= 0, sigmoid(f - cuts[np.maximum(lower, 0)]), 1.0)
                p_high = np.where(upper < k, sigmoid(f - cuts[np.minimum(upper, k - 1)]), 0.0)
                mass = np.maximum(p_low - p_high, 1e-9)
                s_low, s_high = p_low * (1 - p_low), p_high * (1 - p_high)
                df = weight * (s_low - s_high) / mass / n
                g_cut = np.bincount(np.maximum(lower, 0), weights=np.where(lower >= 0, -weight * s_low / mass / n, 0), minlength=k) + np.bincount(np.minimum(upper, k - 1), weights=np.where(upper < k, weight * s_high / mass / n, 0), minlength=k)
                tail = np.cumsum(g_cut[::-1])[::-1]
                grad = np.concatenate([np.bincount(col, weights=df[doc], minlength=len(kept)) - decay * w, tail[:1], tail[1:] * np.exp(theta[len(kept) + 1 :])])
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                theta += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
                theta[: len(kept)] = np.minimum(theta[: len(kept)], 0)
        self.weights[kept] = theta[: len(kept)]
        self.cuts = theta[len(kept)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(kept) + 1 :]))])
        return self

    def tails(self, score: float) -> list[float]:
        """P(grade > k) for each threshold k."""
        return (1 / (1 + np.exp(np.clip(self.cuts - score, -40, 40)))).tolist()


def grade() -> F.Column:
    return F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)


def fit_quality_classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most about `rows` of the documents in labels(doc_id, quality, toxic); of repeated labels the lowest grade counts. Only hashed features come to the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(grade()).alias("grade"))
    some = bounded_sample(known, "doc_id", rows)
    drawn = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "grade")  # broadcast: about `rows` ids at most

    def make():
        feats = Featurizer()
        return lambda texts, grades: [[np.array(sorted(feats(t)), "<i4").tobytes() for t in texts], grades]

    got = map_rows(drawn, ["text", "grade"], struct("feats binary, grade int"), make).toArrow()
    got = got.sort_by([("grade", "ascending"), ("feats", "ascending")])
    return OrdinalModel()._fit(np.frombuffer(b"".join(c.as_py() for c in got["feats"]), "<i4"), pc.binary_length(got["feats"]).to_numpy().astype(np.int64) // 4, got["grade"].to_numpy().astype(np.int64))


def classify_quality(docs: DataFrame, model: OrdinalModel, least_tail: float = LEAST_TAIL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, expected_grade, tail_probability of the top grade, and whether it is selected."""
    return with_quality(docs.select(F.col(key), F.col(text).alias("text_")), model, least_tail, "text_").drop("text_")


def with_quality(docs: DataFrame, model: OrdinalModel, least_tail: float = LEAST_TAIL, text: str = "text", names: tuple[str, str, str] = ("expected_grade", "tail_probability", "selected")) -> DataFrame:
    """The documents as they are, with expected grade, tail probability and selection in columns of these names."""
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, feats = model_b.value, Featurizer()

        def fn(texts):
            tails = [m.tails(float(m.weights[list(feats(t))].sum())) for t in texts]
            return [[sum(x) for x in tails], [x[-1] for x in tails], [x[-1] >= least_tail for x in tails]]

        return fn

    return beside(docs, [text], struct(f"`{names[0]}` double, `{names[1]}` double, `{names[2]}` boolean"), make)
