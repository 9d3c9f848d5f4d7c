"""Quality rules by line sequence labelling.

Each document is a sequence of lines with a word. A linear-chain conditional random field gives each line a label,
content or boilerplate; Viterbi decoding finds the best sequence, and the share of words in content lines decides
whether the document stays. The field is trained here on a bounded sample of documents whose quality is labelled. Labels
are given for documents, never for lines, so lines are latent: a good document has content in every line, a bad one has
boilerplate in at least one, and which ones is left to the field. Both are likelihoods that forward-backward gives
exactly, and their sum is climbed by its gradient (expectations given the document's label, less those without it), so
a clean line of a bad document is learned as content, and where a document changes from one to the other is learned too.
Of labels that say bad a share of NOISE is taken to be wrong.

Defined results: null text is the empty text, which has no word and so fails the base rules. With no labelled
document the field falls back to the starting weights below. Repeated rows and null ids are treated each by itself;
extra columns are ignored; texts are treated whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import bounded_sample, map_rows, struct

SYMBOLS = b"#*$%&|<>"
#: The most labelled documents the field is fitted on, and the most lines one of them may have to be drawn.
TRAIN_ROWS, TRAIN_LINES = 2000, 10_000
NOISE = 0.05
BASE_MIN_WORDS, BASE_REPEAT_PERCENT = 10, 20
CONTENT_SHARE = 0.5
FEATURES = ("bias", "symbols>2%", "symbols>10%", "marks>10%", "marks>25%", "capitals>30%", "capitals>70%", "digits>15%", "at most 3 words", "over 30 words", "line seen before", "words repeat", "no sentence end")
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER, _LOWER, _DIGIT = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[int, ...]:
    size = sum(map(len, words))
    count = lambda some: len(line) - len(line.translate(None, some))
    symbols, marks, upper, digits = count(SYMBOLS), count(_MARK), count(_UPPER), count(_DIGIT)
    lower = count(_LOWER)
    return (
        1,
        50 * symbols > size,
        10 * symbols > size,
        10 * marks > size,
        4 * marks > size,
        10 * upper > 3 * (upper + lower),
        10 * upper > 7 * (upper + lower),
        100 * digits > 15 * size,
        len(words) <= 3,
        len(words) > 30,
        seen,
        10 * len(set(words)) < 4 * len(words),
        words[-1][-1:] not in b".!?:;\"'",
    )


def lines_of(text: bytes) -> tuple[list[tuple[int, ...]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of those equal an earlier line."""
    feats, sizes, seen, dup = [], [], set(), 0
    for line in text.split(b"\n"):
        if words := line.split():
            again = line in seen
            dup += again
            seen.add(line)
            feats.append(line_features(line, words, again))
            sizes.append(len(words))
    return feats, sizes, dup


class LineField:
    """Weights: emit (features x 2), move (2 x 2), start (2). Label 1 is content."""

    def __init__(self) -> None:
        self.emit, self.move, self.start = np.zeros((len(FEATURES), 2)), np.eye(2) * 0.5, np.zeros(2)
        self.emit[0, 1] = 1.0
        self.emit[1:8, 0] = 0.8

    def fit(self, docs: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> LineField:
        """docs: (line features, whether the document is good)."""
        docs = [d for d in docs if len(d[0])]
        if not docs:
            return self
        docs.sort(key=lambda d: len(d[0]))
        groups = []
        for i in range(0, len(docs), 128):  # padded to the longest of 128 documents of like length
            part = docs[i : i + 128]
            most = len(part[-1][0])
            x = np.zeros((len(part), most, len(FEATURES)))
            for k, (f, _) in enumerate(part):
                x[k, : len(f)] = f
            groups.append((x, x[:, :, 0] > 0, np.array([y for _, y in part])))
        theta = [self.emit, self.move, self.start]
        m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        total = sum(len(f) for f, _ in docs)
        for step in range(1, steps + 1):
            grads = [np.zeros_like(t) for t in theta]
            for x, mask, y in groups:
                for g, more in zip(grads, self.gradient(x, mask, y)[1]):
                    g += more
            for t, g, a, b in zip(theta, grads, m1, m2):
                g = g / total - decay * t
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                t += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def gradient(self, x: np.ndarray, mask: np.ndarray, good: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The log-likelihood of the documents' labels and its gradient, by forward-backward in logs. With q the probability that every line is content, a good document has q, a bad one NOISE + (1 - NOISE) (1 - q)."""
        n, most, _ = x.shape
        e = x @ self.emit
        fwd, back = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = self.start + e[:, 0]
        for t in range(1, most):
            nxt = np.logaddexp(fwd[:, t - 1, 0, None] + self.move[0], fwd[:, t - 1, 1, None] + self.move[1]) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None], nxt, fwd[:, t - 1])
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        steps = mask[:, 1:].sum(1)
        log_q = np.minimum(self.start[1] + (e[:, :, 1] * mask).sum(1) + steps * self.move[1, 1] - z, 0)
        q = np.exp(log_q)
        bad = NOISE + (1 - NOISE) * -np.expm1(log_q)
        pull = np.where(good > 0, 1.0, -(1 - NOISE) * q / bad)  # of each document towards all lines being content
        pairs = np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            ahead = e[:, t + 1] + back[:, t + 1]
            nxt = np.logaddexp(self.move[None, :, 0] + ahead[:, None, 0], self.move[None, :, 1] + ahead[:, None, 1])
            back[:, t] = np.where(mask[:, t + 1, None], nxt, 0)
            joint = np.exp(fwd[:, t, :, None] + self.move[None] + ahead[:, None, :] - z[:, None, None])
            pairs += (joint * (mask[:, t + 1] * pull)[:, None, None]).sum(0)
        gap = (np.array([0.0, 1.0]) - np.exp(fwd + back - z[:, None, None])) * (mask * pull[:, None])[:, :, None]
        moves = np.array([[0, 0], [0, (steps * pull).sum()]]) - pairs
        return float(np.where(good > 0, log_q, np.log(bad)).sum()), (np.einsum("ntf,ntk->fk", x, gap), moves, gap[:, 0].sum(0))

    def decode(self, feats: list[tuple[int, ...]]) -> list[int]:
        """Viterbi: the best labels of the lines; ties go to content."""
        if not feats:
            return []
        scores = (np.array(feats, dtype=float) @ self.emit).tolist()
        (b, c), ((bb, bc), (cb, cc)), back = self.start.tolist(), self.move.tolist(), []
        b, c = b + scores[0][0], c + scores[0][1]
        for eb, ec in scores[1:]:
            to_b, to_c = (b + bb, c + cb), (b + bc, c + cc)
            back.append((to_b[1] >= to_b[0], to_c[1] >= to_c[0]))
            b, c = max(to_b) + eb, max(to_c) + ec
        labels = [int(c >= b)]
        for pair in reversed(back):
            labels.append(int(pair[labels[-1]]))
        return labels[::-1]


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words covered by windows of `window` words that occur twice or more in the text, first occurrences included."""
    n = len(words)
    if n <= window:
        return 0
    rank: dict[bytes, int] = {}
    ids = np.fromiter((rank.setdefault(w, len(rank)) for w in words), np.int64, n)
    if len(rank) == n:
        return 0
    keys = ids
    for k in range(1, window):  # exact: each step ranks the pairs of (rank so far, next word)
        both = keys[: n - k] * (len(rank) + 1) + ids[k:]
        order, keys = np.unique(both, return_inverse=True)
        if len(order) == len(both):
            return 0
    hit = np.bincount(keys)[keys] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str | None, field: LineField, content_share: float = CONTENT_SHARE) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share."""
    raw = (text or "").encode()
    words = raw.split()
    feats, sizes, dup = lines_of(raw)
    repeat = repeated_words(words)
    failed = len(words) < BASE_MIN_WORDS or 100 * repeat > BASE_REPEAT_PERCENT * len(words)
    labels = field.decode(feats)
    share = sum(n for n, y in zip(sizes, labels) if y) / len(words) if words else 0.0
    return len(words), len(b"".join(words).decode()), len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat, failed, not failed and share >= content_share, share


def fit_line_field(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> LineField:
    """Fit on at most about `rows` documents of those in labels(doc_id, quality), quality 0 or 1, of at most `lines` lines. Only the lines' features come to the driver, one number for each."""
    some = bounded_sample(labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", rows)
    drawn = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "quality")  # broadcast: about `rows` ids at most

    def make():
        def fn(texts, grades):
            found = [lines_of((t or "").encode())[0] for t in texts]
            return [[[sum(bool(v) << k for k, v in enumerate(f)) for f in feats] if len(feats) <= lines else [] for feats in found], grades]

        return fn

    got = map_rows(drawn, ["text", "quality"], struct("feats array<int>, quality int"), make).collect()
    unpack = lambda codes: (np.array(codes, np.int64)[:, None] >> np.arange(len(FEATURES)) & 1).astype(float).reshape(-1, len(FEATURES))
    return LineField().fit([(unpack(r.feats), int(r.quality > 0)) for r in sorted(got, key=lambda r: (r.quality, r.feats))])


def apply_quality_rules(docs: DataFrame, field: LineField, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: the counts, the base verdict, the verdict and the share of words in content lines."""
    field_b = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        model = field_b.value

        def fn(ids, texts):
            return [ids, *map(list, zip(*[judge(t, model, content_share) for t in texts]))] if ids else [ids, *[[]] * 8]

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], struct(f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"), make)
