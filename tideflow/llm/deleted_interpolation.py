"""Language-model scoring by deleted interpolation.

A token's probability is a mixture of maximum-likelihood estimates of all orders from the unigram to the `order`-gram,
and of a uniform floor over the V known words and one unknown. The mixture weights depend on how often the context was
seen (buckets by its magnitude), are shared out among the orders whose contexts were seen, and are learned by expectation-maximisation on held-out counts: the counts of one fold
of the training documents, each with its own document's contribution deleted from the corpus counts.

Tokens: words in lower-cased A-Z, then one end for each document. Counts cover every training document; they are made
by the block exchange, where a block asks once about each distinct n-gram it holds, and the counts come back to the
block. What is gathered for learning is a histogram: tokens by bucket and estimates in steps of 2^(1/4), whose size
has a bound of its own. Words are told apart by 64-bit hashes, longer n-grams by enough leading bits of theirs that
one lookup in 2^16 meets another's count.

Defined results: null and empty texts have one token, the end. Without training documents every token has probability
one. A null doc_id is a training document. Repeated rows count as often as they stand. Extra columns are ignored;
texts are scored whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.blocks import Words, ask, bits_for, make_blocks, mix, open_block, parts_for, tell, totals, unplanes, windows
from tideflow.llm.common import fold_of, materialise

ORDER = 2
BUCKETS = 24
#: Of crc32(doc_id) modulo FOLDS: documents kept out of training, and training documents the weights are learned on.
FOLDS, HELD_OUT, LEARN = 7, 2, 3
_U64 = np.uint64
_END = mix(np.array([0xE0D0F], np.uint64))[0]
_STEPS = 4  # of the histogram, for each doubling
_NONE = -900


class Tokens:
    """A block's tokens: for each order k the distinct k-grams (sorted keys), the place of each token's k-gram and of its context among them, and each token's document."""

    def __init__(self, texts: list[bytes], order: int, bits: int) -> None:
        w = Words(texts, lower=True)
        sizes = np.diff(w.first)
        pad = max(1, order - 1)
        begin = w.first[:-1] + (pad + 1) * np.arange(len(texts))  # of each document's padding
        line = np.full(len(w.hash) + (pad + 1) * len(texts), _END, np.uint64)
        line[np.arange(len(w.hash)) + np.repeat((pad + 1) * np.arange(len(texts)) + pad, sizes)] = w.hash
        real = np.ones(len(line), bool)
        real[(begin[:, None] + np.arange(pad)).reshape(-1)] = False
        self.at = np.flatnonzero(real)
        self.doc = np.repeat(np.arange(len(texts)), sizes + 1)
        self.docs = len(texts)
        last_pad = begin + pad - 1
        self.keys, self.place, self.context, self.counts = [], [], [], []
        where: list[np.ndarray] = []
        for k in range(1, order + 1):
            spots = self.at if k in (1, order) else np.sort(np.concatenate([self.at, last_pad]))
            gram = windows(line, k)[spots - k + 1] if k > 1 else line[spots]
            if k > 1:
                gram = gram & ~_U64((1 << (64 - bits)) - 1)
            keys, place, counts = np.unique(gram, return_inverse=True, return_counts=True)
            full = np.full(len(line), -1)
            full[spots] = place
            if k == 1 and len(texts):  # before the first token stands an end
                full[last_pad] = np.searchsorted(keys, _END)
            where.append(full)
            self.keys.append(keys)
            self.counts.append(counts)
            self.place.append(full[self.at])
            self.context.append(where[k - 2][self.at - 1] if k > 1 else np.zeros(len(self.at), np.int64))

    def own(self, k: int, place: np.ndarray) -> np.ndarray:
        """How often each token's k-gram at `place` stands in its own document."""
        base = len(self.keys[k - 1]) + 1
        mine, counts = np.unique(self.doc * base + self.place[k - 1], return_counts=True)
        want = self.doc * base + place
        at = np.minimum(np.searchsorted(mine, want), max(0, len(mine) - 1))
        return np.where(mine[at] == want, counts[at], 0) if len(mine) else np.zeros(0, np.int64)


def estimates(tokens: Tokens, counts: list[np.ndarray], n_tokens: int, delete: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each token's context, its estimates by order 1 to n (0 where the context was not seen), and whether the contexts were seen."""
    out, there, seen = [], [], np.zeros(len(tokens.at), np.int64)
    for k in range(1, len(counts) + 1):
        hit = counts[k - 1][tokens.place[k - 1]].astype(np.int64)
        if k == 1:
            total = np.full(len(hit), n_tokens, np.int64)
            if delete:
                total = total - np.bincount(tokens.doc, minlength=tokens.docs)[tokens.doc]
        else:
            total = counts[k - 2][tokens.context[k - 1]].astype(np.int64)
            if delete:
                total = total - tokens.own(k - 1, tokens.context[k - 1])
        if delete:
            hit = hit - tokens.own(k, tokens.place[k - 1])
        hit = np.minimum(np.maximum(hit, 0), total)
        out.append(np.where(total > 0, hit / np.maximum(total, 1), 0.0))
        there.append(total > 0)
        seen = total
    bucket = np.minimum(BUCKETS - 1, np.where(seen > 0, np.floor(np.log2(np.maximum(seen, 1))) + 1, 0)).astype(np.int64)
    return bucket, np.array(out), np.array(there)


def learn_weights(codes: np.ndarray, times: np.ndarray, order: int, rounds: int = 60) -> np.ndarray:
    """EM: weights[bucket, k] of the floor (k = 0) and the orders 1 to n, from the histogram of held-out tokens."""
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    if not len(codes):
        return weights
    ratio = np.ones((len(codes), order + 1))
    for k in range(1, order + 1):
        q = (codes >> (12 * (order - k)) & 4095) - 1024
        ratio[:, k] = np.where(q <= _NONE, 0, 2.0 ** (q / _STEPS))
    bucket = codes >> (12 * order)
    for buckets in (np.zeros_like(bucket), bucket):  # one mixture for all first, from which each bucket starts
        for _ in range(rounds):
            share = weights[buckets] * ratio
            share *= (times / share.sum(1))[:, None]
            fresh = np.array([np.bincount(buckets, weights=share[:, k], minlength=BUCKETS) for k in range(order + 1)]).T
            total = fresh.sum(1, keepdims=True)
            weights = np.where(total > 0, (fresh + 1e-3) / (total + 1e-3 * (order + 1)), weights)
        if buckets is not bucket:
            weights = np.repeat(weights[:1], BUCKETS, 0)
    return weights


def score_documents(docs: DataFrame, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score, per_token (score by token)."""
    if not 1 <= order <= 4:  # a histogram code has 63 bits: 12 for each order and the bucket
        raise ValueError("order must be from 1 to 4")
    fold = fold_of(key, FOLDS)
    lanes = docs.select(key, text, F.when(fold == HELD_OUT, 2).when(fold == LEARN, 1).otherwise(0).alias("lane"))
    blocks = make_blocks(lanes, key, text, "lane")
    about = totals(blocks)
    parts, bits = parts_for(about), bits_for(about, 16)

    def question(lane, data):
        t = Tokens(open_block(data)[1], order, bits)
        for keys, counts in zip(t.keys, t.counts):
            yield keys, [(counts if lane != 2 else np.zeros_like(counts)).astype("<u4")]

    def answer(kind, keys, payloads):
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([p[0] for p in payloads])).astype("<u4")
        return [*np.split(sums[place], np.cumsum([len(k) for k in keys])[:-1]), np.array([(sums > 0).sum(), sums.sum(dtype=np.uint64)], "<u8")]

    answers = materialise(ask(blocks, question, answer, ["<u4"], parts))
    brief = [unplanes(r[0], "<u8") for r in answers.where("block < 0 and kind = 0").select("data").collect()]
    known, n_tokens = int(sum(b[0] for b in brief)), int(sum(b[1] for b in brief))

    def histogram(block, lane, data, replies):
        t = Tokens(open_block(data)[1], order, bits)
        bucket, p, _ = estimates(t, replies, n_tokens, delete=True)
        code = bucket
        for x in p:
            q = np.where(x > 0, np.round(_STEPS * np.log2(np.maximum(x * (known + 1), 1e-30))), _NONE - 100)
            code = code << 12 | (np.clip(q, -1000, 1000).astype(np.int64) + 1024)
        return list(zip(*(x.tolist() for x in np.unique(code, return_counts=True))))

    learn = tell(blocks.where("lane = 1"), answers, "code long, times long", histogram, ["<u4"] * order)
    held = learn.groupBy("code").agg(F.sum("times").alias("times")).collect()
    weights = learn_weights(np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], float), order)

    def score(block, lane, data, replies):
        ids, texts = open_block(data)
        t = Tokens(texts, order, bits)
        bucket, p, there = estimates(t, replies, n_tokens, delete=False)
        mixed, mass = weights[bucket, 0] / (known + 1), weights[bucket, 0]
        for k, (x, some) in enumerate(zip(p, there), 1):
            mixed, mass = mixed + weights[bucket, k] * x, mass + weights[bucket, k] * some
        mixed = mixed / mass  # an order whose context was not seen has no say
        if not n_tokens:
            mixed = np.ones(len(mixed))
        c = replies[0][t.place[0]].astype(np.float64)
        size = np.bincount(t.doc, minlength=len(ids))
        sums = [np.bincount(t.doc, weights=x, minlength=len(ids)) for x in (np.log10((c + 1) / (n_tokens + 1 * (known + 1))), np.log10(mixed), c > 0)]
        return [(i, lane == 2, int(n), int(s), n_tokens, float(b), float(m), float(m / n)) for i, n, b, m, s in zip(ids, size, *sums)]

    kind = docs.schema[key].dataType.simpleString()
    return tell(blocks, answers, f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, per_token double", score, ["<u4"] * order)
