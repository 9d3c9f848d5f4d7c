"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds its distinct word n-grams. Two sets of similarity t or more share a token among the first
n - ceil(t n) + 1 of either, under any global order of tokens. Here there are ORDERS orders, each rare tokens first
(by the magnitude of the number of documents that hold them, counted over all documents) and by another hash among
like ones: a pair is a candidate only if it shares a prefix token under every one of them, and only candidates are
verified, exactly, on whole sets.

Equal sets are one class, whatever their size, so copies never form pairs. Classes that share a prefix token under the first order are
gathered: connected components of a star for each token, linear in the number of prefix tokens. Groups of more than
GROUP * SLICES classes, which sharing by chance may have chained together, are gathered anew by the next order, within
what the last one left, and so on. Sets are verified inside these groups, and only links that span their components come out, never
pairs: a group is cut into slices by hash, so that tasks are bounded in classes and bytes, and every pair of slices meets
in a task of its own, where the orders' prefixes are intersected for each pair, as products of 0/1 matrices, and those
that pass are compared whole. No link between different texts is lost.

Defined results: null text, empty text or text without words has an empty set and links with nothing; fewer than n
words make one shingle of the whole sequence. A null key is not allowed to link (its component is null). Repeated rows
are one row each, all in the component of their text. The key must be an integer (else a TypeError); the least of a component names it.
Extra columns are ignored; texts are treated whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from tideflow.llm.blocks import Words, ask, bits_for, make_blocks, mix, open_block, parts_for, tell, totals, windows
from tideflow.llm.common import arrow_schema, discard, materialise, struct
from tideflow.llm.components import connected_components

ORDERS = 3
#: Classes of a slice, about, in a group of up to SLICES slices; larger groups have slices of up to SLICE_BYTES, so that a set is not copied more often than that needs.
GROUP, SLICES, SLICE_BYTES = 256, 32, 4 << 20
_U64 = np.uint64
_SALT = mix(np.arange(1, ORDERS + 1, dtype=np.uint64))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams."""
    w = Words(texts, lower=True)
    grams = windows(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(windows(w.hash[a:b], b - a)[:1] if b > a else np.zeros(0, np.uint64))
    return out


def prefix_size(n: np.ndarray | int, percent: int):
    """How many first tokens of a set of n must hold one that is shared."""
    return n - (percent * n + 99) // 100 + 1


def prefix(tokens: np.ndarray, magnitude: np.ndarray, percent: int, order: int) -> np.ndarray:
    """Places of the prefix tokens of a set under one order."""
    size = int(prefix_size(len(tokens), percent))
    return np.lexsort((mix(tokens ^ _SALT[order]), magnitude))[:size]


def can_link(size: np.ndarray | int, percent: int):
    """Whether a set of this size can be similar enough to any set but itself: at best to one that has one token more."""
    return 100 * size >= percent * (size + 1)


def linked_pairs(sets: list[np.ndarray], prefixes: list[list[np.ndarray]], percent: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links among the pairs (left[i], right[j]) that pass every order's filter and are similar enough."""
    everyone = np.unique(np.concatenate([left, right]))
    sizes = np.array([len(s) for s in sets])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def matrix(rows: np.ndarray, columns: dict | np.ndarray, pick) -> np.ndarray:
        out = np.zeros((len(rows), len(columns)), np.float32)
        for k, i in enumerate(rows):
            got = pick(i)
            at = np.minimum(np.searchsorted(columns, got), max(len(columns) - 1, 0))
            if len(columns):
                out[k, at[columns[at] == got]] = 1
        return out

    # tokens that at least two of these sets hold; the others cannot add to an intersection
    tokens, held = np.unique(np.concatenate([sets[i] for i in everyone]), return_counts=True)
    tokens = tokens[held > 1]
    heads, places = [], []
    for order in range(ORDERS):
        head = {int(i): np.sort(prefixes[order][i]) for i in everyone}
        names, n = np.unique(np.concatenate(list(head.values())), return_counts=True)
        heads.append(head)
        places.append(names[n > 1])
    links = []
    step = max(1, min(512, (16 << 20) // max(1, len(tokens))))
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        row_heads = [matrix(rows, places[o], lambda i, o=o: heads[o][int(i)]) for o in range(ORDERS)]
        row_sets = None
        for b in range(0, len(right), step):
            cols = right[b : b + step]
            passed = cols[None, :] > rows[:, None] if left is right else np.ones((len(rows), len(cols)), bool)
            if not passed.any():
                continue
            small, large = np.minimum(sizes[rows][:, None], sizes[cols][None]), np.maximum(sizes[rows][:, None], sizes[cols][None])
            passed &= 100 * small >= percent * large
            for o in range(ORDERS):
                if passed.any():
                    passed &= (row_heads[o] @ matrix(cols, places[o], lambda i, o=o: heads[o][int(i)]).T) > 0
            if not passed.any():
                continue
            if row_sets is None:
                row_sets = matrix(rows, tokens, lambda i: sets[i])
            common = (row_sets @ matrix(cols, tokens, lambda i: sets[i]).T).astype(np.int64)
            similar = passed & (100 * common >= percent * (sizes[rows][:, None] + sizes[cols][None] - common))
            for i, j in zip(*np.nonzero(similar)):
                x, y = find(int(rows[i])), find(int(cols[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(rows[i]), int(cols[j])))
    return links


def gather(sets: DataFrame, most: int) -> DataFrame:
    """sets: rep, head0, head1, ... (prefix tokens by order). Returns rep, group: classes that can be linked are in one group; classes that can't be linked to any other are not listed. Groups of up to `most` classes are those of the first order; larger ones are gathered anew by the next."""
    groups, done = sets.select("rep", F.lit(0).cast("long").alias("group")), None
    for o in range(ORDERS):
        heads = sets.join(groups, "rep").select("rep", "group", F.explode(f"head{o}").alias("token"))
        stars = heads.groupBy("group", "token").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        edges = heads.join(stars, ["group", "token"]).select(F.col("rep").alias("a"), F.col("least").alias("b"))
        found = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("group"))
        large = found.groupBy("group").count().where(F.col("count") > most).select("group")
        if o + 1 == ORDERS or large.isEmpty():
            break
        small = found.join(large, "group", "left_anti")
        done = small if done is None else done.unionByName(small)
        groups = found.join(large, "group", "left_semi")
    return found if done is None else done.unionByName(found)


def spanning_links(sets: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """sets: rep, head0, head1, ... and body (the set). Links a, b that span every component of similar sets."""
    groups = gather(sets, group * SLICES)
    size = groups.join(sets.select("rep", F.length("body").cast("long").alias("bytes")), "rep").groupBy("group").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    slices = F.least(F.ceil(F.col("n") / group), F.greatest(F.lit(SLICES), F.ceil(F.col("bytes") / SLICE_BYTES))).cast("int")
    placed = sets.join(groups.join(size.select("group", slices.alias("slices")), "group"), "rep")
    placed = placed.withColumn("slice", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("slices")).cast("int"))
    names = [f"head{o}" for o in range(ORDERS)]
    dealt = placed.select("rep", "group", "slice", "body", *names, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("o"))
    dealt = dealt.select("rep", "group", "slice", "body", *names, F.least("slice", "o").alias("i"), F.greatest("slice", "o").alias("j"))
    schema = struct("a long, b long")
    out = arrow_schema(schema)

    def verify(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        table = table.take(order)
        reps, slices = table.column("rep").to_pylist(), table.column("slice").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("body").to_pylist()]
        prefixes = [[np.array(x, np.int64) for x in table.column(c).to_pylist()] for c in names]
        left = np.flatnonzero(slices == i)
        links = linked_pairs(sets, prefixes, percent, left, left if i == j else np.flatnonzero(slices == j)) if len(reps) > 1 else []
        return pa.table([pa.array([reps[x] for x, _ in links], pa.int64()), pa.array([reps[y] for _, y in links], pa.int64())], schema=out)

    return dealt.groupBy("group", "i", "j").applyInArrow(verify, schema)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the least key reachable by links)."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be an integer, as the least one names a component")
    kind = docs.schema[key].dataType.simpleString()
    blocks = make_blocks(docs, key, text)
    total = totals(blocks)
    parts, bits = parts_for(total), bits_for(total, 16)
    cut = ~_U64((1 << (64 - bits)) - 1)

    def distinct_sets(data):
        ids, texts = open_block(data)
        sets = shingle_sets(texts, n)
        return ids, sets, [xxh3_128_digest(s.tobytes()) for s in sets]

    def tokens_of(sets, digests):
        once = {d: s for s, d in zip(sets, digests)}  # equal sets of a block count once
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *once.values()]) & cut, return_counts=True)

    def question(lane, data):
        _, sets, digests = distinct_sets(data)
        keys, counts = tokens_of(sets, digests)
        yield keys, [counts.astype("<u4")]

    def answer(kind_, keys, payloads):
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([p[0] for p in payloads]))
        return np.split(np.floor(np.log2(counts)).astype(np.uint8)[place], np.cumsum([len(k) for k in keys])[:-1])

    def use(block, lane, data, replies):
        ids, sets, digests = distinct_sets(data)
        keys, _ = tokens_of(sets, digests)
        sent, rows, copies = set(), [], Counter(digests)
        for i, s, d in zip(ids, sets, digests):
            heads, body = [None] * ORDERS, None
            if len(s) and i is not None and d not in sent and can_link(len(s), percent):
                magnitude = replies[0][np.searchsorted(keys, s & cut)]
                first = [p[magnitude[p] > 0] for p in (prefix(s, magnitude, percent, o) for o in range(ORDERS))]
                if all(map(len, first)):  # else no other set can share a prefix token under every order
                    heads, body = [(s[p] & cut).view(np.int64).tolist() for p in first], s.tobytes()
                    sent.add(d)
            # sets too small for a link to any other may still have copies in other blocks: then none of their tokens stands in one block's set only
            linked = len(s) and i is not None and (d in sent or copies[d] > 1 or (not can_link(len(s), percent) and replies[0][np.searchsorted(keys, s & cut)].all()))
            rows.append((i, len(s), d if linked else None, *heads, body))
        return rows

    names = [f"head{o}" for o in range(ORDERS)]
    found = materialise(tell(blocks, ask(blocks, question, answer, ["<u4"], parts), f"k {kind}, n_shingles long, digest binary, {', '.join(f'{c} array<long>' for c in names)}, body binary", use, ["u1"]))
    discard(blocks)
    candidates = found.where("digest is not null")
    classes = materialise(candidates.groupBy("digest").agg(F.min("k").cast("long").alias("rep")))
    members = candidates.select("k", "digest").join(classes, "digest").select("k", "rep")
    bodies = candidates.where("body is not null").select("digest", F.col("k").alias("k0"), F.col("n_shingles").alias("size"), *names, "body")
    # one body for each class: any block's copy of it will do, so the one of the least key that brought one
    chosen = bodies.groupBy("digest").agg(F.min("k0").alias("k0"))
    sets = materialise(bodies.join(chosen, ["digest", "k0"]).dropDuplicates(["digest"]).join(classes, "digest").select("rep", "size", *names, "body"))
    joined = connected_components(spanning_links(sets, percent, group))
    roots = members.join(joined.withColumnsRenamed({"node": "rep", "component": "root"}), "rep", "left").select("k", F.coalesce("root", "rep").alias("root")).distinct()
    result = found.select("k", "n_shingles").join(roots, "k", "left")
    return result.select(F.col("k").alias(key), "n_shingles", F.coalesce(F.col("root").cast(kind), F.col("k")).alias("component_id"))
