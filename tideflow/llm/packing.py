"""Best-fit packing by a configuration linear program.

Documents are encoded, closed by an end id, and cut into pieces of at most `capacity` tokens. The histogram of piece
lengths (at most `capacity` bins, whatever the input's size) is all the driver gets. Over it stands the configuration
program: a configuration is a multiset of lengths that fits one sequence and is there in the histogram; cover all pieces
with the fewest configurations. It is solved by multiplicative weights: each round prices the lengths, a bounded
knapsack dynamic program finds the best configurations at those prices, and prices of what they cover fall. The
fractional solution is rounded down; the program of what is left is solved again, and so on; where rounding down leaves
little, configurations with the largest pieces are used once each, as far as the pieces last, until half of what is
left is placed; then comes the next solution. Every sequence comes from a configuration that the program has found.

The plan is a table of slots: the n-th piece of a length (n: a rank made of counts by task and length, so that no
length meets in one task) goes to a known sequence and offset. Its size depends on `capacity` and the rounds alone.

Defined results: a null or empty text is one piece, the end id. A null doc_id is packed like any other. Repeated rows
are packed each. An empty table gives an empty result. Extra columns are ignored; texts are encoded whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideflow.llm.byte_tokens import load
from tideflow.llm.common import map_rows, materialise, struct

CAPACITY = 2048
ROUNDS = 30


def price_knapsack(prices: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, Callable[[int], Counter]]:
    """Bounded knapsack: the largest total price for each room, and a function that gives a room's best configuration as times by index of length."""
    which, times = [], []
    for i, most in enumerate(np.minimum(counts, capacity // lengths).tolist()):
        k = 1
        while most > 0:  # 1, 2, 4, ... copies and the rest: any number up to the bound is a sum of some
            which.append(i)
            times.append(min(k, most))
            most -= k
            k *= 2
    best, took = np.zeros(capacity + 1), np.zeros((len(which), capacity + 1), bool)
    gains, widths = (np.array(times) * prices[which]).tolist(), (np.array(times) * lengths[which]).tolist()
    for row, gain, width in zip(took, gains, widths):
        more = best[:-width] + gain
        np.greater(more, best[width:], out=row[width:])
        np.maximum(more, best[width:], out=best[width:])
    took = np.ascontiguousarray(took.T)

    def configuration(room: int) -> Counter:
        found, upto = Counter(), len(which)
        while len(last := np.flatnonzero(took[room, :upto])):
            upto = int(last[-1])
            found[which[upto]] += times[upto]
            room -= widths[upto]
        return found

    return best, configuration


def fractional_cover(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = 0.5, slack: float = 0.01) -> dict[tuple[int, ...], float]:
    """The configuration program by multiplicative weights: configurations, and how often each is used, in fractions that in all hold as many tokens as there are."""
    lengths = np.array(sorted(counts))
    there = np.array([counts[int(n)] for n in lengths])
    demand, log_price = there.astype(float), np.log(lengths / capacity)  # the prices of the volume bound
    used: Counter = Counter()
    for _ in range(rounds):
        prices = np.exp(log_price - log_price.max())
        best, configuration = price_knapsack(prices, lengths, there, capacity)
        value = prices + best[capacity - lengths]  # of the best configuration with each length
        moved = np.zeros(len(lengths))
        for first in [None, *np.argsort(-value, kind="stable").tolist()]:
            if first is None:  # the best of all
                items = configuration(capacity)
            elif value[first] < (1 - slack) * best[capacity]:
                break
            elif moved[first] >= 1:
                continue
            else:
                items = configuration(capacity - int(lengths[first]))
                items[first] += 1
            at, k = (np.fromiter(x, np.int64, len(items)) for x in (items.keys(), items.values()))
            if (k > there[at]).any() or moved[at].max() >= 1:
                continue
            times = float((demand[at] / k).min())
            used[tuple(np.sort(np.repeat(lengths[at], k))[::-1].tolist())] += times
            share = k * times / demand[at]
            moved[at] += share
            log_price[at] -= step * share
        log_price = np.maximum(log_price, log_price.max() - 40)
    scale = float((lengths * demand).sum()) / sum(t * sum(c) for c, t in used.items())
    return {c: t * scale for c, t in used.items()}


def solve_configurations(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used; together they hold every piece of the histogram exactly once."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(config: tuple[int, ...], most: int) -> int:
        each = Counter(config)
        if (times := min(most, *(left[n] // k for n, k in each.items()))) > 0:
            plan.append((config, times))
            for n, k in each.items():
                left[n] -= k * times
        return times

    if full := left.pop(capacity, 0):
        plan.append(((capacity,), full))
    while left := +left:
        cover = fractional_cover(left, capacity, rounds)
        order = sorted(cover, key=lambda c: (-cover[c], c))
        whole = sum(use(config, int(cover[config])) for config in order)
        rest = -(-sum(n * c for n, c in left.items()) // capacity)
        if 4 * whole < rest:  # the largest pieces are the hardest to place later
            some = -(-rest // 2)
            for config in sorted(order, key=lambda c: (-c[0], -sum(c), -cover[c])):
                if some > 0:
                    some -= use(config, 1)
        rounds = max(20, rounds // 4)
    return plan


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """length -> first ranks, and for each (first rank, first sequence, offset): rank r lies in sequence first + r - first rank."""
    slots: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for config, times in plan:
        offset = 0
        for n in config:
            starts, where = slots.setdefault(n, ([], []))
            starts.append(ranks[n])
            where.append((ranks[n], sequence, offset))
            ranks[n] += times
            offset += n
        sequence += times
    return slots


def cut_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the task, and how many pieces of that length came before in it."""

    def make():
        encode, end = load(path), int(end_id).to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), Counter()

        def fn(ids, texts):
            rows = []
            for key, text in zip(ids, texts):
                data = encode(text) + end
                total = len(data) // 4
                first = total % capacity or capacity
                at = 0
                for piece in range(-(-total // capacity)):
                    size = first if not piece else capacity
                    rows.append((key, piece, at, size, zlib.crc32(data[4 * at : 4 * (at + size)]), part, seen[size]))
                    seen[size] += 1
                    at += size
            return list(map(list, zip(*rows))) if rows else [[]] * 7

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], struct(f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"), make)


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(cut_pieces(docs, path, end_id, capacity))
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = by_task.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}
    slots_b = docs.sparkSession.sparkContext.broadcast(slot_table(solve_configurations(counts, capacity, rounds)))
    ranked = pieces.join(earlier, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))

    def make():
        from bisect import bisect_right

        slots = slots_b.value

        def fn(ids, piece, start, length, crc, rank):
            sequence, offset = [], []
            for n, r in zip(length, rank):
                starts, where = slots[n]
                first, seq, off = where[bisect_right(starts, r) - 1]
                sequence.append(seq + r - first)
                offset.append(off)
            return [ids, piece, start, length, crc, sequence, offset]

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(ranked, ["doc_id", "piece", "start", "length", "ids_crc32", "rank"], struct(f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"), make)
