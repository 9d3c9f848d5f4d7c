"""Approximate nearest neighbours: NN-descent builds the neighbour graph, greedy graph search answers the queries.

Graph: each vector starts with the nearest among the members of a few leaves; a leaf holds vectors on the same side of
some random hyperplanes through the middle of the table, so it is a region, and a crowded region is split by a hash.
Then, round by round, every vector's neighbours and reverse neighbours are joined to it with their vectors and compared
among each other: a neighbour of a neighbour that is nearer than the farthest known one replaces it. Only pairs with a
member new since the last round are compared. Rounds end when few lists change. Rounds run at every size of the table.
Vectors of one region have one home, and a vector that several centres of a home want is brought there once.

Search: a query starts at its own place in the graph; each hop joins the best unexpanded members of its beam with
their neighbours (both ways) and those with their vectors, until the beam has nothing left to expand. Distances are
Euclidean, in double precision on the original vectors, in the graph as well as in the search.

Lists are bounded as the method has it, by parameters: NEIGHBOURS forward links, as many reverse links in a round's
comparisons (which ones is drawn by hash, new ones first) and the nearest 2 * NEIGHBOURS reverse links in the search.

Equal vectors are one class, searched once and expanded at the end; of a class only its `top` + 2 least ids can be
among the `top` nearest, as ties go to the smaller id, so nothing is lost. Every valid vector is indexed.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, neither as query nor as candidate; a null id takes no part; of rows with one id the least vector counts.
With fewer candidates than asked for all are returned. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideflow.llm.common import arrow_schema, discard, materialise, session_of, struct

#: Neighbours kept; most rounds; share of changed entries at which rounds end.
NEIGHBOURS, ROUNDS, SETTLED = 32, 6, 0.05
#: Sets of start leaves, and the most vectors of a leaf; vectors of a home; vectors from which hyperplanes are put in the middle.
STARTS, LEAF, HOME, MIDDLE_ROWS = 10, 512, 2000, 4096
#: Beam of the search and members expanded in a hop; queries handled by one task; hops after which the search gives up with an error.
BEAM, WIDTH, TASK_QUERIES, MOST_HOPS = 160, 32, 200, 1000
#: Compared pairs held before the best of them are taken.
_HELD = 1 << 20


def _grouped(df: DataFrame, keys: list[str], fn, schema: T.StructType) -> DataFrame:
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        arrays = fn(*(table.column(c) for c in table.column_names))
        return pa.table([pa.array(a, f.type) for a, f in zip(arrays, out)], schema=out)

    return df.groupBy(*keys).applyInArrow(run, schema)


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _part(column: str, parts: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(3), column), F.lit(parts)).cast("int").alias("part")


def _best(u: np.ndarray, v: np.ndarray, d: np.ndarray, fresh: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest distinct v of each u; of repeats the one that is not fresh stays."""
    order = np.lexsort((fresh, v, u))
    u, v = u[order], v[order]
    once = np.ones(len(u), bool)
    once[1:] = (np.diff(u) != 0) | (np.diff(v) != 0)
    order, u = order[once], u[once]
    again = np.lexsort((v[once], d[order], u))
    order, u = order[again], u[again]
    first = np.flatnonzero(np.diff(u, prepend=u[0] - 1)) if len(u) else np.zeros(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    return order[rank < k]


def _distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)
    return np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * (x @ x.T), 0))


#: A link u -> v: its length, whether it is new, and the homes of both.
EDGE = "u long, v long, d double, fresh boolean, hu long, hv long"


def _merge(edges: DataFrame, k: int) -> DataFrame:
    def fn(u, v, d, fresh, hu, hv):
        u, v, d, fresh, hu, hv = (c.to_numpy() for c in (u, v, d, fresh, hu, hv))
        keep = _best(u, v, d, fresh, k)
        return u[keep], v[keep], d[keep], fresh[keep], hu[keep], hv[keep]

    return _grouped(edges.select("u", "v", "d", "fresh", "hu", "hv"), ["hu"], fn, struct(EDGE))


def leaves(vectors: DataFrame, count: int, starts: int, most: int, kind: str) -> DataFrame:
    """id, vector and `codes`: for each set of leaves the side of every one of its hyperplanes. A hyperplane has a random direction and stands in the middle of at most about MIDDLE_ROWS vectors chosen by hash."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / most)))))
    schema = struct("id long, full binary, codes array<long>")
    if not bits:
        return vectors.select("id", "full", F.array_repeat(F.lit(0).cast("long"), starts).alias("codes"))
    some = vectors.where(F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, MIDDLE_ROWS / count))).select("full").collect()
    x = np.array(sorted(np.frombuffer(r[0], kind).tolist() for r in some) or [np.frombuffer(vectors.first()["full"], kind).tolist()], float)
    scale = max(float(np.abs(x).max()), 1e-300)
    turns = np.random.default_rng(11).normal(size=(starts * bits, x.shape[1]))
    middle = np.median(x / scale @ turns.T, axis=0)
    out = arrow_schema(schema)

    def code(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                side = _matrix(pa.chunked_array([batch.column(1)]), kind).astype(float) / scale @ turns.T > middle
            codes = (side.reshape(len(side), starts, bits) << np.arange(bits)).sum(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.tolist(), pa.list_(pa.int64()))], schema=pa.schema([out.field(0), out.field(1), out.field(2)]))

    return vectors.select("id", "full").mapInArrow(code, schema)


def _split(df: DataFrame, region: list[str], most: int, name: str) -> DataFrame:
    """Add `name`, a hash that tells regions apart, and parts of a region that holds more than `most` rows."""
    sizes = df.groupBy(*region).agg(F.ceil(F.count("*") / most).alias("_pieces"))
    piece = F.pmod(F.xxhash64(F.lit(7), "id"), F.col("_pieces"))
    return df.join(sizes, region).withColumn(name, F.xxhash64(*region, piece)).drop("_pieces")


def neighbour_graph(vectors: DataFrame, count: int, k: int = NEIGHBOURS, rounds: int = ROUNDS, settled: float = SETTLED, kind: str = "<f4", starts: int = STARTS) -> DataFrame:
    """vectors: id, full (the vector's numbers, of numpy type `kind`). Returns u, v, d: about the k nearest v of each u."""
    leaf = min(LEAF, max(k + 1, count // 8))
    coded = materialise(leaves(vectors, count, starts, leaf, kind))
    homes = _split(coded.withColumn("region", F.element_at("codes", 1)), ["region"], HOME, "home").drop("region")
    homes = materialise(homes)
    discard(coded)
    at_home = homes.select("id", "home", "full")
    # the nearest half of a leaf's members are enough to begin with; the rounds find the others
    first = max(min(k, 8), k // 2)

    def start(_leaf, ident, home, full):
        ids, home, x = ident.to_numpy(), home.to_numpy(), _matrix(full, kind).astype(float)
        dist = _distances(x)
        np.fill_diagonal(dist, np.inf)
        m = min(first, len(ids) - 1)
        near = np.argpartition(dist, m, axis=1)[:, :m] if m < len(ids) - 1 else np.argsort(dist, axis=1)[:, :m]
        u = np.repeat(np.arange(len(ids)), m)
        v = near.reshape(-1)
        return ids[u], ids[v], dist[u, v], np.ones(len(u), bool), home[u], home[v]

    dealt = homes.select("id", "home", "full", F.posexplode("codes").alias("turn", "code"))
    dealt = _split(dealt, ["turn", "code"], leaf, "leaf").select("leaf", "id", "home", "full")
    graph = materialise(_merge(_grouped(dealt, ["leaf"], start, struct(EDGE)), k))
    schema = struct(EDGE)
    out = arrow_schema(schema)

    def compare(lists: pa.Table, brought: pa.Table) -> pa.Table:
        ids = brought.column("id").to_numpy()
        order = np.argsort(ids)
        ids, home, reach = ids[order], brought.column("home").to_numpy()[order], brought.column("reach").to_numpy()[order]
        x = _matrix(brought.column("full"), kind)[order]
        centre, member = lists.column("centre").to_numpy(), np.searchsorted(ids, lists.column("member").to_numpy())
        fresh = lists.column("fresh").to_numpy()
        order = np.lexsort((~fresh, member, centre))
        centre, member, fresh = centre[order], member[order], fresh[order]
        once = np.ones(len(centre), bool)
        once[1:] = (np.diff(centre) != 0) | (np.diff(member) != 0)
        centre, member, fresh = centre[once], member[once], fresh[once]
        edges = np.append(np.flatnonzero(np.diff(centre, prepend=centre[:1] - 1)), len(centre)) if len(centre) else np.zeros(0, np.int64)
        kept, held = [], 0

        def squeeze():
            nonlocal kept, held
            u, v, d = (np.concatenate([part[i] for part in kept]) for i in range(3))
            pair = u << 32 | v
            _, at = np.unique(pair, return_index=True)
            at = at[np.lexsort((d[at], u[at]))]
            first = np.flatnonzero(np.diff(u[at], prepend=-1))
            at = at[np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) < k]
            kept, held = [(u[at], v[at], d[at])], len(at)

        for a, b in zip(edges[:-1], edges[1:]):
            new = fresh[a:b]
            if b - a < 2 or not new.any():
                continue
            at = member[a:b]
            dist = _distances(x[at].astype(float))
            want = (new[:, None] | new[None]) & (dist < reach[at][:, None])
            np.fill_diagonal(want, False)
            i, j = np.nonzero(want)
            kept.append((at[i], at[j], dist[i, j]))
            held += len(i)
            if held > _HELD:
                squeeze()
                held = 0
        if not kept:
            return pa.table([pa.array([], f.type) for f in out], schema=out)
        squeeze()
        u, v, d = kept[0]
        return pa.table([pa.array(c, f.type) for c, f in zip((ids[u], ids[v], d, np.ones(len(u), bool), home[u], home[v]), out)], schema=out)

    for _ in range(rounds):
        ahead = graph.select(F.col("u").alias("centre"), F.col("hu").alias("home"), F.col("v").alias("member"), "fresh")
        back = graph.select(F.col("v").alias("centre"), F.col("hv").alias("home"), F.col("u").alias("member"), "fresh")
        turn = Window.partitionBy("centre").orderBy(F.col("fresh").desc(), F.xxhash64("centre", "member"))
        back = back.withColumn("n", F.row_number().over(turn)).where(F.col("n") <= k).drop("n")
        lists = materialise(ahead.unionByName(back))
        reach = graph.groupBy("u").agg(F.when(F.count("*") < k, F.lit(float("inf"))).otherwise(F.max("d")).alias("reach"))
        known = at_home.join(reach, at_home.id == reach.u).select("id", "home", "full", "reach")
        wanted = lists.select(F.col("home").alias("to"), F.col("member")).distinct()
        brought = wanted.join(known, wanted.member == known.id).select("to", "id", "home", "full", "reach")
        better = lists.select("home", "centre", "member", "fresh").groupBy("home").cogroup(brought.groupBy("to")).applyInArrow(compare, schema)
        before = graph
        graph = materialise(_merge(before.withColumn("fresh", F.lit(False)).unionByName(better), k))
        discard(before, lists)
        if graph.where("fresh").count() <= settled * k * count:
            break
    discard(homes)
    return graph.select("u", "v", "d")


def greedy_search(vectors: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, width: int = WIDTH, k: int = NEIGHBOURS, kind: str = "<f4", most_hops: int = MOST_HOPS, looked: Accumulator | None = None) -> DataFrame:
    """vectors: id, full (the original's numbers). queries: q, the ids to start from. Returns q, node, d: what each query has looked at. looked counts the distances computed."""
    parts = max(12, -(-queries.count() // TASK_QUERIES))
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d").withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("n") <= 2 * k).drop("n", "d")
    ways = materialise(graph.select("u", "v").unionByName(back).groupBy("u").agg(F.collect_set("v").alias("to")))
    state_schema = struct("q long, node long, d double, open boolean, next boolean, held boolean, new boolean")
    asked = materialise(queries.join(vectors, queries.q == vectors.id).select("q", F.col("full").alias("query")))

    def visit(part, q, node, d, open_, full, query):
        # rows without a node only bring their query's vector; rows with a vector are the new ones
        given = np.flatnonzero(query.is_valid().to_numpy())
        names, rows = q.to_numpy()[given], node.is_valid()
        asked_by = _matrix(query.drop_null(), kind).astype(np.float64)[np.argsort(names)]
        names = np.sort(names)
        q, d, open_, fresh = (c.filter(rows).to_numpy() for c in (q, d, open_, full.is_valid()))
        node, d, open_ = node.drop_null().to_numpy(), d.copy(), open_.copy()
        x, wanted = _matrix(full.drop_null(), kind), np.flatnonzero(fresh)
        for a in range(0, len(wanted), 4096):
            at = wanted[a : a + 4096]
            d[at] = np.sqrt(((x[a : a + 4096].astype(np.float64) - asked_by[np.searchsorted(names, q[at])]) ** 2).sum(1))
        if looked is not None:
            looked.add(len(wanted))
        # the nearest `beam` of a query are its beam; what falls out of it never comes back, so a hop passes on the beam, and besides it tells only the nodes it was the first to look at
        order = np.lexsort((node, d, q))
        q, node, d, open_, fresh = q[order], node[order], d[order], open_[order], fresh[order]
        first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1))
        held = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < beam
        open_ &= held
        chosen = np.zeros(len(q), bool)
        at = np.flatnonzero(open_)
        if len(at):
            first = np.flatnonzero(np.diff(q[at], prepend=q[at[0]] - 1))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            chosen[at[rank < width]] = True
        open_[chosen] = False
        told = held | fresh
        return q[told], node[told], d[told], open_[told], chosen[told], held[told], fresh[told]

    def evaluate(state: DataFrame, fresh: DataFrame) -> DataFrame:
        """Merge rows (q, node) into the beams."""
        new = fresh.join(vectors, fresh.node == vectors.id).select("q", "node", F.lit(None).cast("double").alias("d"), F.lit(True).alias("open"), "full")
        rows = state.select("q", "node", "d", "open", F.lit(None).cast("binary").alias("full")).unionByName(new).select("q", "node", "d", "open", "full", F.lit(None).cast("binary").alias("query"))
        marks = asked.select("q", F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("d"), F.lit(False).alias("open"), F.lit(None).cast("binary").alias("full"), "query")
        return materialise(_grouped(rows.unionByName(marks).select(_part("q", parts), "q", "node", "d", "open", "full", "query"), ["part"], visit, state_schema))

    empty = asked.where("false").select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("open"))
    tables = [evaluate(empty, asked.select("q", F.col("q").alias("node")))]
    seen = tables[0].where("new").select("q", "node", "d")  # every node that was looked at, once, so that none is looked at twice
    while not (state := tables[-1]).where("next").isEmpty():
        if len(tables) > most_hops:
            raise RuntimeError(f"the search has not ended after {most_hops} hops")
        step = state.where("next").select("q", F.col("node").alias("u")).join(ways, "u").select("q", F.explode("to").alias("node")).distinct()
        fresh = step.join(seen.select("q", "node"), ["q", "node"], "left_anti")
        tables.append(evaluate(state.where("held"), fresh))
        seen = seen.unionByName(tables[-1].where("new").select("q", "node", "d"))
    discard(ways, asked)
    return seen


def number_kind(table: DataFrame, vector: str) -> str:
    return "<f8" if table.schema[vector].dataType.simpleString() == "array<double>" else "<f4"


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id, size, full: those rows that take part, with the vector's numbers packed: 8-byte floats for an array of doubles, else 4-byte floats."""
    fit = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"))
    kind = number_kind(table, vector)
    schema = struct("id long, size int, full binary")
    out = arrow_schema(schema)

    def pack(batches):
        for batch in batches:
            ids, sizes, packed = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x and None not in x:
                    v = np.array(x, kind)
                    if np.isfinite(v).all() and v.any():
                        ids.append(i)
                        sizes.append(len(v))
                        packed.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, sizes, packed), out)], schema=out)

    return fit.mapInArrow(pack, schema)


def nearest(table: DataFrame, is_query: F.Column, key: str = "vec_id", vector: str = "embedding", top: int = 10, looked: Accumulator | None = None) -> DataFrame:
    """Of each query row the `top` nearest other rows that are found: query_id, rank (from 1), vec_id, score (distance). looked counts the distances that the search computes."""
    session_of(table)
    rows = materialise(valid_vectors(table, key, vector).groupBy("id").agg(F.min(F.struct("size", "full")).alias("x")).select("id", "x.size", "x.full"))
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return table.sparkSession.createDataFrame([], struct(f"query_id long, rank int, {key} long, score double"))
    rows = rows.where(F.col("size") == usual[0])
    classes = rows.groupBy("full").agg(F.min("id").alias("rep"))
    members = materialise(rows.join(classes, "full").select("id", "rep", "full"))
    reps = materialise(members.where("id = rep").select("id", "full"))
    kind = number_kind(table, vector)
    graph = neighbour_graph(reps, reps.count(), kind=kind)
    asked = materialise(members.join(table.where(is_query & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "rep"))
    beams = greedy_search(reps, graph, asked.select(F.col("rep").alias("q")).distinct(), kind=kind, looked=looked)
    few = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= top + 2).select(F.col("rep").alias("node"), "id")
    near = beams.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))).where(F.col("n") <= top + 1).drop("n")
    found = asked.join(near, asked.rep == near.q).join(few, "node").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    return found.select("query_id", rank.alias("rank"), F.col("id").alias(key), F.col("d").alias("score")).where(F.col("rank") <= top)
