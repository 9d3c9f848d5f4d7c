"""Golden examples, laws and edge cases on literal inputs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tideflow.operators as op
from tideflow import sources
from tideflow.flow import OrderedFlow, flow
from tideflow.functions.errors import DROP, RetryStrategy, exponential_backoff, retry, substitute
from tideflow.functions.hashing import fnv1a32
from tideflow.plans import ordered
from tideflow.plans.fold import ordered_fold


def ints(spark, values):
    return sources.from_rows(spark, list(values), "value long")


def out(f, column="value"):
    return [r[column] for r in f.df.orderBy(*f.order_by).select(column).collect()]


def windows(f, key):
    got = {}
    for r in f.df.orderBy(*f.order_by).collect():
        got.setdefault(r[key], []).append(r["value"])
    return [got[k] for k in sorted(got)]


def test_batches(spark):
    assert windows(op.batch(ints(spark, range(1, 6)), count=2), "batch") == [[1, 2], [3, 4], [5]]
    assert windows(op.batch(ints(spark, range(1, 8)), count=3, drop_partial=True), "batch") == [[1, 2, 3], [4, 5, 6]]
    words = sources.from_rows(spark, ["abc", "def", "gh"], "value string")
    assert windows(op.batch(words, measure=F.length("value"), limit=6), "batch") == [["abc", "def"], ["gh"]]
    with pytest.raises(ValueError):
        op.batch(words)
    timed = sources.from_rows(spark, [(0, 1), (1, 2), (2, 3), (11, 4), (12, 5)], "t long, value long")
    assert windows(op.batch(timed, count=2, every=10, time="t"), "batch") == [[1, 2], [3], [4, 5]]


def test_sliding(spark):
    assert windows(op.sliding_window(ints(spark, range(1, 6)), 3, 1), "window") == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert windows(op.sliding_window(ints(spark, [1, 2]), 3, 1), "window") == []
    with pytest.raises(ValueError):
        op.sliding_window(ints(spark, [1]), 2, 3)


def test_chunks(spark):
    assert windows(op.chunk_by(ints(spark, [1, 1, 2, 2, 1]), "value"), "chunk") == [[1, 1], [2, 2], [1]]
    assert windows(op.chunk_by(ints(spark, [None, None, 2]), "value"), "chunk") == [[None, None], [2]]
    assert windows(op.chunk_while(ints(spark, [1, 2, 3, 1, 2]), "value", lambda a, b: b > a), "chunk") == [[1, 2, 3], [1, 2]]


def test_dedupe(spark):
    assert out(op.dedupe(ints(spark, [1, 2, 3, 1, 4]), "value", 3)) == [1, 2, 3, 4]
    assert out(op.dedupe(ints(spark, [1, 1, 2, 1]), "value", 1)) == [1, 2, 1]
    assert out(op.dedupe(ints(spark, [2, 1, 2, None, None]), "value")) == [2, 1, None]
    seen = ints(spark, [2]).df.select("value")
    assert out(op.dedupe(ints(spark, [1, 2, 3]), "value", seen=seen)) == [1, 3]
    timed = sources.from_rows(spark, [("a", 0), ("a", 5), ("a", 11), ("a", 20)], "k string, value long")
    assert out(op.ttl_dedupe(timed, "k", "value", 10)) == [0, 11]
    bloom = op.BloomSet(100, 0.01)
    bits = bloom.built(ints(spark, range(50)).df, "value")
    kept = out(bloom.reject_seen(ints(spark, range(40, 100)), bits, "value"))
    assert set(kept) <= set(range(50, 100)) and len(kept) > 40


def test_bloom_of_more_keys_than_it_was_made_for(spark):
    """Every bit of so full a filter is set, so it lets all through; the exact lookup brings back what is not in the set."""
    keys = ints(spark, [*range(500), None]).df.select("value")
    full = op.BloomSet(1, 0.01)
    rows = ints(spark, [*range(490, 1000), None])
    assert out(full.reject_seen(rows, full.built(keys, "value"), "value")) == []
    assert out(full.reject_seen(rows, full.built(keys, "value"), "value", exact=keys)) == list(range(500, 1000))
    assert op.BloomSet.sized(keys, "value", 0.01).bits == op.BloomSet(501, 0.01).bits
    assert op.BloomSet.sized(keys.where("false"), "value", 0.01).bits == op.BloomSet(1, 0.01).bits


def test_positions(spark):
    f = ints(spark, range(7))
    assert out(op.take_every(f, 3)) == [0, 3, 6]
    assert out(op.drop_every(f, 3)) == [1, 2, 4, 5]
    assert out(op.drop_last(f, 2)) == [0, 1, 2, 3, 4]
    assert out(op.take(f, 0)) == [] and out(op.take(f, 99)) == list(range(7)) and out(op.drop(f, 99)) == []
    assert out(op.pairwise(ints(spark, range(1, 5)), "value"), "prev_value") == [1, 2, 3]
    assert out(op.pairwise(ints(spark, [1]), "value")) == []
    for bad in (lambda: op.take_every(f, 0), lambda: op.balance(f, 1), lambda: op.map_every(f, 0), lambda: op.dedupe(f, "value", -1)):
        with pytest.raises(ValueError):
            bad()


def test_intersperse_and_ends(spark):
    f = ints(spark, [1, 2, 3])
    assert out(op.intersperse(f, value=F.lit(0).cast("long"))) == [1, 0, 2, 0, 3]
    assert out(op.end_with(f, ints(spark, [4, 5]))) == [1, 2, 3, 4, 5]
    assert out(op.start_with(f, ints(spark, [0]))) == [0, 1, 2, 3]
    none = sources.empty(spark, "value long")
    assert out(op.default_if_empty(none, ints(spark, [9]).df)) == [9]
    assert out(op.default_if_empty(f, ints(spark, [9]).df)) == [1, 2, 3]
    assert op.reduce(none, "s", F.sum("value"), 7).first()["s"] == 7


def test_maps(spark):
    words = sources.from_rows(spark, ["a", "b", "a"], "value string")
    assert op.to_map(op.map_columns(words, n=F.length("value")), "n", "value", as_map=True).first()["map"] == {1: "a"}
    assert op.frequencies(words, "value", as_map=True).first()["map"] == {"a": 2, "b": 1}
    counts = op.running_frequencies(words, "value", ["a", "b"])
    assert out(counts, "counts") == [{"a": 1}, {"a": 1, "b": 1}, {"a": 2, "b": 1}]
    assert [r["i"] for r in op.group_by(words, "value").orderBy("value").select(F.col("items.pos").alias("i")).collect()] == [[0, 2], [1]]


def test_expand(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (2, 5), (5, 1)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "node long")
    order = lambda df: [r["node"] for r in df.orderBy("depth", "node").collect()]
    assert order(op.expand_map(roots, edges, visited_by=True)) == [1, 2, 3, 4, 5]
    assert order(op.expand_map(roots, edges, max_depth=1)) == [1, 2, 3]
    assert order(op.expand_map(roots, edges, max_items=2)) == [1, 2]
    assert order(op.expand_map(roots, edges, max_items=7)) == [1, 2, 3, 4, 5, 1, 2]  # a cycle goes on until a bound
    diamond = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "parent long, child long")
    assert order(op.expand_map(roots, diamond)) == [1, 2, 3, 4, 4, 5, 5]
    assert order(op.expand_map(roots, diamond, visited_by=True)) == [1, 2, 3, 4, 5]
    assert order(op.expand_map(roots, edges, visited=spark.createDataFrame([(2,)], "node long"))) == [1, 3]


def test_sources(spark):
    assert out(sources.unfold(spark, "named_struct('a', 0L, 'b', 1L)", "s.a", "named_struct('a', s.b, 'b', s.a + s.b)", "s.a < 14", 99)) == [0, 1, 1, 2, 3, 5, 8, 13]
    assert out(sources.iterate(spark, "1L", "s * 2", 5)) == [1, 2, 4, 8, 16]
    assert out(sources.iterate(spark, "0L", "s + 1", 150)) == list(range(150))
    with pytest.raises(Exception, match="has not ended after 6"):
        out(sources.unfold(spark, "0L", "s", "s + 1", "s < 7", 6))
    assert out(sources.unfold(spark, "0L", "s", "s + 1", "s < 6", 6)) == list(range(6))
    parts = sources.generate_in_parts(spark, 3, lambda part: iter(range(part)), "value long")
    assert out(parts) == [0, 0, 1]
    assert out(sources.cycle(spark, ["a", "b", "c"], 7)) == list("abcabca")
    with pytest.raises(ValueError):
        sources.cycle(spark, [], 1)
    released = []
    with sources.using(lambda: 3, lambda n: spark.range(n), released.append) as df:
        assert df.count() == 3
    assert released == [3]


def test_files_and_sqlite(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    sources.write_csv(df, f"{tmp_path}/c")
    assert sources.read_csv(spark, f"{tmp_path}/c", "a long, b string", header=True).count() == 2
    sources.write_json(df, f"{tmp_path}/j")
    assert sources.read_json(spark, f"{tmp_path}/j", "a long, b string").where("a = 2").first()["b"] == "y"
    sources.write_lines(df, "b", f"{tmp_path}/l")
    assert {r.value for r in sources.read_lines(spark, f"{tmp_path}/l").collect()} == {"x", "y"}
    import sqlite3

    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE t (a, b)")
    assert sources.sqlite_insert(df, f"{tmp_path}/s.db", "t") == 2
    assert sources.sqlite_query(spark, f"{tmp_path}/s.db", "SELECT a, b FROM t", "a long, b string").count() == 2
    pages = {"u1": '{"items": [1, 2], "next": "u2"}', "u2": '{"items": [3], "next": ""}'}
    assert sources.http_pages(spark, "u1", pages.get, lambda p: p["items"], lambda p: p["next"], "n long").count() == 3


def test_notifications(spark):
    f = ints(spark, [1, 2])
    assert out(op.dematerialize(op.materialize(f))) == [1, 2]
    with pytest.raises(Exception, match="broken"):
        op.dematerialize(op.materialize(f, error="broken")).df.collect()


def test_errors_and_effects(spark):
    f = ints(spark, [1, 0, 2])
    half = lambda r: (10 // r.value,)
    assert sorted(r.q for r in op.map_python(f, half, "q long", DROP).collect()) == [5, 10]
    assert sorted(r.q for r in op.map_python(f, half, "q long", substitute((-1,))).collect()) == [-1, 5, 10]
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError("again")
        return x

    assert retry(2).run(flaky, 7) == (True, 7)
    assert exponential_backoff(1, 5)(4) == 5
    keyed = sources.from_rows(spark, [("a", 1), ("a", 2), ("", 3), ("b", 0)], "k string, value long")
    done = op.effect(keyed, lambda r: 10 // r.value, op.EffectPolicy(key="k"))
    got = [(r.applied, r.deduped, r.err is not None) for r in done.df.orderBy("pos").collect()]
    assert got == [(True, False, False), (False, True, False), (True, False, False), (False, False, True)]
    ok, bad = op.try_effect(keyed, lambda r: 10 // r.value)
    assert (ok.df.count(), bad.df.count()) == (3, 1)
    assert op.effect(keyed, half, op.EffectPolicy(dry=True)).df.where("applied or err is not null").count() == 0
    seen = []
    assert op.run(lambda: None, [(bad.df, op.best_effort())], [seen.append]).outcome == "partial_success" and len(seen) == 1
    assert op.run(lambda: 1 / 0).outcome == "failure" and op.run(lambda: None, [(bad.df, op.EffectPolicy())]).outcome == "failure"
    tries = []

    def twice():
        tries.append(1)
        if len(tries) < 2:
            raise OSError
        return 5

    assert op.retry_run(twice, RetryStrategy(3)) == 5
    assert op.catch(lambda: spark.range(3).selectExpr("raise_error('x')"), lambda e: spark.range(2)).count() == 2


def test_composition(spark, tmp_path):
    stage = op.then(lambda f: op.filter_rows(f, F.col("value") > 1), lambda f: op.take(f, 1))
    assert out(op.through(ints(spark, [1, 2, 3]), stage)) == [2]
    assert out(ints(spark, [1, 2, 3]).take(2)) == [1, 2]
    store = op.SnapshotStore(str(tmp_path))
    named = op.segment("s", stage, store)
    assert out(named(ints(spark, [1, 2, 3]))) == [2] and out(named(ints(spark, [9]))) == [2]
    assert op.from_checkpoint(spark, store, "s").count() == 1
    with pytest.raises(FileNotFoundError):
        op.from_checkpoint(spark, store, "none")
    other = op.or_else(lambda f: op.ignore_elements(f), lambda f: f)
    assert out(other(ints(spark, [4]))) == [4]
    seen = []
    handle = op.run_async(lambda: spark.range(4).count(), [seen.append])
    summary, error = handle.wait(60)
    assert (handle.value, summary.outcome, error, handle.done(), len(seen)) == (4, "success", None, True, 1)
    failed = op.run_async(lambda: 1 / 0)
    assert failed.wait(60)[0].outcome == "failure" and "ZeroDivisionError" in failed.err() and failed.summary().error
    with pytest.raises(AttributeError):  # a mistake in the stage's own code is no failure of the engine
        op.or_else(lambda f: f.nothing, lambda f: f)(ints(spark, [4]))
    broken = op.or_else(lambda f: op.map_columns(f, value=F.raise_error(F.lit("x"))), lambda f: f)
    assert out(broken(ints(spark, [4]))) == [4]
    nested = op.segment("outer", op.segment("inner", lambda f: f))
    nested(ints(spark, [1]))
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None
    assert [n["python"] for n in op.describe(op.map_python(ints(spark, [1]), lambda r: (1,), "v long"))].count(True) == 1
    assert op.is_native(op.running_sum_by(ints(spark, [1]), "value", value=F.lit(1)).df)
    assert op.run_all(lambda: 1, lambda: 2) == [1, 2]


def test_state(spark):
    timed = sources.from_rows(spark, [("a", 0), ("a", 5), ("b", 6), ("a", 30)], "k string, value long")
    key = op.Key("n", 0, ttl=10)
    got = op.map_with_key(timed, "k", key, lambda ref, r: (r.pos, ref.update_and_get(lambda n: n + 1)), "pos long, n long", time="value")
    assert [r.n for r in got.orderBy("pos").collect()] == [1, 2, 1, 1]
    assert out(op.running_with_ttl(timed, "k", "value", 10, "n", "count", F.lit(1)), "n") == [1, 2, 1, 1]


def test_state_between_runs(spark, tmp_path):
    store, key = op.StateTable(f"{tmp_path}/state"), op.Key("n", 0)
    run = lambda rows: sorted((r.k, r.n) for r in op.map_with_key(sources.from_rows(spark, rows, "k string"), "k", key, lambda ref, r: (r.k, ref.update_and_get(lambda n: n + 1)), "k string, n long", columns=["k"], store=store).collect())
    assert run(["a", "b", "a"]) == [("a", 1), ("a", 2), ("b", 1)]
    assert run(["c", "a"]) == [("a", 3), ("c", 1)]
    assert run(["b"]) == [("b", 2)]  # kept through a run that did not meet it
    import json

    whole = op.StateTable(f"{tmp_path}/whole", lambda cell: json.dumps(cell).encode(), json.loads)
    total = lambda values: out(OrderedFlow(op.map_with(ints(spark, values), key, lambda ref, r: (r.pos, ref.update_and_get(lambda n: n + r.value)), "pos long, n long", store=whole), ("pos",)), "n")
    assert total([1, 2]) == [1, 3] and total([10]) == [13]


def test_time(spark):
    twice = sources.from_rows(spark, [("a", 0), ("a", 9), ("a", 10), ("a", 20), ("b", 5)], "k string, value long")
    assert out(op.ttl_dedupe(twice, "k", "value", 10)) == [0, 10, 20, 5]  # a key passes again at ttl itself
    none = sources.from_rows(spark, [(None, 0), (None, 3)], "k string, value long")
    assert out(op.ttl_dedupe(none, "k", "value", 10)) == [0]
    slow = sources.from_rows(spark, [(0, False), (10, True), (40, True), (50, True), (51, True)], "value long, ok boolean")
    assert out(op.circuit_breaker(slow, "value", "ok", threshold=1, cooldown=10, probes=2, half_open_timeout=20), "state") == ["closed", "half-open", "open", "half-open", "half-open"]
    f = sources.from_rows(spark, [0, 1, 5, 6, 20], "value long")
    assert out(op.throttle(f, "value", 5)) == [0, 5, 20]
    assert out(op.debounce(f, "value", 4)) == [1, 6, 20]
    assert out(op.rate_limit(f, "value", 1, burst=1, unit=5)) == [0, 5, 20]
    assert out(op.rate_limit(f, "value", 1, burst=1, mode="wait", unit=5), "emit_at") == [0, 5, 10, 15, 20]
    calls = sources.from_rows(spark, [(0, False), (1, False), (2, True), (12, True), (13, True)], "value long, ok boolean")
    assert out(op.circuit_breaker(calls, "value", "ok", threshold=2, cooldown=10), "state") == ["closed", "closed", "open", "half-open", "closed"]


def test_combination(spark):
    a = sources.from_rows(spark, [(1, "x"), (4, "y")], "t long, value string")
    b = sources.from_rows(spark, [(2, "p"), (3, "q"), (9, "r")], "t long, value string")
    assert [(r.value, r.other.value) for r in op.latest_from(a, b, "t").df.collect()] == [("y", "q")]
    pairs = op.combine_latest(a, b, "t").df.orderBy("t").collect()
    assert [(r.first.value, r.second.value) for r in pairs] == [("x", "p"), ("x", "q"), ("y", "q"), ("y", "r")]
    zipped = op.zip_flows(a, b).df.orderBy("idx").collect()
    assert [(r.a_value, r.b_value) for r in zipped] == [("x", "p"), ("y", "q")]
    assert op.sequence_equal(a, a, "value").first()["equal"] and not op.sequence_equal(a, b, "value").first()["equal"]
    found = op.lookup_with(a, "value", lambda keys: {k: (len(keys),) for k in keys if k == "x"}, "n long")
    assert sorted((r.value, r.n) for r in found.df.collect() if r.n) == [("x", 2)]


def test_rows_of_equal_times_come_in_the_order_of_their_key(spark, monkeypatch):
    a = flow(spark.createDataFrame([(1, 5), (1, 3), (2, 9), (4, 11)], "t long, id long"), "t", "id")
    b = flow(spark.createDataFrame([(1, 4), (2, 8), (2, 7), (3, 10)], "t long, id long"), "t", "id")
    by_key = [(3, 4), (5, 4), (5, 7), (5, 8), (9, 8), (9, 10), (11, 10)]
    by_side = [(5, 4), (9, 4), (9, 7), (9, 8), (9, 10), (11, 10)]
    latest = [(3, 4), (5, 4), (9, 8), (11, 10)]
    for most in (ordered.ONE_RANGE, -1):
        monkeypatch.setattr(ordered, "ONE_RANGE", most)
        pairs = lambda f: [(r.first.id, r.second.id) for r in f.df.orderBy(*f.order_by).collect()]
        assert pairs(op.combine_latest(a, b, "t")) == by_key
        assert pairs(op.combine_latest(a.ordered("id"), b.ordered("id"), "t")) == by_side
        assert sorted((r.id, r.other.id) for r in op.latest_from(a, b, "t").df.collect()) == latest
        assert sorted((r.tick, r.id) for r in op.sample_with(a, b, "t").df.collect()) == [(0, 5), (1, 9)]


def test_deadlines_supervision_and_defaults(spark, tmp_path):
    import time

    from tideflow.functions.errors import HALT, OnError, Supervision, set_error_strategy
    from tideflow.testkit import TestClock, fail_at, fail_every, slowly

    f = ints(spark, [1, 2, 3, 4])
    keep = lambda r: (r.value,)
    values = lambda df: sorted(r.v for r in df.collect())
    late = lambda r: (time.sleep(5 if r.value == 3 else 0), (r.value,))[1]
    assert values(op.map_python(f, late, "v long", DROP, timeout=0.5)) == [1, 2, 4]
    assert OnError("substitute", (0,)).run(slowly(keep, 5), None, 0.05) == (True, (0,))
    with pytest.raises(Exception, match="failed as asked"):
        op.map_python(f, fail_at(keep, lambda r: r.value == 2), "v long").collect()
    before = set_error_strategy(DROP)
    try:
        assert before == HALT and values(op.map_python(f, fail_at(keep, lambda r: r.value == 2), "v long")) == [1, 3, 4]
    finally:
        set_error_strategy(before)
    one = f.with_df(f.df.coalesce(1))
    assert values(op.map_python(one, fail_every(keep, 2), "v long", supervise=Supervision(2))) == [1, 3]
    with pytest.raises(Exception, match="failed as asked"):
        op.map_python(one, fail_every(keep, 2), "v long", supervise=Supervision(1)).collect()
    assert values(op.map_python(one, fail_every(keep, 2), "v long", supervise=Supervision(skip=(ValueError,)))) == [1, 3]
    slow = op.effect(f, slowly(keep, 5), op.EffectPolicy(attempt_timeout=0.05))
    assert slow.df.where("err like 'took longer%'").count() == 4
    with op.dry_run():
        assert op.effect(f, keep).df.where("applied").count() == 0
    now = TestClock(100.0)
    cache, asked = op.CacheTable(f"{tmp_path}/cache", ("value",), ttl=10, clock=now), []

    def compute(keys):
        asked.append(sorted(r.value for r in keys.collect()))
        return keys.withColumn("sq", F.col("value") * F.col("value"))

    assert out(op.map_cached(ints(spark, [1, 2, 1]), ["value"], compute, cache), "sq") == [1, 4, 1]
    assert out(op.map_cached(ints(spark, [2, 3]), ["value"], compute, cache), "sq") == [4, 9]
    now.advance(11)
    assert out(op.map_cached(ints(spark, [2]), ["value"], compute, cache), "sq") == [4]
    assert asked == [[1, 2], [3], [2]]
    sizes = op.map_batches(one, lambda pdf: pdf.assign(n=len(pdf))[["n"]], "n long", size=3)
    assert sorted(r.n for r in sizes.collect()) == [1, 3, 3, 3]
    caught = op.catch_rows(f, fail_at(keep, lambda r: r.value == 3), "v long", lambda error: spark.range(7, 8).selectExpr("id as v"))
    assert values(caught) == [1, 2, 7]
    with op.shared(f) as kept:
        assert kept.df.is_cached
    assert not kept.df.is_cached


def test_hooks_and_latencies(spark):
    from tideflow.functions.metrics import LatencyBuckets, LogHook, MetricsHook, MultiHook, watched_run
    from tideflow.sources import prometheus_text, statsd_lines
    from tideflow.testkit import RecordingHook, collect_rows, expect, expect_unordered

    seen, said = RecordingHook(), []
    both = MultiHook(LogHook(said.append), seen)
    assert watched_run(spark.range(5), "count", lambda df: df.count(), both) == 5
    with pytest.raises(Exception):
        watched_run(spark.range(1).selectExpr("raise_error('no')"), "bad", lambda df: df.collect(), both)
    assert seen.names() == ["on_start", "on_done", "on_start", "on_error"] and len(said) == 4
    buckets = LatencyBuckets()
    for ns in (50_000, 60_000, 300_000, 2_000_000, 9_000_000_000):
        buckets.add(ns)
    assert buckets.counts == [2, 1, 0, 1, 0, 0, 0, 0, 0, 0, 1]
    assert buckets.percentile_ns(0.4) == 100_000 and buckets.percentile_ns(0.2) == 50_000 and buckets.percentile_ns(1.0) == 5_000_000_000
    assert buckets.merge(buckets).mean_ns() == buckets.mean_ns() and LatencyBuckets().percentile_ns(0.5) == 0
    hook = MetricsHook(spark)
    op.map_python(ints(spark, range(20)), hook.timed("double", lambda r: (r.value * 2,)), "v long").collect()
    got = hook.snapshot()["double"]
    assert got.processed == 20 and sum(got.latency.counts) == 20 and '"processed": 20' in hook.to_json()
    assert 'flow_processed_total{stage="double"} 20' in prometheus_text(hook.snapshot())
    assert statsd_lines(hook.snapshot())[0] == "flow.processed:20|c|#stage:double"
    f = ints(spark, [3, 1])
    expect(f, [3, 1], "value")
    expect_unordered(f, [1, 3], "value")
    assert collect_rows(f) == [(0, 3), (1, 1)]


def test_adapters(spark):
    from tideflow.functions import adapters as ad

    f, seen = ints(spark, [0, 1, 2]), []
    assert sorted(r.v for r in op.map_python(f, ad.lift_pure(lambda r: r.value * 2), "v long").collect()) == [0, 2, 4]
    got = op.map_python(f, ad.lift_fallible(lambda r: 2 // r.value), "v long, err string").collect()
    assert sorted((r.v, r.err is None) for r in got if r.v is not None) == [(1, True), (2, True)] and sum(r.err is not None for r in got) == 1
    stage = op.then(ad.filter_func(F.col("value") > 0), ad.reject_func(F.col("value") > 1), ad.tap_func(seen.append), ad.finally_func(lambda f: f, lambda: seen.append("done")))
    assert out(stage(f)) == [1] and len(seen) == 2
    with pytest.raises(AttributeError):
        ad.tap_error_func(lambda f: f.nothing, seen.append)(f)
    assert isinstance(seen[-1], AttributeError)
    edges = spark.createDataFrame([(1, 2)], "parent long, child long")
    assert ad.expand_map_func(edges, max_depth=3)(spark.createDataFrame([(1,)], "node long")).count() == 2
    assert [r.v for r in op.flat_map_with(f, op.Key("n"), ad.each(lambda r: iter([(r.value,)])), "v long").collect()] == [0, 1, 2]


def test_flow_checks(spark):
    with pytest.raises(ValueError, match="reserved"):
        flow(spark.range(1).withColumn("_idx", F.lit(1)), "id")
    with pytest.raises(ValueError):
        OrderedFlow(spark.range(1), ())
    with pytest.raises(ValueError):
        flow(spark.range(1), "nope")


def test_fnv(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select(fnv1a32(F.col("s")).alias("h")).collect()
    assert [r.h for r in rows] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), max_size=40), n=st.integers(0, 12))
def test_laws(spark, values, n):
    f = OrderedFlow(ints(spark, values).df.repartition(3), ("pos",))
    assert out(op.take(f, n)) + out(op.drop(f, n)) == values
    total, sums = 0, []
    for v in values:
        total += v
        sums.append(total)
    assert out(op.scan(f, "s", "sum", F.col("value")), "s") == sums
    assert [r.value for r in ordered_fold(f, lambda: 0, lambda s, r: iter([(r.value,)]), "value long").collect()] == values
    assert [x for w in windows(op.chunk_by(f, "value"), "chunk") for x in w] == values
    assert out(op.with_index(f), "idx") == list(range(len(values)))


def test_metrics(spark):
    from tideflow.functions.metrics import percentiles, measured

    df, result = measured(ints(spark, range(10)).df, "stage", F.col("value") > 7)
    df.collect()
    got = result(2.0)
    assert (got.processed, got.errors, got.throughput, got.error_rate) == (8, 2, 4.0, 0.2)
    df, result = measured(ints(spark, range(3)).df, "plain")
    df.collect()
    assert result().processed == 3
    assert percentiles(ints(spark, range(101)).df, "value", 0.5).first()["p50"] == 50
    rows = sources.from_rows(spark, [1, None, 1, 3], "value long")
    kept = op.map_cached(rows, ["value"], lambda keys: keys.where("value is null or value < 3").withColumn("sq", F.coalesce(F.col("value"), F.lit(-1))))
    assert out(kept, "sq") == [1, -1, 1, None]  # null keys are keys; a key that gives nothing keeps its rows
    cached = op.map_cached(ints(spark, [1, 1, 2]), ["value"], lambda keys: keys.withColumn("sq", F.col("value") * F.col("value")))
    assert sorted(out(cached, "sq")) == [1, 1, 4]


def test_many_ranges(spark, monkeypatch):
    """The prefix scans over more than one range: small data would otherwise be laid out as one."""
    from tideflow.plans import ordered

    monkeypatch.setattr(ordered, "ONE_RANGE", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = [(i * 37) % 11 - 5 for i in range(40)]
        f = OrderedFlow(ints(spark, values).df.repartition(5), ("pos",))
        from tideflow.plans.ordered import PID, placed

        assert placed(f).select(PID).distinct().count() > 1
        hot = f.with_df(f.df.withColumn("k", F.when(F.col("pos") % 10 > 0, F.lit("hot"))))
        want, seen = [], {}
        for i in range(40):
            k = i % 10 > 0
            seen[k] = seen.get(k, 0) + 1
            want.append(seen[k])
        assert out(op.running_count_by(hot, "k"), "n") == want  # a hot key and a null one, over several ranges
        assert out(op.with_index(f), "idx") == list(range(40))
        assert out(op.scan(f, "s", "sum", F.col("value")), "s") == [sum(values[: i + 1]) for i in range(40)]
        assert out(op.scan(f, "s", "min", F.col("value")), "s") == [min(values[: i + 1]) for i in range(40)]
        assert out(op.scan(f, "s", "count", F.lit(1)), "s") == list(range(1, 41))
        some = F.when(F.col("pos") % 13 == 3, F.col("pos"))
        assert out(op.scan(f, "s", "last", some), "s") == [None] * 3 + [3] * 13 + [16] * 13 + [29] * 11
        assert out(op.pairwise(f, "value"), "prev_value") == values[:-1]
        assert out(op.debounce(f, "pos", 1), "pos") == list(range(40)) and out(op.debounce(f, "pos", 2), "pos") == [39]
        chunks, last = [], object()
        for v in values:
            chunks.append((chunks[-1] if chunks else -1) + (v != last))
            last = v
        assert out(op.chunk_by(f, "value"), "chunk") == chunks
        assert windows(op.sliding_window(f, 7, 3), "window") == [values[k : k + 7] for k in range(0, 34, 3)]
        assert out(op.take_while(f, F.col("pos") < 25), "pos") == list(range(25))
        assert op.reduce_while(f, "n", "count", F.lit(1), lambda c: c < 17, 0).first()["n"] == 17
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
