"""One query for each operator over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tideflow.operators as op
from tideflow import sources
from tideflow.flow import OrderedFlow, flow
from tideflow.functions.errors import DROP, retry, substitute
from tideflow.plans.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY, HOUR, MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000
#: events with the time in microseconds
E = "WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, props FROM events)"
N = E + ", n AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS idx FROM e)"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, where: str | None = None) -> OrderedFlow:
    df = table(spark, d, "events").select("event_id", op.micros("ts").alias("t"), "user_id", "event_type", "value", "props")
    return flow(df.where(where) if where else df, "t", "event_id")


def users(spark: SparkSession, d: str, where: str | None = None) -> OrderedFlow:
    return events(spark, d, where).keyed("user_id")


def cents(column: str = "value"):
    return F.floor(F.col(column) * 100).cast("long")


# --- one to one


@query("SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem")
def map_line_revenue(spark, d):
    df = table(spark, d, "lineitem")
    return op.map_columns(flow(df, "l_orderkey"), revenue=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).select("l_orderkey", "l_partkey", "l_linenumber", "revenue")


@query(N + "SELECT event_id, CASE WHEN idx % 3 = 0 THEN -user_id ELSE user_id END AS user_id FROM n")
def map_every(spark, d):
    return op.map_every(events(spark, d), 3, user_id=-F.col("user_id")).select("event_id", "user_id")


def _k():
    return F.get_json_object("props", "$.k").try_cast("long")



@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def map_result_ok(spark, d):
    return op.map_result(events(spark, d), "k", _k(), F.coalesce(_k() % 2 != 0, F.lit(True)))[0].select("event_id", "k")


@query("SELECT event_id, 'odd' AS err FROM events WHERE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 <> 0, true)")
def map_result_failed(spark, d):
    return op.map_result(events(spark, d), "k", _k(), F.coalesce(_k() % 2 != 0, F.lit(True)), "odd")[1].select("event_id", "err")


@query("SELECT event_id, coalesce(TRY_CAST(nullif(event_type, 'click') AS BIGINT), CAST(length(event_type) AS BIGINT)) AS v FROM events")
def map_recover(spark, d):
    return op.map_recover(events(spark, d), "v", F.nullif("event_type", F.lit("click")).try_cast("long"), F.length("event_type").cast("long")).select("event_id", "v")


@query("SELECT event_id, user_id * user_id AS square FROM events")
def map_batch(spark, d):
    return op.map_batches(flow(events(spark, d).select("event_id", "user_id"), "event_id"), lambda pdf: pdf.assign(square=pdf.user_id**2)[["event_id", "square"]], "event_id long, square long")


@query(N + "SELECT event_id, idx FROM n")
def with_index(spark, d):
    return op.with_index(events(spark, d)).select("event_id", "idx")


@query(N + "SELECT event_id, t - coalesce(lag(t) OVER (ORDER BY t, event_id), t) AS elapsed FROM n")
def time_interval(spark, d):
    return op.time_interval(events(spark, d), "t").select("event_id", "elapsed")


@query("SELECT event_id, epoch_us(ts) AS observed_at FROM events")
def timestamp(spark, d):
    return op.timestamp(events(spark, d), at="t").select("event_id", "observed_at")


@query(N + "SELECT event_id, 1 AS sub, event_type FROM n UNION ALL SELECT event_id, 0, '--' FROM n WHERE idx > 0")
def intersperse(spark, d):
    return op.intersperse(events(spark, d), event_type=F.lit("--")).select("event_id", "sub", "event_type")


@query(N + "SELECT event_id, 1 AS sub, upper(event_type) AS event_type FROM n UNION ALL SELECT event_id, 0, '--' FROM n WHERE idx > 0")
def map_intersperse(spark, d):
    return op.map_intersperse(events(spark, d), {"event_type": F.upper("event_type")}, event_type=F.lit("--")).select("event_id", "sub", "event_type")


@query("SELECT 0 AS src, event_id FROM events WHERE event_type = 'signup' UNION ALL SELECT 1, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 2, event_id FROM events WHERE event_type = 'error'")
def start_end_with(spark, d):
    some = [events(spark, d, f"event_type = '{k}'") for k in ("signup", "view", "error")]
    return op.concat(*some).select("src", "event_id")


@query("SELECT CAST(-1 AS BIGINT) AS event_id UNION ALL SELECT event_id FROM events")
def default_if_empty(spark, d):
    """Of a flow without rows, and of one with all of them."""
    minus = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"))
    some = events(spark, d).df.select("event_id")
    none, every = (op.default_if_empty(flow(df, "event_id"), minus) for df in (some.where("event_id < 0"), some))
    return none.df.unionByName(every.df)


@query("SELECT 'next' AS kind, event_id FROM events UNION ALL SELECT 'complete', NULL")
def materialize(spark, d):
    return op.materialize(events(spark, d)).select("kind", "event_id")


@query("SELECT event_id FROM events")
def dematerialize(spark, d):
    return op.dematerialize(op.materialize(events(spark, d))).select("event_id")


# --- selection


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def filter_events(spark, d):
    return op.filter_rows(events(spark, d), (F.col("event_type") == "purchase") & (F.col("value") > 50)).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE NOT coalesce(event_type = 'view', false)")
def reject_events(spark, d):
    return op.reject(events(spark, d), F.col("event_type") == "view").select("event_id")


@query("SELECT event_id FROM events WHERE false")
def ignore_elements(spark, d):
    return op.ignore_elements(events(spark, d)).select("event_id")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 25")
def take(spark, d):
    return op.take(events(spark, d), 25).select("event_id")


@query(E + "SELECT user_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) <= 3")
def take_per_user(spark, d):
    return op.take(users(spark, d), 3).select("user_id", "event_id")


@query(N + "SELECT event_id FROM n WHERE idx >= 100")
def drop(spark, d):
    return op.drop(events(spark, d), 100).select("event_id")


_BROKEN = N + ", b AS (SELECT *, sum(CASE WHEN value < 99 THEN 0 ELSE 1 END) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS broken FROM n) SELECT event_id FROM b WHERE broken "


@query(_BROKEN + "= 0")
def take_while(spark, d):
    return op.take_while(events(spark, d), F.col("value") < 99).select("event_id")


@query(_BROKEN + "> 0")
def drop_while(spark, d):
    return op.drop_while(events(spark, d), F.col("value") < 99).select("event_id")


@query(N + "SELECT event_id FROM n WHERE idx < (SELECT count(*) FROM n) - 7")
def drop_last(spark, d):
    return op.drop_last(events(spark, d), 7).select("event_id")


_GATE = "(SELECT min(t) FROM e WHERE event_type = 'error' AND value > 90)"


@query(E + f"SELECT event_id FROM e WHERE t < {_GATE}")
def take_until(spark, d):
    return op.take_until(events(spark, d), events(spark, d, "event_type = 'error' AND value > 90"), "t").select("event_id")


@query(E + f"SELECT event_id FROM e WHERE t >= {_GATE}")
def drop_until(spark, d):
    return op.drop_until(events(spark, d), events(spark, d, "event_type = 'error' AND value > 90"), "t").select("event_id")


@query(N + "SELECT event_id FROM n WHERE idx % 10 = 0")
def take_every(spark, d):
    return op.take_every(events(spark, d), 10).select("event_id")


@query(N + "SELECT event_id FROM n WHERE idx % 10 <> 0")
def drop_every(spark, d):
    return op.drop_every(events(spark, d), 10).select("event_id")


@query("SELECT event_id FROM events WHERE substr(md5('0:' || event_id), 1, 8) < '19999999'")
def random_sample(spark, d):
    return op.random_sample(events(spark, d), 0.1, key="event_id").select("event_id")


@query(E + "SELECT user_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) = 1")
def distinct_by_user(spark, d):
    return op.distinct_by(events(spark, d), "user_id").select("user_id", "event_id")


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct(spark, d):
    return op.distinct(flow(events(spark, d).select("event_id", "event_type", "user_id"), "event_id")).select("event_type", "user_id")


@query(N + "SELECT event_id FROM n QUALIFY idx = 0 OR event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY t, event_id)")
def dedupe_consecutive(spark, d):
    return op.dedupe(events(spark, d), "event_type", window=1).select("event_id")


#: each user's events numbered by k, for folds as recursive queries
R = E + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e)"


@query(R + ", g AS (SELECT user_id, k, event_id, [event_type] AS kept, true AS passed FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.event_id, CASE WHEN list_contains(g.kept, r.event_type) THEN g.kept ELSE list_append(g.kept, r.event_type)[-3:] END, NOT list_contains(g.kept, r.event_type) FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k + 1) SELECT event_id FROM g WHERE passed")
def dedupe_window(spark, d):
    return op.dedupe(users(spark, d), "event_type", window=3).select("event_id")


@query(E + "SELECT event_id FROM e WHERE user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) = 1")
def dedupe_external(spark, d):
    return op.dedupe(events(spark, d), "user_id", seen=events(spark, d, "event_type = 'error'").select("user_id")).select("event_id")


@query(N + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM n), g AS (SELECT user_id, k, t, event_id, t AS passed FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.t, r.event_id, CASE WHEN r.t - g.passed >= 43200000000 THEN r.t ELSE g.passed END FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k + 1) SELECT event_id FROM g WHERE passed = t")
def ttl_dedupe(spark, d):
    return op.ttl_dedupe(flow(events(spark, d).select("t", "event_id", "user_id"), "t", "event_id"), "user_id", "t", 12 * HOUR).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_by_topk(spark, d):
    return op.top_k(flow(table(spark, d, "orders"), "o_orderkey"), 20, F.desc("o_totalprice")).select("o_orderkey", "o_totalprice")


# --- aggregates


@query(N + "SELECT event_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, max(value) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS top FROM n")
def scan_running_value(spark, d):
    f = op.scan(events(spark, d), "total", "sum", cents())
    return op.scan(f, "top", "max", F.col("value")).select("event_id", "total", "top")


@query("SELECT CAST(coalesce(sum(CAST(floor(value * 100) AS BIGINT)), 0) AS BIGINT) AS total FROM events")
def reduce_total(spark, d):
    return op.reduce(events(spark, d), "total", F.sum(cents()), 0)


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id")
def reduce_ordered(spark, d):
    return op.reduce_ordered(users(spark, d), "path", F.col("event_type"), F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, F.lit(">"), x)))


@query(N + ", s AS (SELECT t, event_id, sum(CAST(floor(value * 100) AS BIGINT)) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS total FROM n) SELECT CAST(min(total) AS BIGINT) AS total FROM s WHERE total >= 100000")
def reduce_while(spark, d):
    return op.reduce_while(events(spark, d), "total", "sum", cents(), lambda c: c < 100_000, 0)


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY user_id")
def group_by_user(spark, d):
    f = flow(events(spark, d).select("t", "event_id", "user_id"), "t", "event_id")
    return op.group_by(f, "user_id").select("user_id", F.size("items").cast("long").alias("n"), F.element_at("items", 1)["event_id"].alias("first_id"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def to_map_last(spark, d):
    return op.to_map(events(spark, d), "user_id", "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def frequencies(spark, d):
    return op.frequencies(events(spark, d), "event_type")


@query(E + "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e")
def running_count_by(spark, d):
    return op.running_count_by(events(spark, d), "event_type").select("event_id", "n")


@query(E + "SELECT event_id, user_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e")
def running_sum_by(spark, d):
    return op.running_sum_by(events(spark, d), "user_id", value=cents()).select("event_id", "user_id", "total")


_KINDS = ["signup", "purchase", "error", "view", "click"]


@query(N + "SELECT event_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS {k}" for k in _KINDS) + " FROM n")
def running_frequencies(spark, d):
    f = op.running_frequencies(events(spark, d), "event_type", _KINDS)
    return f.select("event_id", *[F.coalesce(F.col("counts")[k], F.lit(0)).alias(k) for k in _KINDS])


@query("SELECT min(value) AS min, max(value) AS max FROM events")
def min_max(spark, d):
    return op.min_max(events(spark, d), F.col("value"))


@query("SELECT event_id, user_id FROM events ORDER BY user_id, ts, event_id LIMIT 1")
def min_by(spark, d):
    return op.min_by(events(spark, d), F.col("user_id")).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events ORDER BY user_id DESC, ts, event_id LIMIT 1")
def max_by(spark, d):
    return op.max_by(events(spark, d), F.col("user_id")).select("event_id", "user_id")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1")
def first(spark, d):
    return op.first(events(spark, d)).select("event_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def last(spark, d):
    return op.last(events(spark, d)).select("event_id")


@query("SELECT count(*) AS n FROM events")
def count(spark, d):
    return op.count(events(spark, d))


@query("SELECT bool_or(value > 99.9) AS \"any\", bool_and(value >= 0) AS \"all\", bool_or(event_type = 'refund') AS contains FROM events")
def any_all_contains(spark, d):
    f = events(spark, d)
    return op.any_of(f, F.col("value") > 99.9).join(op.all_of(f, F.col("value") >= 0), how="cross").join(op.contains(f, "event_type", "refund"), how="cross")


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 1")
def find(spark, d):
    return op.find(events(spark, d), F.col("event_type") == "error").select("event_id")


@query("SELECT event_id FROM events ORDER BY md5('0:' || event_id), ts, event_id LIMIT 50")
def take_random(spark, d):
    return op.take_random(events(spark, d), 50, key="event_id").select("event_id")


# --- windows


@query(N + "SELECT event_id, idx // 7 AS batch FROM n")
def batch_count(spark, d):
    return op.batch(events(spark, d), count=7).select("event_id", "batch")


@query(N + "SELECT event_id, idx // 7 AS batch FROM n WHERE (idx // 7 + 1) * 7 <= (SELECT count(*) FROM n)")
def batch_drop_partial(spark, d):
    return op.batch(events(spark, d), count=7, drop_partial=True).select("event_id", "batch")


@query(E + "SELECT event_id, (t - (SELECT min(t) FROM e)) // 21600000000 AS batch FROM e")
def batch_timeout(spark, d):
    return op.batch(events(spark, d), every=6 * HOUR, time="t").select("event_id", "batch")


@query(N + ", g AS (SELECT idx, event_id, CAST(0 AS BIGINT) AS batch, CAST(floor(value * 100) AS BIGINT) AS s FROM n WHERE idx = 0 UNION ALL SELECT n.idx, n.event_id, CASE WHEN g.s >= 20000 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.s >= 20000 THEN 0 ELSE g.s END + CAST(floor(n.value * 100) AS BIGINT) FROM g JOIN n ON n.idx = g.idx + 1) SELECT event_id, batch FROM g")
def batch_measure(spark, d):
    f = flow(events(spark, d).select("t", "event_id", "value"), "t", "event_id")
    return op.batch(f, measure=cents(), limit=20_000).select("event_id", "batch")


@query(E + ", b AS (SELECT t FROM e WHERE event_type = 'signup'), j AS (SELECT e.event_id, (SELECT count(*) FROM b WHERE b.t <= e.t) AS buffer FROM e WHERE event_type = 'view') SELECT event_id, buffer FROM j WHERE buffer < (SELECT count(*) FROM b)")
def buffer_with_signup(spark, d):
    return op.buffer_with(events(spark, d, "event_type = 'view'"), events(spark, d, "event_type = 'signup'"), "t").select("event_id", "buffer")


@query(N + ", w AS (SELECT idx // 2 AS win FROM n WHERE idx % 2 = 0 AND idx + 4 <= (SELECT count(*) FROM n)) SELECT w.win AS \"window\", n.idx - w.win * 2 AS pos, n.event_id FROM w JOIN n ON n.idx BETWEEN w.win * 2 AND w.win * 2 + 3")
def sliding_window(spark, d):
    return op.sliding_window(events(spark, d), 4, 2).select("window", "pos", "event_id")




@query(E + ", i AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 7200000000 THEN 0 ELSE 1 END AS new FROM e) SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session FROM i")
def session_window(spark, d):
    return op.session_window(users(spark, d), "t", 2 * HOUR).select("event_id", "session")


@query(E + ", i AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (ORDER BY t, event_id) THEN 0 ELSE 1 END AS new FROM e) SELECT event_id, CAST(sum(new) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS chunk FROM i")
def chunk_by_type(spark, d):
    return op.chunk_by(events(spark, d), "event_type").select("event_id", "chunk")


@query(E + ", i AS (SELECT *, CASE WHEN value >= lag(value) OVER (ORDER BY t, event_id) THEN 0 ELSE 1 END AS new FROM e) SELECT event_id, CAST(sum(new) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS chunk FROM i")
def chunk_while_rising(spark, d):
    return op.chunk_while(events(spark, d), "value", lambda a, b: b >= a).select("event_id", "chunk")


@query(N + "SELECT event_id, idx // 10 AS batch FROM n QUALIFY row_number() OVER (PARTITION BY idx // 10 ORDER BY value DESC, t, event_id) <= 2")
def within_top(spark, d):
    batches = op.map_columns(op.batch(events(spark, d), count=10), worth=-F.col("value"))
    return op.within(batches, "batch", lambda f: op.take(op.sort_by(f, "worth"), 2)).select("event_id", "batch")


@query(N + "SELECT event_id, lag(event_id) OVER (ORDER BY t, event_id) AS prev_event_id FROM n QUALIFY idx > 0")
def pairwise(spark, d):
    return op.pairwise(events(spark, d), "event_id").select("event_id", "prev_event_id")


# --- combination


_SIDES = E + ", a AS (SELECT * FROM e WHERE event_type = 'view'), b AS (SELECT * FROM e WHERE event_type = 'purchase')"


def _views(spark, d):
    return events(spark, d, "event_type = 'view'"), events(spark, d, "event_type = 'purchase'")


@query(_SIDES + ", x AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS idx FROM a), y AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS idx FROM b) SELECT idx, x.event_id AS a_event_id, y.event_id AS b_event_id FROM x JOIN y USING (idx)")
def zip_flows(spark, d):
    return op.zip_flows(*_views(spark, d)).select("idx", "a_event_id", "b_event_id")


@query(E + ", u AS (SELECT t, CASE event_type WHEN 'view' THEN event_id END AS x, CASE event_type WHEN 'purchase' THEN event_id END AS y FROM e WHERE event_type IN ('view', 'purchase')), l AS (SELECT t, last_value(x IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS first_id, last_value(y IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS second_id FROM u) SELECT t, first_id, second_id FROM l WHERE first_id IS NOT NULL AND second_id IS NOT NULL")
def combine_latest(spark, d):
    return op.combine_latest(*_views(spark, d), "t").select("t", F.col("first.event_id").alias("first_id"), F.col("second.event_id").alias("second_id"))


@query(_SIDES + " SELECT a.event_id, b.event_id AS other_id FROM a ASOF JOIN b ON a.t >= b.t")
def latest_from(spark, d):
    return op.latest_from(*_views(spark, d), "t").select("event_id", F.col("other.event_id").alias("other_id"))


@query(_SIDES + ", c AS (SELECT a.event_id, a.t, (SELECT count(*) FROM b WHERE b.t < a.t) AS tick FROM a) SELECT tick, arg_max(event_id, t) AS event_id FROM c WHERE tick < (SELECT count(*) FROM b) GROUP BY tick")
def sample_with(spark, d):
    return op.sample_with(*_views(spark, d), "t").select("tick", "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'purchase')")
def merge(spark, d):
    return op.merge(*_views(spark, d)).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE event_type = (SELECT event_type FROM events WHERE event_type IN ('view', 'purchase') ORDER BY ts, event_id LIMIT 1)")
def amb(spark, d):
    return op.amb(*_views(spark, d)).select("event_id")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_customer(spark, d):
    side = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return op.lookup_by(flow(table(spark, d, "orders"), "o_orderkey"), side, "o_custkey", "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice, o_totalprice > c_acctbal AS over FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enrich_orders(spark, d):
    orders = flow(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    return op.enrich(orders, table(spark, d, "customer"), "o_custkey", "c_custkey", over=F.col("o_totalprice") > F.col("c_acctbal")).select("o_orderkey", "o_totalprice", "over")


@query("SELECT true AS equal")
def sequence_equal(spark, d):
    f = events(spark, d)
    return op.sequence_equal(f, op.filter_rows(f, F.col("event_id") >= 0), "event_id", "event_type")


# --- fan-out


@query("SELECT event_id, value >= 50 AS high FROM events")
def partition(spark, d):
    yes, no = op.partition(events(spark, d), F.col("value") >= 50)
    return yes.select("event_id", F.lit(True).alias("high")).unionByName(no.select("event_id", F.lit(False).alias("high")))


@query(N + "SELECT event_id, CAST(idx % 3 AS INTEGER) AS branch FROM n")
def balance(spark, d):
    return op.balance(events(spark, d), 3).select("event_id", "branch")


@query("SELECT event_id, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(CAST(user_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) % 4 AS INTEGER) AS branch FROM events")
def keyed_balance(spark, d):
    return op.keyed_balance(events(spark, d), 4, "user_id").select("event_id", "branch")


# --- expansion


@query("SELECT doc_id, CAST(unnest(range(len(string_split(text, ' ')))) AS INTEGER) AS pos, unnest(string_split(text, ' ')) AS item FROM documents")
def flat_map_words(spark, d):
    return op.flat_map(flow(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), F.split("text", " ")).select("doc_id", "pos", "item")


@query("SELECT user_id, event_id FROM events")
def unbatch(spark, d):
    grouped = op.group_by(flow(events(spark, d).select("t", "event_id", "user_id"), "t", "event_id"), "user_id")
    return op.unbatch(grouped, "items", ("user_id",)).select("user_id", F.col("items.event_id").alias("event_id"))


@query(E + ", s AS (SELECT event_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM e), x AS (SELECT event_id, t, nxt, unnest([0, 3600000000, 21600000000]) AS delay FROM s) SELECT event_id, delay FROM x WHERE nxt IS NULL OR t + delay < nxt")
def switch_map(spark, d):
    return op.switch_map(users(spark, d), "t", F.array(*[F.lit(x).cast("long") for x in (0, HOUR, 6 * HOUR)])).select("event_id", "delay")


_GREEDY = E + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e), g AS (SELECT user_id, k, t, event_id, t AS passed FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.t, r.event_id, CASE WHEN r.t - g.passed >= {0} THEN r.t ELSE g.passed END FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k + 1) SELECT event_id FROM g WHERE passed = t"


@query(_GREEDY.format(HOUR))
def exhaust_map(spark, d):
    return op.exhaust_map(users(spark, d), "t", HOUR).select("event_id")


@query("WITH RECURSIVE g(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT g.node * 2 + c.c, g.depth + 1 FROM g, (VALUES (0), (1)) c(c) WHERE g.depth < 6) SELECT node, depth FROM g")
def expand_map_tree(spark, d):
    edges = spark.range(1, 64).select(F.col("id").alias("parent"), F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("child"))
    return op.expand_map(spark.range(1, 2).select(F.col("id").alias("node")), edges, max_depth=6)


_GRAPH = "WITH RECURSIVE x(parent, child) AS (SELECT p, c FROM (SELECT unnest(range(40)) AS p), (VALUES (1), (2), (3)) v(c0), LATERAL (SELECT (p * c0 + 1) % 40 AS c))"


def _graph(spark):
    """A graph with diamonds and cycles: from p to p + 1, 2 p + 1 and 3 p + 1 modulo 40."""
    return spark.range(40).select(F.col("id").alias("parent"), F.explode(F.array(*[(F.col("id") * k + 1) % 40 for k in (1, 2, 3)])).alias("child"))


@query(_GRAPH + ", g(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT x.child, g.depth + 1 FROM g JOIN x ON x.parent = g.node WHERE g.depth < 4) SELECT node, depth FROM g")
def expand_map_paths(spark, d):
    """A row for every path: nodes are met again."""
    return op.expand_map(spark.range(1, 2).select(F.col("id").alias("node")), _graph(spark), max_depth=4)


@query(_GRAPH + ", g(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT x.child, g.depth + 1 FROM g JOIN x ON x.parent = g.node WHERE g.depth < 40) SELECT node, min(depth) AS depth FROM g GROUP BY node")
def expand_map_visited(spark, d):
    return op.expand_map(spark.range(1, 2).select(F.col("id").alias("node")), _graph(spark), visited_by=True)


# --- sources


@query("WITH RECURSIVE f(pos, a, b) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT pos + 1, b, a + b FROM f WHERE pos < 19) SELECT pos, a AS value FROM f")
def unfold_fib(spark, d):
    return sources.unfold(spark, "named_struct('a', 0L, 'b', 1L)", "s.a", "named_struct('a', s.b, 'b', s.a + s.b)", "s.a < 6765").select("pos", "value")


@query("SELECT range AS pos, CAST(2 ** range AS BIGINT) AS value FROM range(10)")
def iterate_double(spark, d):
    return sources.iterate(spark, "1L", "s * 2", 10).select("pos", "value")


@query("SELECT range AS pos, ['a', 'b', 'c'][range % 3 + 1] AS value FROM range(100)")
def cycle(spark, d):
    return sources.cycle(spark, ["a", "b", "c"], 100).select("pos", "value")


@query("SELECT (range + 1) * 60000000 AS t FROM range(60)")
def ticker(spark, d):
    return sources.ticker(spark, 0, MINUTE, 60).select("t")


@query("SELECT range AS pos, range * range AS value FROM range(500)")
def from_iterable(spark, d):
    return sources.from_iterable(spark, (i * i for i in range(500)), "value long", chunk=200).select("pos", "value")


# --- time


@query(_GREEDY.format(6 * HOUR))
def throttle(spark, d):
    return op.throttle(users(spark, d), "t", 6 * HOUR).select("event_id")


@query(E + "SELECT event_id FROM e QUALIFY coalesce(lead(t) OVER (ORDER BY t, event_id) - t >= 300000000, true)")
def debounce(spark, d):
    return op.debounce(events(spark, d), "t", 5 * MINUTE).select("event_id")


@query(E + "SELECT t // 86400000000 AS tick, max(event_id) AS event_id FROM e GROUP BY 1 QUALIFY row_number() OVER (ORDER BY tick DESC) > 1")
def sample(spark, d):
    return op.sample(events(spark, d), "t", DAY).select("tick", "event_id")


_TOKENS = "least(2.0::DOUBLE, g.tokens + CAST(greatest(0, r.t - g.t) AS DOUBLE) * (1::DOUBLE / 43200000000::DOUBLE))"


@query(R + f", g AS (SELECT user_id, k, t, event_id, 1.0::DOUBLE AS tokens, true AS passed FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.t, r.event_id, {_TOKENS} - CASE WHEN {_TOKENS} >= 1 THEN 1 ELSE 0 END, {_TOKENS} >= 1 FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k + 1) SELECT event_id FROM g WHERE passed")
def rate_limit_drop(spark, d):
    return op.rate_limit(users(spark, d), "t", 1, burst=2, unit=12 * HOUR).select("event_id")


@query(R + f", g AS (SELECT user_id, k, t, event_id, 1.0::DOUBLE AS tokens FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.t, r.event_id, {_TOKENS} - 1 FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k + 1) SELECT event_id, CAST(floor(CAST(t AS DOUBLE) + CASE WHEN tokens >= 0 THEN 0 ELSE -tokens / (1::DOUBLE / 43200000000::DOUBLE) END) AS BIGINT) AS emit_at FROM g")
def rate_limit_wait(spark, d):
    return op.rate_limit(users(spark, d), "t", 1, burst=2, mode="wait", unit=12 * HOUR).select("event_id", "emit_at")


@query(R + """, g AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, 'closed' AS met, 'closed' AS state, 0 AS bad, 0 AS good, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS half FROM r UNION ALL
SELECT user_id, k, event_id, met,
  CASE WHEN met = 'open' THEN met WHEN ok THEN CASE WHEN met = 'half-open' AND good1 + 1 >= 2 THEN 'closed' ELSE met END WHEN met = 'half-open' OR bad1 + 1 >= 2 THEN 'open' ELSE met END,
  CASE WHEN met = 'open' THEN bad1 WHEN ok OR met = 'half-open' OR bad1 + 1 >= 2 THEN 0 ELSE bad1 + 1 END,
  CASE WHEN met <> 'open' AND ok THEN good1 + 1 ELSE good1 END,
  CASE WHEN met <> 'open' AND NOT ok AND (met = 'half-open' OR bad1 + 1 >= 2) THEN t ELSE since1 END, half1
FROM (SELECT *, CASE WHEN probing THEN 'half-open' ELSE state1 END AS met, CASE WHEN probing THEN t ELSE half END AS half1, CASE WHEN probing THEN 0 ELSE good END AS good1
  FROM (SELECT *, state1 = 'open' AND t - since1 >= 3600000000 AS probing
    FROM (SELECT r.user_id, r.k, r.event_id, r.t, r.event_type NOT IN ('error', 'click') AS ok, g.half, g.good, CASE WHEN g.state = 'half-open' AND r.t - g.half >= 43200000000 THEN 'open' ELSE g.state END AS state1, CASE WHEN g.state = 'half-open' AND r.t - g.half >= 43200000000 THEN 0 ELSE g.bad END AS bad1, CASE WHEN g.state = 'half-open' AND r.t - g.half >= 43200000000 THEN r.t ELSE g.since END AS since1
      FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k + 1)))) SELECT event_id, met AS state, met <> 'open' AS allowed FROM g WHERE k > 0""")
def circuit_breaker(spark, d):
    """Errors and clicks fail; a half-open breaker has half a day for two good calls."""
    f = op.map_columns(users(spark, d), ok=~F.col("event_type").isin("error", "click"))
    return op.circuit_breaker(f, "t", "ok", threshold=2, cooldown=HOUR, probes=2, half_open_timeout=12 * HOUR).select("event_id", "state", "allowed")


# --- state


@query(E + "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM e")
def map_with_key_count(spark, d):
    f = flow(events(spark, d).select("t", "event_id", "user_id"), "t", "event_id")
    return op.map_with_key(f, "user_id", op.Key("seen", 0), lambda ref, row: (row.event_id, ref.update_and_get(lambda n: n + 1)), "event_id long, n long")


@query(N + "SELECT event_id, idx + 1 AS n FROM n")
def map_with_count(spark, d):
    f = flow(events(spark, d).select("t", "event_id"), "t", "event_id")
    return op.map_with(f, op.Key("seen", 0), lambda ref, row: (row.event_id, ref.update_and_get(lambda n: n + 1)), "event_id long, n long")


@query(E + ", i AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 43200000000 THEN 1 ELSE 0 END AS fresh FROM e), p AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM i) SELECT event_id, count(*) OVER (PARTITION BY user_id, epoch ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM p")
def key_ttl_reset(spark, d):
    return op.running_with_ttl(events(spark, d), "user_id", "t", 12 * HOUR, "n", "count", F.lit(1)).select("event_id", "n")


# --- effects


_OUTCOME = "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS result, CASE WHEN event_type = 'error' THEN 'refused' END AS err, event_type <> 'error' AS applied FROM events"


def _apply(row):
    if row.event_type == "error":
        raise ValueError("refused")
    return row.event_type


def _calls(spark, d):
    return flow(events(spark, d).select("t", "event_id", "event_type"), "t", "event_id")


@query(_OUTCOME)
def effect_outcomes(spark, d):
    return op.effect(_calls(spark, d), _apply).select("event_id", "result", "err", "applied")


@query("SELECT event_id, event_type <> 'error' AS good FROM events")
def try_effect(spark, d):
    good, bad = op.try_effect(_calls(spark, d), _apply)
    return good.select("event_id", F.lit(True).alias("good")).unionByName(bad.select("event_id", F.lit(False).alias("good")))


@query(E + "SELECT event_id, first_value(event_id) OVER (PARTITION BY event_type ORDER BY t, event_id) <> event_id AS deduped FROM e")
def effect_once_per_key(spark, d):
    return op.effect(_calls(spark, d), lambda row: row.event_type, op.EffectPolicy(key="event_type")).select("event_id", "deduped")


@query("SELECT event_id, CAST(NULL AS VARCHAR) AS result, false AS applied FROM events")
def effect_dry_run(spark, d):
    with op.dry_run():
        return op.effect(_calls(spark, d), _apply).select("event_id", "result", "applied")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def on_error_drop(spark, d):
    return op.map_python(_calls(spark, d), lambda row: (row.event_id, _apply(row)), "event_id long, event_type string", DROP)


@query("SELECT CASE event_type WHEN 'error' THEN -1 ELSE event_id END AS event_id FROM events")
def on_error_return(spark, d):
    return op.map_python(_calls(spark, d), lambda row: (row.event_id, _apply(row))[:1], "event_id long", substitute((-1,)))


@query("SELECT event_id FROM events")
def on_error_retry(spark, d):
    """Every second try of a task fails; one more try is always enough."""

    def shaky(row, calls=[0]):  # noqa: B006  a counter of the task's own
        calls[0] += 1
        if calls[0] % 2:
            raise ValueError("try again")
        return (row.event_id,)

    return op.map_python(_calls(spark, d), shaky, "event_id long", retry(1))


@query("SELECT event_id, length(event_type) AS n FROM events")
def map_cached(spark, d):
    return op.map_cached(events(spark, d), ["event_type"], lambda keys: keys.withColumn("n", F.length("event_type").cast("long"))).select("event_id", "n")


@query(E + ", f AS (SELECT min(t) AS stop FROM e WHERE event_type = 'error') SELECT event_id FROM e, f WHERE t < stop UNION ALL SELECT -1")
def catch_rows(spark, d):
    return op.catch_rows(_calls(spark, d), lambda row: (row.event_id, _apply(row))[:1], "event_id long", lambda error: spark.range(1).select(F.lit(-1).cast("long").alias("event_id")))


@query("SELECT CAST(-1 AS BIGINT) AS event_id")
def catch(spark, d):
    return op.catch(lambda: events(spark, d).select(F.expr("IF(event_type = 'error', CAST(raise_error('refused') AS BIGINT), event_id)").alias("event_id")), lambda error: spark.range(1).select(F.lit(-1).cast("long").alias("event_id")))


@query("SELECT user_id, count(*) AS effects, count(*) FILTER (event_type = 'error' AND value > 50) AS required_failures, count(*) FILTER (event_type = 'error' AND value <= 50) AS best_effort_failures, CASE WHEN bool_or(event_type = 'error' AND value > 50) THEN 'failure' WHEN bool_or(event_type = 'error') THEN 'partial_success' ELSE 'success' END AS outcome FROM events GROUP BY user_id")
def run_outcome(spark, d):
    outcomes = events(spark, d).df.withColumn("err", F.when(F.col("event_type") == "error", "error")).withColumn("required", F.col("value") > 50)
    return op.run_outcomes(outcomes, "user_id")


# --- more of sources, state and composition


@query("SELECT 60000005 AS t")
def timer(spark, d):
    return sources.timer(spark, 5, MINUTE).select(F.col("t").cast("int").alias("t"))


@query("SELECT range AS pos, 7 AS value FROM range(300)")
def repeatedly(spark, d):
    return sources.repeatedly(spark, F.lit(7), 300).select("pos", "value")


@query("SELECT range AS pos, 'row ' || range AS value FROM range(40)")
def from_slice(spark, d):
    return sources.from_rows(spark, [f"row {k}" for k in range(40)], "value string").select("pos", "value")


@query("SELECT p AS part, k AS pos, p * 1000 + k AS value FROM (SELECT CAST(range AS INTEGER) AS p FROM range(5)), (SELECT range AS k FROM range(200))")
def generate_in_parts(spark, d):
    return sources.generate_in_parts(spark, 5, lambda part: ((part * 1000 + k,) for k in range(200)), "value long").df


@query("SELECT CAST(0 AS BIGINT) AS value WHERE false")
def empty(spark, d):
    return sources.empty(spark, "value long").select("value")


@query("WITH RECURSIVE f(pos, a, b) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT pos + 1, b, a + b FROM f WHERE b < 1000) SELECT pos, a AS value FROM f")
def unfold_until(spark, d):
    return sources.unfold(spark, "named_struct('a', 0L, 'b', 1L)", "s.a", "named_struct('a', s.b, 'b', s.a + s.b)", "s.a < 1000").select("pos", "value")


@query("SELECT event_id, event_type, CAST(NULL AS BIGINT) AS user_id FROM events UNION ALL SELECT event_id, NULL, user_id FROM events")
def unzip(spark, d):
    kinds, who = op.unzip(events(spark, d), ["event_type"], ["user_id"])
    return kinds.select("event_id", "event_type").unionByName(who.select("event_id", "user_id"), allowMissingColumns=True)


@query("SELECT CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events")
def total(spark, d):
    return op.total(events(spark, d), cents())


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1")
def single(spark, d):
    row = op.single(op.take(flow(events(spark, d).select("t", "event_id"), "t", "event_id"), 1))
    return spark.createDataFrame([(row.event_id,)], "event_id long")


@query(E + "SELECT DISTINCT user_id FROM e WHERE user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'error' AND value > 50)")
def bloom_reject(spark, d):
    """The filter is made for the users there are; what passes it is looked up in the set."""
    seen = events(spark, d, "event_type = 'error' AND value > 50").df.select("user_id")
    bloom = op.BloomSet.sized(seen, "user_id", 1e-9)
    bits = bloom.built(seen, "user_id")
    return bloom.reject_seen(events(spark, d), bits, "user_id", exact=seen).select("user_id").distinct()


@query(R + ", g AS (SELECT user_id, k, event_id, CAST(0 AS BIGINT) AS batch, 1 AS n, CAST(floor(value * 100) AS BIGINT) AS s FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.event_id, CASE WHEN g.n >= 5 OR g.s >= 20000 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.n >= 5 OR g.s >= 20000 THEN 1 ELSE g.n + 1 END, CASE WHEN g.n >= 5 OR g.s >= 20000 THEN 0 ELSE g.s END + CAST(floor(r.value * 100) AS BIGINT) FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k + 1), z AS (SELECT user_id, max(k) AS k FROM g GROUP BY user_id), y AS (SELECT g.user_id, g.batch FROM g JOIN z USING (user_id, k) WHERE g.n < 5 AND g.s < 20000) SELECT event_id, batch FROM g WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.user_id = g.user_id AND y.batch = g.batch)")
def batch_triggers(spark, d):
    """Five rows or 200 in value, whichever comes first; the last batch goes if neither closed it."""
    return op.batch(users(spark, d), count=5, measure=cents(), limit=20_000, drop_partial=True).select("event_id", "batch")


@query(R + "SELECT user_id, event_id, k AS n FROM r WHERE k % 3 = 0")
def flat_map_with_key(spark, d):
    def third(ref, row):
        if ref.update_and_get(lambda n: n + 1) % 3 == 0:
            yield row.user_id, row.event_id, ref.get()

    return op.flat_map_with_key(events(spark, d), "user_id", op.Key("seen", 0), third, "user_id long, event_id long, n long", columns=["event_id"])


@query(N + "SELECT event_id, idx + 1 AS n FROM n WHERE (idx + 1) % 100 = 0")
def flat_map_with(spark, d):
    """One cell for the whole flow, so one task by nature."""

    def hundredth(ref, row):
        if ref.update_and_get(lambda n: n + 1) % 100 == 0:
            yield row.event_id, ref.get()

    return op.flat_map_with(events(spark, d), op.Key("seen", 0), hundredth, "event_id long, n long", columns=["event_id"])


@query(E + ", i AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 43200000000 THEN 1 ELSE 0 END AS fresh FROM e), p AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM i) SELECT event_id, count(*) OVER (PARTITION BY user_id, epoch ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM p")
def state_ttl(spark, d):
    """A cell's value expires half a day after it was last written."""
    return op.map_with_key(events(spark, d), "user_id", op.Key("seen", 0, ttl=12 * HOUR), lambda ref, row: (row.event_id, ref.update_and_get(lambda n: n + 1)), "event_id long, n long", "t", ["event_id"])


@query(R + "SELECT event_id, k AS n FROM r")
def with_store(spark, d):
    """Two runs, the events before and after a time, over one store: the second goes on where the first ended."""
    store = op.StateTable(scratch_path(spark.range(0)))
    middle = events(spark, d).df.agg(F.expr("CAST(percentile(t, 0.5) AS BIGINT)").alias("m")).first()["m"]
    count = lambda part: op.map_with_key(events(spark, d, part), "user_id", op.Key("seen", 0), lambda ref, row: (row.event_id, ref.update_and_get(lambda n: n + 1)), "event_id long, n long", columns=["event_id"], store=store)
    return count(f"t < {middle}").unionByName(count(f"t >= {middle}"))


@query("SELECT event_id, event_id * 10 AS v FROM events")
def map_pooled(spark, d):
    return op.map_pooled(flow(events(spark, d).select("event_id"), "event_id"), lambda: [10], lambda held, row: (row.event_id, row.event_id * held[0]), "event_id long, v long")


@query("SELECT 'all' AS branch, count(*) AS n FROM events UNION ALL SELECT 'errors', count(*) FILTER (event_type = 'error') FROM events")
def broadcast_branches(spark, d):
    a, b = op.broadcast(events(spark, d), 2)
    n, errors = op.run_all(lambda: a.df.count(), lambda: b.df.where("event_type = 'error'").count())
    op.release(a)
    return spark.createDataFrame([("all", n), ("errors", errors)], "branch string, n long")


@query("SELECT event_id, upper(event_type) AS event_type FROM events WHERE value >= 50")
def stages(spark, d):
    """Two stages composed, of which the first is replayed from its snapshot."""
    store = op.SnapshotStore(scratch_path(spark.range(0)))
    high = op.segment("high", lambda f: op.filter_rows(f, F.col("value") >= 50), store)
    both = op.then(high, lambda f: op.map_columns(f, event_type=F.upper("event_type")))
    op.through(events(spark, d), both)
    again = op.or_else(lambda f: op.ignore_elements(f), both)
    return op.through(events(spark, d), again).select("event_id", "event_type")


@query("SELECT event_id, event_type, value FROM events")
def files(spark, d):
    """Through CSV and JSON lines and back."""
    at = scratch_path(spark.range(0))
    sources.write_csv(events(spark, d).select("event_id", "event_type", "value"), f"{at}/c")
    sources.write_json(sources.read_csv(spark, f"{at}/c", "event_id long, event_type string, value double", header=True), f"{at}/j")
    return sources.read_json(spark, f"{at}/j", "event_id long, event_type string, value double")


@query("SELECT event_id, event_type FROM events")
def register_source(spark, d):
    """A source of one's own: a task for each kind of event, reading a table by its own means."""
    import pyarrow.parquet as pq

    rows = events(spark, d).df.select("event_id", "event_type")
    at = scratch_path(rows)
    rows.write.parquet(at)
    place = at.removeprefix("file://").removeprefix("file:")

    def read(options, kind):
        table = pq.read_table(place, filters=[("event_type", "=", kind)])
        yield from zip(table.column("event_id").to_pylist(), table.column("event_type").to_pylist())

    sources.register_source(spark, "events_by_kind", "event_id long, event_type string", lambda options: list(_KINDS), read)
    return spark.read.format("events_by_kind").load()
