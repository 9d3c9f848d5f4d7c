"""Every query that has SQL gives what DuckDB gives, at the smallest scale."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tideflow.plans import fold, ordered
from tideflow.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(map(tuple, rows))


#: Queries of flows without keys that need positions or running values.
POSITIONAL = (
    "balance", "batch_count", "buffer_with_signup", "chunk_by_type", "combine_latest", "debounce", "dematerialize", "drop_last", "intersperse", "latest_from", "pairwise",
    "reduce_while", "running_count_by", "running_sum_by", "running_frequencies", "sample_with", "scan_running_value", "sliding_window", "with_index", "zip_flows",
)


@pytest.mark.parametrize("name", POSITIONAL)
def test_same_rows_over_many_ranges(spark, db, name, monkeypatch):
    """The plans of large flows: ranges, and prefix scans over them."""
    monkeypatch.setattr(ordered, "ONE_RANGE", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_same_rows(spark, db, name)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


#: Queries whose fold has one state for the whole flow.
FOLDED = ("batch_measure", "map_with_count", "flat_map_with")


@pytest.mark.parametrize("name", FOLDED)
def test_same_rows_when_a_fold_is_handed_on(spark, db, name, monkeypatch):
    """The plan of large flows: no task sorts more than its range (300 rows here, of 1000)."""
    legs = []
    relayed = fold._relayed
    monkeypatch.setattr(ordered, "ONE_RANGE", -1)
    monkeypatch.setattr(fold, "RANGE_ROWS", 300)
    monkeypatch.setattr(fold, "_relayed", lambda *args: (legs.append(args[2]), relayed(*args))[1])
    test_same_rows(spark, db, name)
    assert legs == [4]


def test_bloom_reject_with_many_users(spark, tmp_path):
    """Three times the 10,000 keys that the filter was once made for."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT range AS event_id, make_timestamp(range) AS ts, range AS user_id, CASE WHEN range % 2 = 0 THEN 'error' ELSE 'view' END AS event_type, 60.0::DOUBLE AS value, '' AS props FROM range(60000)) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = sorted(r.user_id for r in QUERIES["bloom_reject"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in con.sql(ORACLES["bloom_reject"]).fetchall()) == list(range(1, 60000, 2))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
