from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tideflow.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    got = queries()[name](spark, str(DATA))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    rows = con.sql(oracle_sql()[name]).select(*sorted(got.columns)).fetchall()
    assert Counter(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == Counter(rows)
