"""Queries of this subpackage against their SQL."""

import duckdb
import pytest

from tessella.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_warc", "op5_quality_rules", "op7_chat_format"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == want
