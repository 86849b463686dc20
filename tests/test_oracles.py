"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_query_matches_its_oracle(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = sorted(repr({c: plain(r[c]) for c in sorted(df.columns)}) for r in df.collect())
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr({c: plain(v) for c, v in sorted(zip(cols, r, strict=True))}) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["chunk_documents", "html_list_items", "html_table_faq", "citation_permute", "rag_pipeline"])
def test_other_queries_run(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
