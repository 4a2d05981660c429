import duckdb

import __spark_entry__ as entry
from tests.llm.fixtures import SF
from tests.test_queries import TABLES, rows


def test_all_queries_and_the_pipeline_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            got = entry.queries()[name](spark, SF).toPandas()
            same = rows(got) == rows(con.execute(sql).df())
            assert same, name
