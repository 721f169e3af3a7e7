"""Every registered query of the library's own jobs against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from vellum.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(want.columns) == cols
    rows = sorted(tuple(map(repr, r)) for r in got.select(*(f"`{c}`" for c in cols)).collect())
    assert rows == sorted(tuple(map(repr, r)) for r in want.select(*(f'"{c}"' for c in cols)).fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


def test_whole_texts_keep_every_line_of_long_documents(spark):
    from vellum.operators import notation
    from vellum.sources.adapters import WHOLE, oracle, view

    lines, docs = [(1, i, f"line {i}") for i in range(150)] + [(2, 0, "one")], [(1,), (2,)]
    whole = view(spark, WHOLE, marked=spark.createDataFrame(lines, "work_id bigint, no int, line string"), documents=spark.createDataFrame(docs, "doc_id bigint"))
    got = {(r["work_id"], r["no"]): r["line"] for r in whole.collect()}
    assert [got[1, i + 6] for i in range(150)] == [f"line {i}" for i in range(150)]
    assert got[1, 157] == "底本：「Collected」  " and got[2, 8] == "底本：「Collected」  " and len(got) == 150 + 1 + 2 * 10
    body = notation.split_sections(whole).where("work_id = 1 AND section = 'body'")
    assert body.count() == 151
    duck = duckdb.connect()
    duck.sql("CREATE TABLE m AS SELECT 1 AS work_id, CAST(i AS INT) AS no, 'line ' || i AS line FROM range(150) t(i) UNION ALL SELECT 2, 0, 'one'")
    duck.sql("CREATE TABLE d AS SELECT unnest([1, 2]) AS doc_id")
    assert {(r[0], r[1]): r[2] for r in duck.sql(oracle(WHOLE, marked="m", documents="d")).fetchall()} == got
