"""The numbered queries with SQL against it, and the pipeline stage by stage, on the smallest tables."""

import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from vellum.llm import queries
from vellum.llm.common import table, written

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        p = f"{SF}/{t}.parquet"
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert sorted(tuple(map(repr, r)) for r in got.select(*cols).collect()) == sorted(tuple(map(repr, r)) for r in want.select(*(f'"{c}"' for c in cols)).fetchall())


def test_numbered_queries():
    assert [int(k[2:].split("_")[0]) for k in sorted(queries.queries(), key=lambda k: int(k[2:].split("_")[0]))] == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, SF))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in docs.where("text IS NOT NULL").collect())
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    before, after = seen["toxicity"]
    left = {r["doc_id"] for r in after.collect()}
    assert all(i in left for i, y in toxic.items() if y == 0)
    before, after = seen["line dedup"]
    holders = defaultdict(set)
    for i, t in before.items():
        for x in t.split("\n"):
            if len(x.strip(" \t\n\v\f\r")) >= 10:
                holders[x.strip(" \t\n\v\f\r").lower()].add(i)
    for r in after.collect():
        assert len(before) == after.count()
        assert all(len(holders[x.strip(" \t\n\v\f\r").lower()]) < 2 or min(holders[x.strip(" \t\n\v\f\r").lower()]) == r["doc_id"] for x in r["text"].split("\n") if len(x.strip(" \t\n\v\f\r")) >= 10 and x.isascii())
    before, after = seen["near dedup"]
    left = {r["doc_id"]: r["text"] for r in after.collect()}
    assert len(set(left.values())) == len(left) and {min(i for i, t in before.items() if t == text) for text in left.values()} == set(left)
    before, after = seen["packing"]
    length = defaultdict(int)
    for r in after.collect():
        length[r["sequence_id"]] += r["length"]
        before.pop(r["doc_id"], None)
    assert not before and np.max(list(length.values())) <= 1024
