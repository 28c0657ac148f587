"""Queries of the text operators against SQL, and held-out quality of the learned ones."""

import pytest

from tests.oracle import DATA, assert_same
from vecspan.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, name):
    assert_same(Q.QUERIES[name](spark, DATA), Q.SQL[name])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    found = sum(r["predicted"] for r in rows if r["toxic"] == 1)
    wrong = sum(r["predicted"] for r in rows if r["toxic"] == 0)
    assert found >= 0.5 * sum(r["toxic"] == 1 for r in rows) and wrong <= 0.05 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_language_held_out(spark):
    rows = Q.op3_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
