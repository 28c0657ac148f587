"""Every query of the reference's operators against its SQL at the smallest scale; the others give rows."""

from collections import defaultdict
from itertools import permutations

import pytest

import __spark_entry__ as entry_module
from tests.oracle import DATA, assert_same
from vecspan.plans import catalog
from vecspan.plans import roles as R


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, DATA), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 1 and 0.3 < rows[0]["eer"] < 0.7
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_interval_queries_use_every_interval(spark):
    """Whole tables on both sides, against plain sums over all pairs of intervals."""
    iv = R.intervals(spark, DATA).collect()
    total, best = defaultdict(int), {}
    for a in iv:
        for b in iv:
            shared = min(a["e"], b["e"] + 900) - max(a["b"], b["b"] + 300)
            if a["rec"] == b["rec"] and shared > 0:
                total[a["rec"], a["label"], "h-" + b["label"]] += shared
    for rec in {k[0] for k in total}:
        names, others = (sorted({k[i] for k in total if k[0] == rec}) for i in (1, 2))
        best[rec] = max(sum(total[rec, x, y] for x, y in zip(names, p)) for p in permutations(others, len(names)))
    got = defaultdict(int)
    for r in catalog.QUERIES["c07_label_mapping"](spark, DATA).collect():
        got[r["rec"]] += total[r["rec"], r["label_a"], r["mapped"]]
    assert dict(got) == best
    segments = {r["seg"] for r in catalog.QUERIES["u03_every_segment_row"](spark, DATA).collect()}
    assert segments == {f"{r['rec']}-{r['id']}" for r in iv} | {f"{r['rec']}-whole" for r in iv}
    assert catalog.QUERIES["der_error_rate_whole"](spark, DATA).count() == len({r["rec"] for r in iv})
