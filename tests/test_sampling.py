"""Samples by unranking: exact numbers, no repeats, all pairs where as many are asked for, and errors."""

from collections import Counter, defaultdict

import pytest

from vecspan.operators import sampling as P


def rows(spark):
    return spark.createDataFrame([(k, "hot" if k % 10 else f"s{k % 4}") for k in range(300)] + [(900, None), (901, "alone")], "utt long, spk string").repartition(3)


def test_all_pairs(spark):
    spk = {r["utt"]: r["spk"] for r in rows(spark).where("spk is not null").collect()}
    got = [tuple(x) for x in P.sample_pairs(rows(spark), "utt", "spk", 10**6, 10**6, 3).collect()]
    keys = sorted(spk)
    want = {(a, b): spk[a] == spk[b] for i, a in enumerate(keys) for b in keys[i + 1 :]}
    assert len(got) == len(want) and {tuple(sorted(x[:2])): x[2] for x in got} == want


def test_sampled_pairs(spark):
    spk = {r["utt"]: r["spk"] for r in rows(spark).collect()}
    got = [tuple(x) for x in P.sample_pairs(rows(spark), "utt", "spk", 500, 70, 3).collect()]
    assert len({frozenset(x[:2]) for x in got}) == len(got) == 570 and Counter(x[2] for x in got) == {True: 500, False: 70}
    assert all((spk[a] == spk[b]) == t and a != b for a, b, t in got)
    assert P.sample_pairs(rows(spark).limit(0), "utt", "spk", 5, 5, 3).count() == 0
    one = rows(spark).selectExpr("utt", "'all' as spk")  # pairs of rows without groups
    assert P.sample_pairs(one, "utt", "spk", 40, 40, 1).groupBy("target").count().collect() == [(True, 40)]


def test_ranks_are_spread(spark):
    for n, total in ((7, 100), (100, 100), (200, 30), (1, 5), (3, 0)):
        ranks = [r["rank"] for r in P.spread_ranks(spark, n, total, 4).orderBy("i").collect()]
        assert ranks == sorted(set(ranks)) and len(ranks) == min(n, total) and all(0 <= r < total for r in ranks)


def test_pools(spark):
    speakers = spark.createDataFrame([(f"s{k}",) for k in range(9)], "spk string")
    pools = defaultdict(dict)
    for r in P.open_set_pools(speakers, 300, 8, 1, 0.25).collect():
        pools[r["trial"], r["target_in_gallery"]][r["position"]] = r["spk"]
    assert len(pools) == 300 and 40 < sum(not closed for _, closed in pools) < 110
    for (_, closed), found in pools.items():
        assert sorted(found) == list(range(1 if closed else 0, 9)) and len(set(found.values())) == len(found)
    with pytest.raises(ValueError, match="10 eligible"):
        P.open_set_pools(speakers, 3, 9, 1, 0.25)
    assert P.open_set_pools(speakers, 3, 9, 1).count() == 27


def test_labelled_trials(spark):
    utts = spark.createDataFrame([(f"{s}-{b}-{k}", s, b) for s in ("a", "b", "c") for b in ("short", "long") for k in range(3)] + [("d-short-0", "d", "short"), ("n", None, "long")], "utt string, spk string, band string")
    got = P.labelled_trials(utts, 50, 2).collect()
    assert len(got) == 300 and Counter(r["kind"] for r in got) == {f"{a}-{b}": 100 for a, b in P.KINDS}
    enrolled = defaultdict(set)
    for r in got:
        (s, a, _), (u, b, _) = r["enroll"].split("-"), r["test"].split("-")
        assert f"{a}-{b}" == r["kind"] and (s == u) == r["target"] and "d" not in (s, u)
        enrolled[r["i"], r["kind"]].add(r["enroll"])
    assert all(len(x) == 1 for x in enrolled.values())
    with pytest.raises(ValueError, match="two speakers"):
        P.labelled_trials(utts.where("spk = 'a'"), 5, 2)
