"""Registered queries of the samplers, with the SQL that draws the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspan.operators import sampling
from vecspan.operators import tables as T
from vecspan.plans import roles as R
from vecspan.plans.catalog import query


def _h(*parts: str) -> str:
    """SQL of sampling.hashed."""
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 15))::BIGINT"


def _ranks(name: str, n: int, total: str) -> str:
    low = lambda x: f"({x} * (t // n) + {x} * (t % n) // n)"
    return f"(SELECT {low('i')} + {_h(repr(name), 'i')} % ({low('(i + 1)')} - {low('i')}) AS rank FROM (SELECT {total} AS t, least({n}, {total}) AS n), unnest(range(0, n)) AS u(i))"


@query("j10_sampled_pairs", f"""
WITH {R.VEC}, p AS (SELECT utt, spk, row_number() OVER (PARTITION BY spk ORDER BY md5('5-row:' || utt), utt) - 1 AS place FROM vec WHERE spk IS NOT NULL AND utt IS NOT NULL),
c AS (SELECT spk, n, row_number() OVER (ORDER BY md5('5-group:' || spk), spk) - 1 AS no FROM (SELECT spk, count(*) AS n FROM p GROUP BY spk)),
k AS (SELECT *, n * (n - 1) // 2 AS pairs, sum(n) OVER (ORDER BY no)::BIGINT AS n_to, (sum(n) OVER () - sum(n) OVER (ORDER BY no))::BIGINT AS rest FROM c),
s AS (SELECT *, n_to - n AS n_from, (sum(pairs) OVER (ORDER BY no))::BIGINT AS t_to, (sum(n * rest) OVER (ORDER BY no))::BIGINT AS x_to, (sum(pairs) OVER ())::BIGINT AS t_all, (sum(n * rest) OVER ())::BIGINT AS x_all FROM k),
t AS (SELECT rank - (t_to - pairs) AS r, n_from FROM {_ranks('5-target', 3000, '(SELECT any_value(t_all) FROM s)')} JOIN s ON rank >= t_to - pairs AND rank < t_to),
u AS (SELECT *, (SELECT max(b) FROM range(1, 100000) q(b) WHERE b * (b - 1) // 2 <= r) AS b FROM t),
x AS (SELECT rank - (x_to - n * rest) AS r, n_from, n, rest FROM {_ranks('5-other', 4000, '(SELECT any_value(x_all) FROM s)')} JOIN s ON rank >= x_to - n * rest AND rank < x_to),
d AS (SELECT n_from + r - b * (b - 1) // 2 AS i, n_from + b AS j, true AS target FROM u UNION ALL SELECT n_from + r // rest, n_from + n + r % rest, false FROM x),
m AS (SELECT n_from + place AS at, utt FROM p JOIN s ON p.spk = s.spk)
SELECT y.utt AS a, z.utt AS b, target FROM d JOIN m y ON d.i = y.at JOIN m z ON d.j = z.at""")
def _(spark, d):
    return sampling.sample_pairs(R.vectors(spark, d), "utt", "spk", 3000, 4000, 5)


_SPEAKERS = "sp AS (SELECT DISTINCT c_nationkey AS spk FROM customer), kn AS (SELECT spk, row_number() OVER (ORDER BY md5('6-speaker:' || spk), spk) - 1 AS no, count(*) OVER () AS n FROM sp)"


@query("t07_open_set_pools", f"""
WITH {_SPEAKERS}, tr AS (SELECT t AS trial, {_h("'6:open'", 't')} % 1000000 < 300000 AS open FROM range(1, 201) r(t)),
k AS (SELECT *, unnest(range(0, size)) AS k FROM (SELECT *, 5 + open::INT AS size FROM tr)),
x AS (SELECT trial, open, k * n // size + {_h("'6:speaker'", 'trial', 'k')} % ((k + 1) * n // size - k * n // size) AS no FROM k, (SELECT any_value(n) AS n FROM kn))
SELECT trial, (row_number() OVER (PARTITION BY trial ORDER BY {_h("'6:order'", 'trial', 'x.no')}) - open::INT)::INT AS position, spk, NOT open AS target_in_gallery FROM x JOIN kn ON x.no = kn.no""")
def _(spark, d):
    speakers = R.table(spark, d, "customer").select(F.col("c_nationkey").alias("spk"))
    return sampling.open_set_pools(speakers, 200, 5, 6, 0.3)


@query("t10_labelled_trials", f"""
WITH {R.UTT}, bd AS (SELECT utt, spk, CASE WHEN dur > 2 AND dur < 6 THEN 'short' WHEN dur > 6 THEN 'long' END AS band FROM utt WHERE spk IS NOT NULL),
ok AS (SELECT * FROM bd WHERE band IS NOT NULL AND spk IN (SELECT spk FROM bd WHERE band IS NOT NULL GROUP BY spk HAVING count(DISTINCT band) = 2)),
kn AS (SELECT spk, row_number() OVER (ORDER BY md5('8-speaker:' || spk), spk) - 1 AS no, count(*) OVER () AS total FROM (SELECT DISTINCT spk FROM ok)),
nu AS (SELECT *, row_number() OVER (PARTITION BY spk, band ORDER BY md5('8-utt:' || utt), utt) - 1 AS place, count(*) OVER (PARTITION BY spk, band) AS n FROM ok),
dr AS (SELECT i, {_h("'8:first'", 'i')} % total AS first, total FROM range(0, 500) r(i), (SELECT any_value(total) AS total FROM kn)),
dd AS (SELECT i, first, (first + 1 + {_h("'8:second'", 'i')} % (total - 1)) % total AS second FROM dr),
w AS (SELECT i, a || '-' || b AS kind, role, CASE role WHEN 'nontarget' THEN second ELSE first END AS no, CASE role WHEN 'enroll' THEN a ELSE b END AS band
  FROM dd, (VALUES ('short', 'short'), ('short', 'long'), ('long', 'long')) q(a, b), (VALUES ('enroll'), ('target'), ('nontarget')) z(role)),
f AS (SELECT w.i, w.kind, w.role, nu.utt FROM w JOIN kn ON w.no = kn.no JOIN nu ON nu.spk = kn.spk AND nu.band = w.band AND nu.place = {_h("'8:utt'", 'w.i', 'w.kind', 'w.role')} % nu.n)
SELECT e.i, e.kind, e.utt AS enroll, t.utt AS test, t.role = 'target' AS target FROM f e JOIN f t ON e.i = t.i AND e.kind = t.kind AND e.role = 'enroll' AND t.role <> 'enroll'""")
def _(spark, d):
    u = R.utterances(spark, d).where("spk is not null")
    return sampling.labelled_trials(T.bands(u, "spk"), 500, 8)


_CONDITIONS = [(2, 1), (5, 4), (20, 10), (40, 30)]


@query("b16_duration_sweep", f"""
WITH {R.VEC}, p AS (SELECT spk, v, row_number() OVER (PARTITION BY spk ORDER BY utt) - 1 AS place, count(*) OVER (PARTITION BY spk) AS n FROM vec WHERE v IS NOT NULL AND spk IS NOT NULL),
c(enrol, probe) AS (VALUES {', '.join(map(str, _CONDITIONS))}),
x AS (SELECT spk, enrol, probe, i, sum(v[i]) FILTER (WHERE place < enrol) AS g, sum(v[i]) FILTER (WHERE place >= greatest(n - probe, enrol + 1) AND place < greatest(n - probe, enrol + 1) + probe) AS s
  FROM p, c, range(1, 65) r(i) WHERE n >= enrol + 1 + probe GROUP BY spk, enrol, probe, i),
u AS (SELECT spk, enrol, probe, i, g / sqrt(sum(g * g) OVER w) AS g, s / sqrt(sum(s * s) OVER w) AS s FROM x WINDOW w AS (PARTITION BY spk, enrol, probe)),
k AS (SELECT a.spk AS a, b.spk AS b, enrol, probe FROM (SELECT DISTINCT spk FROM p) a JOIN (SELECT DISTINCT spk FROM p) b ON a.spk < b.spk, c),
d AS (SELECT k.a, k.b, k.enrol, k.probe, sum(y.s * y.g) >= sum(y.s * z.g) AS ra, sum(z.s * z.g) > sum(z.s * y.g) AS rb
  FROM k LEFT JOIN u y ON k.a = y.spk AND k.enrol = y.enrol AND k.probe = y.probe LEFT JOIN u z ON k.b = z.spk AND k.enrol = z.enrol AND k.probe = z.probe AND y.i = z.i GROUP BY k.a, k.b, k.enrol, k.probe)
SELECT enrol, probe, count(*) AS pairs, count(*) FILTER (WHERE ra IS NULL) AS skipped, coalesce(sum(ra::INT + rb::INT), 0)::BIGINT AS correct,
  coalesce(sum(ra::INT + rb::INT), 0)::DOUBLE / nullif(2 * count(*) FILTER (WHERE ra IS NOT NULL), 0) AS accuracy FROM d GROUP BY enrol, probe""")
def _(spark, d):
    from vecspan.operators.durations import two_speaker_sweep

    return two_speaker_sweep(R.vectors(spark, d), _CONDITIONS, 1, 20_000, 4)
