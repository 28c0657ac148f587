"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm import exact_dedup, language, licenses, mixing, near_dedup, packing, quality, shortest_pack, spelling, substring_dedup, toxicity, training_order, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_documents(spark, sf_dir))


#: Words as regular expression, the same in Java and RE2.
_WORD = "[^\\x20\\x09-\\x0D]+"

OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), sources AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0)) /
            (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM sources WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * (SELECT arg_min(level, 3.0::DOUBLE * source_size / weight) FROM levels WHERE level * weight <= 3.0::DOUBLE * source_size)) AS target
  FROM levels
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5) AS need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS UNBOUNDED PRECEDING) - s.size AS pos
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, coalesce(target, 0) AS target,
       (greatest(0, least(size, need - pos)) + greatest(0, least(size, need - source_size - pos)) + greatest(0, least(size, need - 2 * source_size - pos)))::BIGINT AS taken
FROM placed
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_windows", "n_toxic")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = language.language_spans(docs, language.fit(docs))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.duplicate_passages(_documents(spark, sf_dir))
    words = F.transform("removed", lambda r: r["n_words"].cast("long"))
    return found.select(
        "doc_id",
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x).alias("removed_words"),
        F.coalesce(F.array_max(words), F.lit(0)).alias("longest_removed"),
        F.array_min(F.transform("removed", lambda r: r["begin"].cast("long"))).alias("first_begin"),
        F.array_max(F.transform("removed", lambda r: r["end"].cast("long"))).alias("last_end"),
        "kept",
    )


OP4_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '{substring_dedup.PIECE}') AS pieces FROM documents),
p AS (SELECT row, doc_id, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece FROM t),
u AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY i) AS unit FROM (
    SELECT row, doc_id, i, regexp_extract_all(lower(piece), '{substring_dedup.WORD}') AS words,
           sum(length(piece)) OVER (PARTITION BY row ORDER BY i) - length(piece) AS first, sum(length(piece)) OVER (PARTITION BY row ORDER BY i) AS last FROM p
  ) WHERE len(words) > 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id NULLS LAST, row, unit) AS rank FROM u
), r AS (
  SELECT row, sum(len(words)) AS n, min(first) AS first, max(last) AS last FROM (SELECT *, unit - row_number() OVER (PARTITION BY row ORDER BY unit) AS island FROM k WHERE rank > 1)
  GROUP BY row, island HAVING sum(len(words)) >= {substring_dedup.MIN_WORDS}
), d AS (SELECT row, count(*) AS n_removed, sum(n) AS removed_words, max(n) AS longest, min(first) AS first, max(last) AS last FROM r GROUP BY row),
n AS (SELECT row, count(*) AS n_units FROM u GROUP BY row)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_words, 0)::BIGINT AS removed_words,
       coalesce(longest, 0)::BIGINT AS longest_removed, first::BIGINT AS first_begin, last::BIGINT AS last_end, n_removed IS NULL AS kept
FROM t LEFT JOIN n ON t.row = n.row LEFT JOIN d ON t.row = d.row
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir)).drop("blocks")


def _op5_sql() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({t.split()}, '{label}')" for t, label in licenses.TEMPLATES.items())
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, {lower} AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '{word}') AS words FROM t),
p(phrase, label) AS (VALUES {phrases}),
b AS (
  SELECT row, i - 1 AS start, label FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE contains(text, 'license') OR contains(text, 'cc')), p
  WHERE words[i:i + len(phrase) - 1] = phrase
), base AS (
  SELECT row, count(*) AS n, min(start) AS first, max(start) AS last, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY row
), tpl(words, label) AS (VALUES {templates}),
l AS (SELECT row, list_distinct(regexp_extract_all(line, '{word}')) AS words FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM w)),
m AS (
  SELECT row, tpl.label, len(list_intersect(l.words, tpl.words)) / len(list_distinct(tpl.words)) AS containment FROM l, tpl
  WHERE len(list_intersect(l.words, tpl.words)) >= ceil(0.8 * len(list_distinct(tpl.words)) - 1e-9)
), h AS (
  SELECT row, w.words AS words, tpl.words AS tokens, label, len(tpl.words) AS n, len(list_distinct(tpl.words)) AS size FROM w, tpl
  WHERE len(list_intersect(w.words, tpl.words)) >= ceil(0.8 * len(list_distinct(tpl.words)) - 1e-9)
), s AS (
  SELECT row, label, len(list_intersect(words[i:i + n - 1], tokens)) / size AS containment FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM h)
  WHERE list_contains(tokens, words[i])
), method AS (
  SELECT row, list(label) AS labels, max(containment) AS best FROM (
    SELECT row, label, containment FROM m UNION ALL SELECT row, label, containment FROM s WHERE containment >= 0.8 - 1e-9
  ) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
       array_to_string(coalesce(base.labels, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN base ON w.row = base.row LEFT JOIN method ON w.row = method.row
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_order.materialize_order(_documents(spark, sf_dir))
    return rows.select("slot", "shard", "place", "doc_id", "piece", "n_tokens", "ids_crc32", F.crc32("ids").alias("row_crc32"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(_documents(spark, sf_dir))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT row, i, array_to_string(words[i:i + 4], chr(1)) AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
c AS (SELECT row, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS o(k) GROUP BY row),
f AS (
  SELECT w.row, doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c ON w.row = c.row
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         [(n_words < 10)::INT, (100 * n_repeat_words > 20 * n_words)::INT, (10 * n_symbols > n_words)::INT,
          (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT, (100 * n_dup_lines > 30 * n_lines)::INT] AS fails FROM f
), h AS (
  SELECT source, k, count(*) AS n, sum(fails[k]) AS bad FROM v, range(1, 6) AS o(k) GROUP BY source, k
), m AS (
  SELECT *, var - mean * (1 - mean) * per_doc AS between_hosts FROM (
    SELECT k, least(greatest(avg(bad / n), 1e-6), 1 - 1e-6) AS mean, var_pop(bad / n) AS var, avg(1 / n) AS per_doc FROM h GROUP BY k
  )
), s AS (
  SELECT source, bool_and((bad + mean * strength) / (n + strength) <= least(0.5, mean + 3 * sqrt(mean * (1 - mean) / (strength + 1)) + 0.05)) AS host_kept
  FROM h JOIN (SELECT k, mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1e6) ELSE 1e6 END AS strength FROM m) p ON h.k = p.k GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM v JOIN s ON v.source IS NOT DISTINCT FROM s.source
"""

def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir))


OP11_SQL = """
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents
  ) GROUP BY doc_id, run
), coded AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM coded, table_of
), cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM near GROUP BY word
), forms AS (
  SELECT b.word, min(e.other) AS form, b.form_n FROM best b JOIN words w ON b.word = w.word JOIN near e ON e.word = b.word AND e.other_n = b.form_n
  WHERE b.form_n >= 5 * w.n GROUP BY b.word, b.form_n
), steps AS (
  SELECT word, form AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.root = f.word
), roots AS (
  SELECT s.word, s.root FROM steps s LEFT JOIN forms f ON s.root = f.word WHERE f.word IS NULL
)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN forms f ON w.word = f.word LEFT JOIN roots r ON w.word = r.word
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortest_pack.pack(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_training_order": op7_training_order,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_near_dedup": op10_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitening": op12_whitening,
    "op13_shortest_pack": op13_shortest_pack,
}
SQL: dict[str, str] = {
    "op1_source_mixing": OP1_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_license_scan": _op5_sql(),
    "op6_exact_dedup": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op11_spelling_variants": OP11_SQL,
}
