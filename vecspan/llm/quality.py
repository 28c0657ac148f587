"""Quality rules with host-level verdicts: failures per host, shrunk by an empirical beta prior."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspan.llm.common import bounded_join, materialize

#: Text features: words are runs of other characters than space and the controls 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 5

#: Document rules whose failures are counted by host. Each is true where a document fails.
RULES = {
    "few_words": "n_words < 10",
    "repetition": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}

#: A host is rejected if its shrunk failure rate of any rule is above the rule's limit: the prior's mean, some of its
#: standard deviations and a margin, and MAX_HOST_RATE at most.
PRIOR_DEVIATIONS, MARGIN, MAX_HOST_RATE = 3.0, 0.05, 0.5


def text_features(df: DataFrame, text: Column) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long).

    n_repeat_words counts the words that lie in a five-word window found twice or more in the text.
    Null text has no words; every count is 0.
    """
    df = df.withColumn("_text", F.coalesce(text.cast("string"), F.lit("")))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE + "+"), ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    window = F.transform(
        F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
    )
    df = df.withColumn("_grams", window)
    df = df.withColumn("_again", F.size("_grams") > F.size(F.array_distinct("_grams")))
    ordered = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.col("_again"), ordered))
    twice = F.transform(
        "_sorted",
        lambda s, j: F.when((F.get("_sorted", j - 1)["h"] == s["h"]) | (F.get("_sorted", j + 1)["h"] == s["h"]), s["i"]),
    )
    df = df.withColumn("_at", F.sort_array(F.array_compact(twice)))
    covered = F.aggregate(
        F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    n_lines = F.size("_lines")
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        n_lines.cast("long").alias("n_lines"),
        (n_lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_again"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: host, n_docs, fail_<rule> counts, rate_<rule> shrunk rates, host_kept.

    docs has host and one boolean column fail_<rule> per rule. The prior of each rule is a beta
    distribution with the mean of the hosts' raw rates and their variance less what chance alone gives hosts of
    their sizes (method of moments); a host's rate is the posterior mean, so that hosts of few documents are drawn
    towards the mean. A host is rejected if a rate lies far out in the prior. The null host is a host.
    """
    names = list(RULES)
    hosts = docs.groupBy("host").agg(
        F.count("*").alias("n_docs"),
        *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"fail_{r}") for r in names],
    )
    hosts = materialize(hosts, "hosts")
    raw = {r: F.col(f"fail_{r}") / F.col("n_docs") for r in names}
    moments = hosts.agg(
        *[F.avg(raw[r]).alias(f"m_{r}") for r in names],
        *[F.var_pop(raw[r]).alias(f"v_{r}") for r in names],
        F.avg(1 / F.col("n_docs")).alias("per_doc"),
    ).first()
    rates, limits = [], []
    for r in names:
        mean, var = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        between = var - mean * (1 - mean) * (moments["per_doc"] or 0.0)
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
        limits.append(min(max_rate, mean + PRIOR_DEVIATIONS * math.sqrt(mean * (1 - mean) / (strength + 1)) + MARGIN))
        rates.append(((F.col(f"fail_{r}") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))).alias(f"rate_{r}"))
    hosts = hosts.select("*", *rates)
    within = [F.col(f"rate_{r}") <= limit for r, limit in zip(names, limits, strict=True)]
    return hosts.withColumn("host_kept", reduce(Column.__and__, within))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per input row: doc_id, host, the text features, base_failed, host_kept, kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows. A document is kept if
    it did not fail and its host is kept. Null text fails. Repeated rows each give a row and each count for
    their host; an empty table gives an empty result. host is by default the column source; null is a host
    of its own. Other columns are ignored.
    """
    host = F.col("source") if host is None else host
    rows = text_features(docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), F.col(text_col).alias("body")), F.col("body"))
    rows = rows.drop("body").select("*", *[F.expr(rule).alias(f"fail_{r}") for r, rule in RULES.items()])
    rows = rows.withColumn("host", F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("")))
    rows = materialize(rows, "features")
    verdicts = materialize(host_verdicts(rows, max_rate).select("host", "host_kept"), "verdicts")
    out = bounded_join(rows, verdicts, "host")
    base = F.col("fail_few_words") | F.col("fail_repetition")
    out = out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
    host_back = F.when(F.col("host") != "", F.substring("host", 2, 1 << 30))
    return out.select("doc_id", host_back.alias("host"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_kept", "kept")
