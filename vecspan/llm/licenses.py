"""License scans: phrases that stand in the text, and blocks that contain enough of a license template.

The second is an exact set-similarity join of text blocks (lines) with templates by containment
|block & template| / |template| >= THRESHOLD. Tokens are ordered by how many documents hold them, rarest
first. A block that reaches the overlap o = ceil(THRESHOLD * |template|) must hold one of the template's
first |template| - o + 1 tokens in that order (prefix filter), must have o tokens (length filter), and from a
shared token on both must have enough tokens left (positional filter). What remains is verified exactly.

Notices that are wrapped over lines are found by windows of as many words as the template has, in texts that as a
whole hold o tokens of it: a window that reaches o holds a prefix token, so only windows about these are tried.
Texts are tokenised once; of those that hold enough for some template the words are kept with their line numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspan.llm.common import materialize

THRESHOLD = 0.8

#: Phrases whose words stand one after the other (fixed values), with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Templates: short notices by which texts and files name their license (fixed values), with their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "licensed under a creative commons attribution sharealike license": "cc-by-sa",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII characters other than digits and lower-case letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the lower-cased text: runs of digits, a-z and all characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Indexes from 0 at which the phrase's words stand in a row."""
    parts = phrase.split()

    def here(word: Column, i: Column) -> Column:
        hit = word == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return hit

    starts = F.transform(words, lambda w, i: F.when(here(w, i), i))
    return F.when(F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1]), F.array_compact(starts)).otherwise(F.array().cast("array<int>"))


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _part(array: str, first: Column, last: Column) -> Column:
    """Elements first .. last (from 0), in time of their number; slice() copies the whole array."""
    return F.transform(F.sequence(first, last), lambda i: F.get(array, i))


def token_documents(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents of (words) each token of the vocabulary stands; all documents count."""
    held = docs.select(F.explode(F.array_intersect("words", _literal(vocabulary))).alias("token"))
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}  # at most the vocabulary


def template_blocks(rows: DataFrame, documents: dict[str, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The join: row, line, begin_word, template, label, containment for every block that meets the threshold.

    rows has row and blocks (array of struct line, begin_word, words), of which only those need be there that
    hold a prefix token (see prefix_tokens). documents orders the tokens; any order gives the same result.
    """
    spark = rows.sparkSession
    sets = {t: sorted(set(t.split()), key=lambda w: (documents.get(w, 0), w)) for t in templates}
    vocabulary = sorted({w for s in sets.values() for w in s}, key=lambda w: (documents.get(w, 0), w))
    index = []
    for template, tokens in sets.items():
        need = math.ceil(threshold * len(tokens) - 1e-9)
        index += [(w, template, i, len(tokens), need) for i, w in enumerate(tokens[: len(tokens) - need + 1])]
    index = F.broadcast(spark.createDataFrame(index, "token string, template string, at int, size int, need int"))
    fixed = F.broadcast(spark.createDataFrame([(t, s, templates[t]) for t, s in sets.items()], "template string, tokens array<string>, label string"))
    block = rows.select("row", F.explode("blocks").alias("block")).select("row", "block.line", "block.begin_word", F.array_distinct("block.words").alias("words"))
    block = block.withColumn("ordered", F.array_intersect(_literal(vocabulary), "words"))  # rarest first
    tokens = block.select("row", "line", "begin_word", "ordered", F.size("words").alias("n_words"), F.posexplode("ordered").alias("pos", "token"))
    shared = tokens.join(index, "token")
    shared = shared.where("n_words >= need")
    shared = shared.where(F.lit(1) + F.least(F.col("size") - F.col("at") - 1, F.size("ordered") - F.col("pos") - 1) >= F.col("need"))
    pairs = shared.groupBy("row", "line", "begin_word", "template").agg(F.first("ordered").alias("ordered"), F.first("need").alias("need"), F.first("size").alias("size"))
    checked = pairs.join(fixed, "template").withColumn("overlap", F.size(F.array_intersect("ordered", "tokens"))).where("overlap >= need")
    return checked.select("row", "line", "begin_word", "template", "label", (F.col("overlap") / F.col("size")).alias("containment"))


def prefix_tokens(documents: dict[str, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Tokens one of which every block must hold that meets the threshold for a template."""
    out: set[str] = set()
    for template in templates:
        tokens = sorted(set(template.split()), key=lambda w: (documents.get(w, 0), w))
        out.update(tokens[: len(tokens) - math.ceil(threshold * len(tokens) - 1e-9) + 1])
    return sorted(out)


def template_windows(rows: DataFrame, documents: dict[str, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """row, line, last_line, begin_word, template, label, containment of windows that meet the threshold.

    rows has row, words, line_of (the line of each word) and held (the templates to look for). A window of the
    template's number of words that meets the threshold still does when it begins at its first token of the template,
    and it holds a prefix token, so only such starts are tried. Windows that overlap are joined to one place, which
    has the first begin, the last line and the best containment.
    """
    fixed = []
    for template, label in templates.items():
        tokens = sorted(set(template.split()), key=lambda w: (documents.get(w, 0), w))
        need = math.ceil(threshold * len(tokens) - 1e-9)
        fixed.append((template, tokens, tokens[: len(tokens) - need + 1], len(template.split()), need, label))
    kind = "template string, tokens array<string>, prefix array<string>, n int, need int, label string"
    fixed = F.broadcast(rows.sparkSession.createDataFrame(fixed, kind))
    near = rows.select("row", "words", "line_of", F.explode("held").alias("template")).join(fixed, "template")
    places = F.array_compact(F.transform("words", lambda w, i: F.when(F.array_contains("prefix", w), i)))
    tried = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(p - F.col("n") + 1, F.lit(0)), p))))
    starts = F.array_sort(F.filter(tried, lambda i: F.array_contains("tokens", F.get("words", i))))

    def window(i: Column) -> Column:
        last = F.least(i + F.col("n"), F.size("words")) - 1
        return F.struct(
            i.alias("begin_word"),
            F.size(F.array_intersect(_part("words", i, last), "tokens")).alias("overlap"),
            F.get("line_of", i).alias("line"),
            F.get("line_of", last).alias("last_line"),
        )

    def joined(found: Column, w: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        apart = last.isNull() | (w["begin_word"] >= last["end"])
        wider = F.struct(
            last["begin_word"].alias("begin_word"),
            F.greatest(last["overlap"], w["overlap"]).alias("overlap"),
            last["line"].alias("line"),
            w["last_line"].alias("last_line"),
            (w["begin_word"] + F.col("n")).alias("end"),
        )
        own = F.struct(w["begin_word"].alias("begin_word"), w["overlap"].alias("overlap"), w["line"].alias("line"), w["last_line"].alias("last_line"), (w["begin_word"] + F.col("n")).alias("end"))
        return F.when(apart, F.concat(found, F.array(own))).otherwise(F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(wider)))

    near = near.withColumn("hits", F.filter(F.transform(starts, window), lambda w: w["overlap"] >= F.col("need")))
    none = F.array().cast("array<struct<begin_word:int,overlap:int,line:int,last_line:int,end:int>>")
    near = near.where(F.size("hits") > 0).select("row", "template", "label", F.size("tokens").alias("size"), F.explode(F.aggregate("hits", none, joined)).alias("w"))
    return near.select("row", "w.line", "w.last_line", "w.begin_word", "template", "label", (F.col("w.overlap") / F.col("size")).alias("containment"))


def _line_blocks(candidates: DataFrame, prefix: list[str]) -> DataFrame:
    """row and blocks (line, begin_word, words) of the lines that hold a prefix token."""
    first = F.transform("line_of", lambda x, i: F.when((i == 0) | (F.get("line_of", i - 1) != x), i))
    firsts = candidates.select("row", "words", "line_of", F.array_compact(first).alias("firsts"))
    ends = F.concat(F.slice("firsts", F.lit(2), F.greatest(F.size("firsts"), F.lit(1))), F.array(F.size("words")))

    def block(begin: Column, end: Column) -> Column:
        return F.struct(F.get("line_of", begin).alias("line"), begin.alias("begin_word"), _part("words", begin, end - 1).alias("words"))

    lines = F.zip_with("firsts", ends, block)  # a lambda over firsts would work them out anew for each line
    return firsts.select("row", F.filter(lines, lambda b: F.arrays_overlap(b["words"], _literal(prefix))).alias("blocks"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    n_base counts the places of all phrases; first_word and last_word are the smallest and largest of their
    starts. blocks lists the matched lines (line, begin_word, template, label, containment), and the places of windows
    over lines none of which matches the template by itself, under their first line. score is 1 with a phrase, else
    the largest containment of a line or window, else 0. Null text is empty; it and texts without a word have no
    place and no label (empty strings). Repeated rows each give a row; an empty table gives an empty result.
    Other columns are ignored.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.withColumn("words", words_of(F.col("text")))
    vocabulary = sorted({w for t in templates for w in t.split()})
    starts = {p: F.col(f"_{k}") for k, p in enumerate(phrases)}
    for k, p in enumerate(phrases):
        rows = rows.withColumn(f"_{k}", _phrase_starts(F.col("words"), p))
    places = F.concat(*starts.values())
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(phrases[p])) for p, c in starts.items()]))
    rows = rows.withColumn("tokens", F.array_intersect(_literal(vocabulary), "words"))
    needs = {t: math.ceil(threshold * len(set(t.split())) - 1e-9) for t in templates}
    held = F.array_compact(F.array(*[F.when(F.size(F.array_intersect("tokens", _literal(sorted(set(t.split()))))) >= need, F.lit(t)) for t, need in needs.items()]))
    rows = rows.withColumn("held", held)
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.sort_array(places).alias("places"), F.array_sort(F.array_distinct(labels)).alias("base"), "tokens", "held", F.when(F.size("held") > 0, F.col("text")).alias("text"))
    rows = materialize(rows, "scanned")
    documents = token_documents(rows.select(F.col("tokens").alias("words")), vocabulary)

    lines = rows.where("text is not null").select("row", "held", F.transform(F.split("text", "\n"), words_of).alias("lines"))
    placed = F.flatten(F.transform("lines", lambda ws, i: F.transform(ws, lambda _: i.cast("int"))))
    candidates = materialize(lines.select("row", "held", F.flatten("lines").alias("words"), placed.alias("line_of")), "candidates")
    found = materialize(template_blocks(_line_blocks(candidates, prefix_tokens(documents, templates, threshold)), documents, templates, threshold), "lines")
    windows = materialize(template_windows(candidates, documents, templates, threshold), "windows")
    best = found.select("row", "label", "containment").unionByName(windows.select("row", "label", "containment"))
    best = best.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("own"), F.max("containment").alias("best"))
    same = found.select("row", "template", F.col("line").alias("at"))
    wraps = windows.where("line < last_line")
    over = (wraps["row"] == same["row"]) & (wraps["template"] == same["template"]) & same["at"].between(wraps["line"], wraps["last_line"])
    blocks = found.unionByName(wraps.join(same, over, "left_anti").drop("last_line"))
    blocks = blocks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("line", "begin_word", "template", "label", "containment"))).alias("blocks"))
    out = rows.drop("text", "tokens", "held").join(best, "row", "left").join(blocks, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0)).cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array())))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.array()).alias("blocks"),
    )
