"""Spelling variants: words one edit apart, through a forward and a reversed sorted dictionary.

One inserted, deleted or replaced code point leaves the first or the last half of a word whole. So every word is
entered into a dictionary sorted by its first half and into one sorted by its reversed last half, and words
one edit apart lie in one block of equal halves there. Blocks of more words than a task should compare are
subdivided: the edit lies in the part that the block does not fix, whose first or last half again is whole, so the
block's words are entered anew with a longer beginning and with a longer end. This goes on until at most one code
point is left free, and loses no pair. The blocks are then scanned in sorted order and their pairs verified.

A block is of words of some length m and of m + 1, so a word is entered once as the shorter word of a pair
and once as the longer one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspan.llm.common import bounded_join, materialize

#: A run of letters: A-Z, a-z and the code points from U+00C0 to U+00FF, all of which Latin-1 holds.
RUN = "[A-Za-zÀ-ÿ]+"
#: The edit: a document's run whose checksum this divides loses a code point.
DAMAGE = 199
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs at least this many times as often as the word.
FORM_FACTOR = 5
#: Words of a block above which it is subdivided.
BLOCK_WORDS = 128
#: Different words a task counts before it passes the counts on.
COUNTED_WORDS = 200_000


def document_words(doc_id: int | None, text: str | None, pattern) -> Counter:
    """Occurrences of the words of a text: its runs, A-Z lower-cased, some without one of their code points."""
    runs = Counter(pattern.findall((text or "").encode().lower().decode()))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LENGTH:
            out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least MIN_LENGTH code points with at least MIN_COUNT occurrences."""

    def count(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        pattern, known = re.compile(RUN), Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                known.update(document_words(doc_id, text.as_py(), pattern))
                if len(known) > COUNTED_WORDS:
                    yield passed()
                    known.clear()
        yield passed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= MIN_COUNT)


def _entry(short: Column, head: Column, tail: Column, bar: Column) -> Column:
    """Of a word: the block it lies in, among words that share the first `head` and last `tail` code points.

    short is the length of the block's shorter words. bar: pairs with at least so many first code points in common are
    left to another block, so each pair is found in one block only.
    """
    block = F.concat_ws(
        "|", F.lpad(short.cast("string"), 6, "0"), F.substring("word", F.lit(1), head), F.reverse(F.substring("word", -tail, tail)), bar.cast("string")
    )
    return F.struct(block.alias("block"), short.cast("int").alias("short"), head.cast("int").alias("head"), tail.cast("int").alias("tail"), bar.cast("int").alias("bar"))


def _entered(df: DataFrame, entries: Column) -> DataFrame:
    return df.select("word", "n", F.explode(entries).alias("at")).select("word", "n", "at.*")


def _first_entries(words: DataFrame) -> DataFrame:
    """Every word in the forward and the reversed dictionary, as shorter and as longer word of a pair."""
    zero, size = F.lit(0), F.length("word")
    half, far = F.floor(F.col("short") / 2).cast("int"), F.col("short") + 1
    shorts = words.withColumn("short", F.explode(F.array(size, size - 1))).where(F.col("short") >= MIN_LENGTH)
    return _entered(shorts, F.array(_entry(F.col("short"), half, zero, far), _entry(F.col("short"), zero, half, half)))


def _subdivided(entries: DataFrame) -> DataFrame:
    """The entries of blocks with a longer beginning, and with a longer end."""
    half = F.floor((F.col("short") - F.col("head") - F.col("tail")) / 2).cast("int")
    longer = F.col("head") + half
    begin = _entry(F.col("short"), longer, F.col("tail"), F.col("bar"))
    end = _entry(F.col("short"), F.col("head"), F.col("tail") + half, F.least(longer, F.col("bar")))
    return _entered(entries, F.array(begin, end)).where("head < bar")


def blocks(words: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """word, n, block, short, head, tail, bar: entries of the blocks to scan.

    A block of over `limit` words fixes all but one code point of its shorter words, so there are at most as many of
    these as letters, and at most the square of that of longer ones.
    """
    entries, done = materialize(_first_entries(words), "entries"), None
    while True:
        free = F.col("short") - F.col("head") - F.col("tail")
        large = entries.where(free > 1).groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > limit)
        large = materialize(large.select("block", F.lit(True).alias("large")), "large")
        if large.isEmpty():
            return entries if done is None else done.unionByName(entries)
        marked = materialize(bounded_join(entries, large, "block", "left"), "marked")
        small = marked.where("large is null").drop("large")
        done = small if done is None else done.unionByName(small)
        entries = materialize(_subdivided(marked.where("large").drop("large")), "entries")


def near_in_block(short: np.ndarray, long: np.ndarray, bar: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(i, j, longer): words i of short that are near word j of long (longer), or of short (not longer, j > i).

    short and long: code points, a word a row, of m and of m + 1 columns. Pairs with bar or more first code points in common
    are left out.
    """
    m = short.shape[1]
    for i, word in enumerate(short):
        unlike = short[i + 1 :] != word
        near = (unlike.sum(axis=1) == 1) & (unlike.argmax(axis=1) < bar)
        j = np.flatnonzero(near) + i + 1
        if len(j):
            yield np.full(len(j), i), j, False
        if len(long):
            first = np.cumprod(long[:, :m] == word, axis=1).sum(axis=1)
            last = np.cumprod(long[:, :0:-1] == word[::-1], axis=1).sum(axis=1)
            j = np.flatnonzero((first + last >= m) & (first < bar))
            if len(j):
                yield np.full(len(j), i), j, True


def near_pairs(entries: DataFrame) -> DataFrame:
    """word, other, other_n: both directions of each pair of near words, by a scan of the sorted dictionaries."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def verified(words: list[tuple[str, int]], size: int, bar: int) -> Iterator:
            parts = [[w for w in words if len(w[0]) == size + k] for k in (0, 1)]
            codes = [np.frombuffer("".join(w for w, _ in part).encode("latin-1"), np.uint8).reshape(-1, size + k) for k, part in enumerate(parts)]
            for some, others, longer in near_in_block(*codes, bar):
                for i, j in zip(some.tolist(), others.tolist()):
                    yield parts[0][i], parts[longer][j]

        def packed(pairs: list) -> pa.RecordBatch:
            both = [(a[0], *b) for a, b in pairs] + [(b[0], *a) for a, b in pairs]
            columns = list(zip(*both)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["word", "other", "other_n"])

        held, block, size, bar, out = [], None, 0, 0, []
        for batch in batches:
            for word, n, at, short, limit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != block:
                    if len(held) > 1:
                        out += verified(held, size, bar)
                    held, block, size, bar = [], at, short, limit
                held.append((word, n))
                if len(out) > 50_000:
                    yield packed(out)
                    out = []
        out += verified(held, size, bar) if len(held) > 1 else []
        yield packed(out)

    sorted_words = entries.select("word", "n", "block", "short", "bar").repartitionByRange("block").sortWithinPartitions("block", "word")
    return sorted_words.mapInArrow(scan, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words with a form: forms followed to the last, twice as far each time."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(ahead, "root", "left")
        if moved.where("next is not null").isEmpty():
            return at
        at = materialize(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null id counts as an empty string in the checksum. Repeated rows count
    again. An empty table gives an empty result, and a word without a near one a row with n_near 0 and null form.
    Other columns are ignored.
    """
    words = materialize(word_counts(docs, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = near_pairs(blocks(words, limit)).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = materialize(near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n")), "near")
    found = words.join(near, "word", "left")
    taken = F.col("other_n") >= FORM_FACTOR * F.col("n")
    found = found.select("word", F.when(taken, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("other_n")).alias("form_n"))
    found = materialize(found, "found")
    out = found.join(_roots(found.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
