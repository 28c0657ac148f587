"""Near-duplicate groups by order MinHash, verified by banded alignment.

A text's k-mers of words are labelled with their occurrence number. Each band hashes them anew, takes the
PICK smallest and keeps these in text order; two texts of high edit similarity agree in some band as a whole
with high probability, texts that share words in another order do not. Short texts have too few k-mers for that
and are found exactly, by a segment that the edits leave whole. Texts that agree in a band or segment are linked
through centres, which joins a large group without its pairs; every round takes other centres and deals anew. Then all
pairs that a key still holds apart are found: in keys of at most SMALL_KEY texts all are compared by counts of words, and the texts of
larger keys, which mostly have a passage in common, by an exact join on their words: texts this similar share one of
their rarest words among these texts, so those that share the passage alone never meet. Each link is verified by the
edit distance within a band around the diagonal, and connected components of the verified links are the groups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspan.llm.common import BROADCAST_ROWS, bounded_join, fresh_names, keep_rows, materialize, sqrt_buckets
from vecspan.llm.exact_dedup import hand_down, merge_up

#: Edits spread over a text destroy fewer of the shorter k-mers; one more of them per band keeps unlike texts apart.
K = 2
SIMILARITY = 0.8
BANDS = 64
PICK = 3
#: Pairs whose shorter text has at most this many words are found by segments, exactly.
SHORT_WORDS = 24
#: A band's texts also agree in a class of their number of words. Classes are this factor wide, and every other
#: band's grid is moved by half a class, so lengths within SIMILARITY of each other share every or every other band.
LENGTH_CLASS = 1.6
#: Words a task keeps the hashes of.
KNOWN_WORDS = 200_000
#: Rounds of linking through centres.
ROUNDS = 2
#: Texts of a key up to which all pairs that are still apart are compared in one task.
SMALL_KEY = 2048
#: Counts of words by hash, whose sum of differences is at most twice the edits.
COUNTS = 256
#: Bits of a key that are looked up before its count: 4,096 blocks of keep_rows.
LOW_BITS = 2**27 - 1

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


class _WordHash(dict):
    """Word -> 64-bit hash, emptied when it is full."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = out = xxh3_64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmer_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in text order, each with its occurrence number; a shorter text is one k-mer."""
    k = min(k, len(words))
    if k == 0:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    at = np.arange(n)
    number = np.empty(n, np.uint64)
    number[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mix(h + _mix(number + np.uint64(1)))


def order_minhash(kmers: np.ndarray, n_words: int, bands: int = BANDS, pick: int = PICK) -> list[int]:
    """One signed 64-bit value per band: the pick smallest k-mers under the band's hash, in text order, and the length class."""
    n, take = len(kmers), min(pick, len(kmers))
    if n == 0:
        return []
    seeds = _mix(np.arange(1, bands + 1, dtype=np.uint64))
    picked = np.empty((bands, take), np.int64)
    step = max(1, 2_000_000 // n)
    for lo in range(0, bands, step):
        h = kmers[None, :] * (seeds[lo : lo + step, None] | np.uint64(1))  # k-mers are mixed already; an odd factor orders them anew
        at = np.arange(len(h))
        for k in range(take):
            picked[lo : lo + step, k] = least = h.argmin(axis=1)
            h[at, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    picked.sort(axis=1)
    place = np.floor(np.log(n_words) / np.log(LENGTH_CLASS) + 0.5 * (np.arange(bands) % 2))
    key = _mix(seeds + place.astype(np.uint64))
    for k in range(take):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + kmers[picked[:, k]])
    return key.view(np.int64).tolist()


def _limit(n_words: int) -> int:
    """The most edits at which a text of n_words is similar to one that is not longer."""
    return int((1 - SIMILARITY) * n_words + 1e-9)


def _segments(n: int, limit: int) -> list[tuple[int, int]]:
    """Begin and length of limit + 1 segments of n words, as equal as can be."""
    cuts = [i * n // (limit + 1) for i in range(limit + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def segment_keys(words: np.ndarray) -> list[int]:
    """Signed 64-bit keys of which any two similar texts share one, if the shorter has at most SHORT_WORDS words.

    At most limit edits leave one of a text's limit + 1 segments whole, and the other text holds it at a place
    that the edits on either side of it allow: i edits at most before segment i, or else an earlier segment is
    whole, and limit - i at most after it, or else a later one is.
    """
    n = len(words)
    keys = set()

    def add(size: int, limit: int, i: int, part: np.ndarray) -> None:
        key = _mix(np.array([size << 32 | limit << 16 | i], np.uint64))
        for word in part:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
        keys.add(key.view(np.int64).item())

    if 0 < n <= SHORT_WORDS:
        longer = n
        limits = set()
        while longer - _limit(longer) <= n:
            limits.add(_limit(longer))
            longer += 1
        for limit in limits:
            for i, (lo, size) in enumerate(_segments(n, limit)):
                add(n, limit, i, words[lo : lo + size])
    limit = _limit(n)
    for shorter in range(max(1, n - limit), min(n, SHORT_WORDS) + 1):
        for i, (lo, size) in enumerate(_segments(shorter, limit)):
            first = max(0, lo - i, lo + n - shorter - (limit - i))
            last = min(n - size, lo + i, lo + n - shorter + (limit - i))
            for at in range(first, last + 1):
                add(shorter, limit, i, words[at : at + size])
    return sorted(keys)


def sketch_keys(words: np.ndarray, bands: int = BANDS, pick: int = PICK) -> list[int]:
    """Of the words' hashes: segment keys, and for a text over SHORT_WORDS words its bands."""
    return segment_keys(words) + (order_minhash(kmer_hashes(words), len(words), bands, pick) if len(words) > SHORT_WORDS else [])


def banded_distance(a: list, b: list, limit: int) -> int | None:
    """Edit distance of two sequences if it is at most limit, else None.

    Only cells within limit of the diagonal can lie on such a path. A column's cells are kept as bits of two
    integers (where the distance rises or falls by one towards the next row), so a column costs a few
    operations on 2 * limit + 1 bits.
    """
    head = 0
    for x, y in zip(a, b):
        if x != y:
            break
        head += 1
    tail = 0
    for x, y in zip(reversed(a[head:]), reversed(b[head:])):
        if x != y:
            break
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if abs(len(a) - len(b)) > limit:
        return None
    if not a or not b:
        return max(len(a), len(b))
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    width = 2 * limit + 1
    band = (1 << width) - 1
    # Bit k of column j is row j - limit + k; row i ends after a[i - 1]; rows up to 0 only rise along columns.
    rise, fall = band ^ ((1 << limit) - 1), 0
    m = len(a)
    score, turn = min(m, limit), max(0, m - limit)
    for j, y in enumerate(b, 1):
        shift = j - limit - 1
        hits = where.get(y, 0)
        hits = (hits >> shift if shift >= 0 else hits << -shift) & band
        zero = ((((hits & rise) + rise) ^ rise) | hits | fall) & band
        along_up = fall | (band ^ (zero | rise))
        along_down = zero & rise
        if j <= turn:
            score += not zero >> (width - 1) & 1
        else:
            bit = m - j + limit
            score += (along_up >> bit & 1) - (along_down >> bit & 1)
        zero >>= 1
        rise = along_down | (band ^ (zero | along_up))
        fall = along_up & zero
    return score if score <= limit else None


def similar(a: list[str], b: list[str], similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length reaches similarity, in words.

    Texts so close share most word pairs, which is counted first; the band then widens from a narrow one.
    """
    longest = max(len(a), len(b))
    limit = int((1 - similarity) * longest + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    if longest > 1 and limit:
        pairs = Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))
        if sum(pairs.values()) < longest - 1 - 2 * limit:
            return False
    width = min(limit, 16)
    while True:
        if banded_distance(a, b, width) is not None:
            return True
        if width >= limit:
            return False
        width = min(limit, 4 * width)


def _sketches(numbered: DataFrame, n_bands: int, pick: int) -> DataFrame:
    """row, doc_id, digest (two hashes of the word sequence), n_words, counts (of the words by hash, a byte each), bands."""

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        known = _WordHash()
        for batch in batches:
            digests, sizes, counts, bands = [], [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py() or "")
                ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                digests.append(xxh3_128_digest(ids.tobytes()))
                sizes.append(len(words))
                counts.append(np.minimum(np.bincount((ids % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS), 255).astype(np.uint8).tobytes())
                bands.append(sketch_keys(ids, n_bands, pick))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["row", "doc_id", "digest", "n_words", "counts", "bands"],
            )

    return numbered.select("row", "doc_id", "text").mapInArrow(sketch, "row long, doc_id long, digest binary, n_words long, counts binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), a materialized table, whose texts are similar."""

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = [similar(words_of(x.as_py()), words_of(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (keep_rows(texts, pairs.select(F.col(c).alias("row"))) for c in ("a", "b"))
    both = pairs.join(x.select(F.col("row").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(y.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _star_pairs(members: DataFrame, salts: int, turn: int = 0) -> DataFrame:
    """Distinct pairs (a, b), a < b, that link the members (key, pick, row, n_words) of every key.

    Members are dealt over salts, anew each turn, and linked to the first of their salt; the firsts are linked to the first
    of the key. A key with a third of all rows so has groups of about the square root of their number.
    Pairs whose lengths alone rule out the similarity are left out.
    """
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(salts)).cast("int")).withColumn("mark", F.struct("pick", "row", "n_words"))
    dealt = dealt.withColumn("first", F.min("mark").over(Window.partitionBy("key", "salt")))
    near = dealt.where("mark <> first").select("mark", "first")
    firsts = dealt.where("mark = first").select("key", "mark")
    firsts = firsts.withColumn("first", F.min("mark").over(Window.partitionBy("key")))
    both = near.unionByName(firsts.where("mark <> first").select("mark", "first"))
    both = both.where(_alike_in_length(F.col("mark.n_words"), F.col("first.n_words")))
    return both.select(F.least("mark.row", "first.row").alias("a"), F.greatest("mark.row", "first.row").alias("b")).distinct()


def _alike_in_length(n: Column, m: Column) -> Column:
    """Whether texts of n and m words can be similar."""
    longer = F.greatest(n, m)
    return longer - F.least(n, m) <= F.floor((1 - SIMILARITY) * longer + 1e-9)


def _pairs_apart(members: DataFrame, block: int = SMALL_KEY) -> DataFrame:
    """Distinct pairs (a, b), a < b, of all members (key, row, n_words, comp[, counts, words, keys]) of a key that are in different comps.

    A key's members are dealt over blocks of about `block`, and every two blocks are a cell that is compared in one
    task, in sorted order. Pairs whose lengths, counts of words or words (see _short_words) alone rule out the similarity are
    left out there, so only pairs that may well be similar leave a task. keys are all keys of the row: a pair then leaves
    one of its common keys only.
    """
    if "counts" not in members.columns:
        members = members.withColumn("counts", F.lit(b""))
    if "words" not in members.columns:
        members = members.withColumn("words", F.lit(None).cast("binary"))
    if "keys" not in members.columns:
        members = members.withColumn("keys", F.array("key"))
    keys = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    dealt = members.join(materialize(keys.where("low < high").select("key", "n"), "keys"), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("row"), F.col("n")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    cells = dealt.withColumn("cell", F.explode(cells)).select("key", "cell.i", "cell.j", "own", "row", "comp", "n_words", "counts", "words", "keys")

    def near(key: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of a member of x and one of y; if these are one, of each two once."""
        out = []
        cx, cy = (np.stack(list(z["counts"])).astype(np.int16) for z in (x, y))
        for k, (row, comp, n, _, words, keys) in enumerate(x):
            rest = slice(k + 1 if x is y else 0, None)
            limit = np.floor((1 - SIMILARITY) * np.maximum(y["n_words"][rest], n) + 1e-9)
            at = np.flatnonzero((y["comp"][rest] != comp) & (np.abs(y["n_words"][rest] - n) <= limit))
            at = at[np.abs(cy[rest][at] - cx[k]).sum(axis=1) <= 2 * limit[at]]
            if words is not None and len(at):
                shared = [int((z[np.minimum(np.searchsorted(z, words), len(z) - 1)] == words).sum()) for z in y["words"][rest][at]]
                at = at[np.array(shared) >= np.maximum(y["n_words"][rest][at], n) - limit[at]]
            for r, others in zip(y["row"][rest][at].tolist(), y["keys"][rest][at]):
                if min(keys & others) == key:
                    out.append((min(row, r), max(row, r)))
        return out

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = [("row", np.int64), ("comp", np.int64), ("n_words", np.int64), ("counts", object), ("words", object), ("keys", object)]

        def pairs(cell: tuple, held: list) -> list[tuple[int, int]]:
            x, y = (np.array([(r, c, n, np.frombuffer(b, np.uint8), w and np.frombuffer(w, np.uint32), frozenset(k)) for own, r, c, n, b, w, k in held if own == side], kind) for side in cell[1:])
            return near(cell[0], x, x if cell[1] == cell[2] else y) if len(x) and len(y) else []

        def packed(found: list) -> pa.RecordBatch:
            columns = list(zip(*found)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        held, cell, out = [], None, []
        for batch in batches:
            for key, i, j, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != cell:
                    if len(held) > 1:
                        out += pairs(cell, held)
                    held, cell = [], (key, i, j)
                    if len(out) > 50_000:
                        yield packed(out)
                        out = []
                held.append(member)
        out += pairs(cell, held) if len(held) > 1 else []
        yield packed(out)

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _labelled_words(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """row, n_words, words (hashes, each with its occurrence number) of the rows' texts."""

    def label(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = _WordHash()
        for batch in batches:
            labelled = []
            for text in batch.column(2):
                words = words_of(text.as_py())
                labelled.append(kmer_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), 1).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(labelled, pa.list_(pa.int64()))], names=["row", "n_words", "words"])

    held = texts.join(rows, "row").select("row", "n_words", "text")
    return held.mapInArrow(label, "row long, n_words long, words array<long>")


def _short_words(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """row, words: of the rows' texts the words with their occurrence numbers, as sorted 32-bit hashes.

    Texts share at most as many words as hashes, so a pair that the hashes rule out is ruled out.
    """

    def hash_words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = _WordHash()
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hashes = kmer_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), 1)
                out.append(np.sort((hashes >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "words"])

    return keep_rows(texts.select("row", "text"), rows).mapInArrow(hash_words, "row long, words binary")


def _with_words(members: DataFrame, counts: DataFrame, texts: DataFrame) -> DataFrame:
    """The members (key, row, comp, n_words) with counts, words and keys for _pairs_apart.

    These are looked up once for a row, and only then is the row repeated for its keys.
    """
    rows = members.groupBy("row", "comp", "n_words").agg(F.collect_list("key").alias("keys"))
    rows = rows.join(keep_rows(counts, members), "row").join(_short_words(members, texts), "row")
    return materialize(rows, "rows_apart").withColumn("key", F.explode("keys"))


def _pairs_by_words(rows: DataFrame, texts: DataFrame, block: int = SMALL_KEY) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows (row, comp, n_words[, counts]) in different comps, among which are all similar ones.

    Similar texts differ in at most _limit words, counted with their occurrences, so in any order of all words they
    share one of their first _limit + 1. Words are ordered by the number of texts that hold them, rarest first, and words
    that one text holds are gone before texts meet. Texts that share such a word are compared as in _pairs_apart.
    """
    words = materialize(_labelled_words(rows, texts).select("row", "n_words", F.explode("words").alias("word")), "words")
    number = materialize(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "word_counts")
    shared = words.join(number, "word").groupBy("row", "n_words").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("shared"))
    first = F.floor((1 - SIMILARITY) * F.col("n_words") + 1e-9).cast("int") + 1 - (F.col("n_words").cast("int") - F.size("shared"))
    posted = shared.select("row", F.slice("shared", F.lit(1), F.greatest(first, F.lit(0))).getField("word").alias("keys"))
    return _pairs_apart(materialize(posted.join(rows, "row"), "posted").withColumn("key", F.explode("keys")), block)


def _shared_keys(unique: DataFrame) -> DataFrame:
    """(key, row, n_words) of the keys that two or more rows have.

    Keys are counted with partial sums and most, which one row has, are gone before the rows are looked up: rows whose key has
    low bits that no such key has do not move. Those
    that so many rows have that one task should not hold them are few by their number and are broadcast.
    """
    keys = unique.select("row", "n_words", F.explode("bands").alias("key"))
    counted = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = max(10_000, -(-total // BROADCAST_ROWS))
    hot = keys.join(F.broadcast(counted.where(F.col("n") > most)), "key")
    low = F.col("key").bitwiseAND(LOW_BITS).alias("low")
    likely = keep_rows(keys.select("*", low), counted.select(low), "low").drop("low")
    return hot.unionByName(likely.join(counted.where(F.col("n") <= most), "key")).drop("n")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): v, comp (the smallest v of its component).

    Every vertex points to its least neighbour, pointers are followed to their ends, and the links are drawn
    anew between the ends, until none is left; at most half of the vertices remain each time. One end may
    be that of a third of all rows, so ends are looked up by size-checked joins.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    total = None
    while not edges.isEmpty():
        near = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        parent = materialize(near.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("comp")), "parent")
        while True:
            above = parent.where("v <> comp").select(F.col("v").alias("comp"), F.col("comp").alias("end"))
            above = materialize(parent.select("comp").distinct().join(above, "comp"), "above")
            if above.isEmpty():
                break
            parent = materialize(bounded_join(parent, above, "comp", "left").select("v", F.coalesce("end", "comp").alias("comp")), "parent")
        if total is None:
            total = parent
        else:
            moved = parent.select(F.col("v").alias("comp"), F.col("comp").alias("end"))
            total = materialize(bounded_join(total, moved, "comp", "left").select("v", F.coalesce("end", "comp").alias("comp")), "labels")
        drawn = edges.join(parent.select(F.col("v").alias("a"), F.col("comp").alias("x")), "a").join(parent.select(F.col("v").alias("b"), F.col("comp").alias("y")), "b")
        edges = materialize(drawn.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("comp")) if total is None else total


def _members(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """shared with the component of every row."""
    if labels is None:
        return shared.withColumn("comp", F.col("row"))
    return shared.join(labels.withColumnRenamed("v", "row"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))


def _representatives(members: DataFrame, turn: int) -> DataFrame:
    """One member of each component of a key, another one each turn."""
    pick = F.xxhash64("row", "key", F.lit(turn)) if turn else F.col("row")
    return members.groupBy("key", "comp").agg(F.min(F.struct(pick.alias("pick"), "row", "n_words")).alias("m")).select("key", "m.*")


def _unseen(pairs: DataFrame, seen: DataFrame | None) -> DataFrame:
    return pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, pick: int = PICK, small: int = SMALL_KEY) -> DataFrame:
    """One row per input row: doc_id, group_id, group_size, kept.

    group_id is the smallest id of the group and its row is the one that stays (one of them, if rows repeat).
    Texts without a word (also null and empty ones) are groups of their own, row by row, as nothing says that
    they are alike; their group_id is their id. Null ids come after all others. An empty table gives an empty
    result. Other columns are ignored. Of the texts that agree in a band or segment all similar ones are linked, however
    many agree; texts of over SHORT_WORDS words that are similar agree in none with the chance that the README states.
    """
    return _groups(_numbered(docs, id_col, text_col), bands, pick, small).drop("row")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows, "numbered", "zstd")


def _groups(numbered: DataFrame, bands: int, pick: int, small: int) -> DataFrame:
    """row, doc_id, group_id, group_size, kept."""
    sketches = materialize(_sketches(numbered, bands, pick), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row").alias("mark")
    rows = materialize(sketches.where("n_words > 0").select("digest", "n_words", rank), "ranks")
    key = ["digest", "n_words"]
    top, tables, levels = merge_up(rows, key, F.min)
    top = materialize(top.withColumn("row", F.col("best.row")), "texts")
    unique = keep_rows(sketches.select("row", "n_words", "bands"), top)
    shared = materialize(_shared_keys(unique), "shared")
    salts = sqrt_buckets(top.count())
    texts = materialize(keep_rows(numbered.select("row", "text"), shared), "candidates", "zstd")
    labels, seen, links = None, None, None
    for turn in range(ROUNDS):
        pairs = materialize(_unseen(_star_pairs(_representatives(_members(shared, labels), turn), salts, turn), seen), "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        if not pairs.isEmpty():
            found = materialize(_verified(pairs, texts), "links")
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                labels = components(links)
    members = materialize(_members(shared, labels), "members")
    keys = members.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    keys = materialize(keys.where("low < high").select("key", "n"), "keys_apart")
    counts = sketches.select("row", "counts")
    apart = members.join(keys, "key")
    few = materialize(apart.where(F.col("n") <= small).drop("n"), "few")
    pairs = _pairs_apart(_with_words(few, counts, texts), small)
    large = apart.where(F.col("n") > small)
    if not large.isEmpty():
        hot = large.select("row", "comp", "n_words").distinct().join(counts, "row")
        pairs = pairs.unionByName(_pairs_by_words(materialize(hot, "hot_rows"), texts)).distinct()
    pairs = materialize(_unseen(pairs, seen), "pairs")
    if not pairs.isEmpty():
        found = materialize(_verified(pairs, texts), "links")
        if not found.isEmpty():
            labels = components(found if links is None else links.unionByName(found))
    if labels is not None:
        top = top.join(labels.withColumnRenamed("v", "row"), "row", "left")
    else:
        top = top.withColumn("comp", F.lit(None).cast("long"))
    top = materialize(top, "classes")
    linked = top.where("comp is not null")
    groups = materialize(linked.groupBy("comp").agg(F.min("best").alias("stays"), F.sum("n").alias("group_size")), "groups")
    linked = bounded_join(linked.select(*key, "comp"), groups, "comp").drop("comp")
    top = top.where("comp is null").select(*key, F.col("best").alias("stays"), F.col("n").alias("group_size")).unionByName(linked)
    out = hand_down(rows, top, key, tables, levels)
    out = out.select("mark.row", "mark.doc_id", F.col("stays.doc_id").alias("group_id"), "group_size", (F.col("mark.row") == F.col("stays.row")).alias("kept"))
    alone = sketches.where("n_words = 0").select("row", "doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, pick: int = PICK, small: int = SMALL_KEY) -> DataFrame:
    """docs with one row of each group of near_groups; all columns stay as they are."""
    (row,) = fresh_names(docs, "row_number")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    numbered = rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = _groups(numbered, bands, pick, small).where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
