"""Packing documents into padded sequences by shortest-pack-first on the histogram of their lengths.

Documents longer than a sequence give whole sequences and a tail. Tails are placed by their histogram, longest
length first, each into the shortest pack so far; if the shortest has no room for it, no other has, and a new pack is
opened. Packs of one pattern are counted, not listed, so the work follows the number of lengths and patterns. What
is then left open is closed by cutting: the shortest packs are taken apart and their tails fill the gaps of the
others exactly. The few tokens over at the end go to packs of powers of two, which take no padding.

A pattern's packs are numbered one after the other and hold tails of consecutive ranks, so a document finds its
place by the rank among the documents of its length; only the histogram reaches the driver.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspan.llm.common import BROADCAST_ROWS, join_ranks, materialize, running_offset, sqrt_buckets
from vecspan.llm.tokens import word_encoder

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 1


class Part(NamedTuple):
    """Tokens start .. start + length of the tails of `tail` tokens, from rank lo on, a tail for each pack of a pattern."""

    tail: int
    lo: int
    start: int
    length: int


class Packs(NamedTuple):
    """`count` packs of one pattern, numbered from first."""

    first: int
    count: int
    parts: tuple[Part, ...]

    @property
    def used(self) -> int:
        return sum(p.length for p in self.parts)

    def split(self, n: int) -> tuple[Packs, Packs | None]:
        """The first n packs, and the others."""
        if n == self.count:
            return self, None
        return Packs(self.first, n, self.parts), Packs(self.first + n, self.count - n, tuple(p._replace(lo=p.lo + n) for p in self.parts))

    def with_part(self, part: Part) -> Packs:
        return self._replace(parts=(*self.parts, part))


def shortest_pack_first(histogram: np.ndarray) -> tuple[list[Packs], list[Packs], int]:
    """Full packs, open ones and their number, for tails counted by length (index; the last one is the capacity)."""
    capacity = len(histogram) - 1
    open_packs: dict[int, list[Packs]] = defaultdict(list)
    used_lengths: list[int] = []
    full, n_packs = [], 0

    def put(packs: Packs, used: int) -> None:
        if used == capacity:
            full.append(packs)
        else:
            if not open_packs[used]:
                heapq.heappush(used_lengths, used)
            open_packs[used].append(packs)

    for length in range(capacity, 0, -1):
        n, lo = int(histogram[length]), 0
        while n:
            while used_lengths and not open_packs[used_lengths[0]]:
                heapq.heappop(used_lengths)
            if used_lengths and used_lengths[0] + length <= capacity:
                used = used_lengths[0]
                packs = open_packs[used].pop()
                packs, rest = packs.split(min(n, packs.count))
                if rest:
                    open_packs[used].append(rest)
                put(packs.with_part(Part(length, lo, 0, length)), used + length)
                n, lo = n - packs.count, lo + packs.count
            else:
                each = capacity // length
                for count, parts in ((n // each, each), (1, n % each)):
                    if count and parts:
                        put(Packs(n_packs, count, tuple(Part(length, lo + k * count, 0, length) for k in range(parts))), parts * length)
                        n_packs, lo = n_packs + count, lo + count * parts
                n = 0
    return full, [p for used in sorted(open_packs, reverse=True) for p in open_packs[used]], n_packs


def fill_gaps(open_packs: list[Packs], capacity: int, n_packs: int) -> list[Packs]:
    """The open packs (fullest first) made full: the shortest are taken apart to fill the gaps of the others.

    What is over goes to packs of powers of two, numbered from n_packs on.
    """
    total = sum(p.used * p.count for p in open_packs)
    stay, over = divmod(total, capacity)
    gaps: list[tuple[int, Packs]] = []
    donors: list[tuple[int, Part, int]] = []
    for packs in open_packs:
        kept = min(stay, packs.count)
        stay -= kept
        if kept:
            head, packs = packs.split(kept)
            gaps.append((capacity - head.used, head))
        for part in packs.parts if packs else ():
            heapq.heappush(donors, (-part.length, part, packs.count))
    for bit in range(over.bit_length() - 1, -1, -1):
        if over >> bit & 1:
            gaps.append((1 << bit, Packs(n_packs, 1, ())))
            n_packs += 1
    done = []
    gaps.sort(key=lambda x: x[0])
    while gaps:
        gap, packs = gaps.pop()
        _, part, count = heapq.heappop(donors)
        n = min(packs.count, count)
        packs, rest = packs.split(n)
        if rest:
            gaps.append((gap, rest))
        if count > n:
            heapq.heappush(donors, (-part.length, part._replace(lo=part.lo + n), count - n))
        take = min(gap, part.length)
        packs = packs.with_part(part._replace(length=take))
        if part.length > take:
            left = part._replace(start=part.start + take, length=part.length - take)
            heapq.heappush(donors, (-left.length, left, n))
        if gap > take:
            gaps.append((gap - take, packs))
        else:
            done.append(packs)
    return done


def plan(histogram: np.ndarray) -> tuple[list[tuple], int]:
    """(tail, lo, hi, pieces) for the tails of each length by ranges of ranks, and the number of packs.

    pieces has (start, length, sequence of rank lo, offset) in order of start; the ranges of a length cover all its ranks.
    """
    full, open_packs, n_packs = shortest_pack_first(histogram)
    by_tail: dict[int, list[tuple]] = defaultdict(list)
    last = n_packs
    for packs in [*full, *fill_gaps(open_packs, len(histogram) - 1, n_packs)]:
        offset, last = 0, max(last, packs.first + packs.count)
        for p in packs.parts:
            by_tail[p.tail].append((p.lo, p.lo + packs.count, p.start, p.length, packs.first, offset))
            offset += p.length
    out = []
    for tail, slots in by_tail.items():
        cuts = sorted({x for s in slots for x in s[:2]})
        pieces: list[list[tuple]] = [[] for _ in cuts]
        for lo, hi, start, length, first, offset in slots:
            for k in range(bisect_left(cuts, lo), bisect_left(cuts, hi)):
                pieces[k].append((start, length, first + cuts[k] - lo, offset))
        out += [(tail, lo, hi, sorted(found)) for lo, hi, found in zip(cuts, cuts[1:], pieces)]
    return out, last


def tokenised(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """row, doc_id, doc_tokens, tail (tokens beyond whole sequences), crcs (of the whole sequences and of the tail), tail_ids."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids_of, end = word_encoder(tokenizer).encode, END_ID.to_bytes(4, "little")
        for batch in batches:
            sizes, tails, crcs, last = [], [], [], []
            for text in batch.column(2):
                ids = ids_of(text.as_py()) + end
                n = len(ids) // 4
                tail = n % capacity
                sizes.append(n)
                tails.append(tail)
                crcs.append([zlib.crc32(ids[4 * at : 4 * (at + capacity)]) for at in range(0, n, capacity)])
                last.append(ids[len(ids) - 4 * tail :])
            columns = [pa.array(sizes, pa.int64()), pa.array(tails, pa.int32()), pa.array(crcs, pa.list_(pa.int64())), pa.array(last, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["row", "doc_id", "doc_tokens", "tail", "crcs", "tail_ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "row long, doc_id long, doc_tokens long, tail int, crcs array<long>, tail_ids binary")


def _with_crcs(cut: DataFrame) -> DataFrame:
    """Checksums of each document's pieces (a list of structs) from tail_ids."""

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            crcs = [[zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in pieces] for ids, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.list_(pa.int64()))], names=["row", "piece_crcs"])

    return cut.select("row", "tail_ids", "pieces").mapInArrow(check, "row long, piece_crcs array<long>")


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are documents of their own, and null ids are ids like
    others. An empty table gives an empty result. Other columns are ignored. Every sequence is full, but for at
    most one of each smaller power of two.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenised(docs, capacity, id_col, text_col, tokenizer), "tokens", "zstd")
    sizes = {r["tail"]: (r["n"], r["whole"]) for r in tokens.groupBy("tail").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / capacity)).alias("whole")).collect()}  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for tail, (n, _) in sizes.items():
        histogram[tail] = n if tail else 0
    total = sum(n for n, _ in sizes.values())
    ranges, n_packs = plan(histogram)
    kind = "struct<start:int,length:int,sequence:long,offset:int>"
    ranges = spark.createDataFrame(ranges, f"tail int, lo long, hi long, pieces array<{kind}>")

    meta = tokens.drop("tail_ids").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(sqrt_buckets(total))).cast("int"))
    ranked = running_offset(meta.where("tail > 0").select("row", "tail", "bucket"), ["tail"], "bucket", ["row"], F.lit(1), "rank").drop("bucket")
    placed = join_ranks(ranked, ranges, "tail")
    moved = F.transform("pieces", lambda p: p.withField("sequence", p["sequence"] + F.col("rank") - F.col("lo")))
    placed = materialize(placed.select("row", moved.alias("pieces")), "placed")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    begin = F.col("doc_tokens") - F.col("tail")
    cut = placed.where(F.size("pieces") > 1)
    ids = tokens.where("tail > 0").select("row", "tail_ids")
    if cut.count() <= BROADCAST_ROWS:
        ids = ids.join(F.broadcast(cut.select("row")), "row", "left_semi")
    crcs = _with_crcs(ids.join(cut, "row"))
    tails = meta.join(placed, "row").join(crcs, "row", "left")
    found = F.coalesce("piece_crcs", F.array(F.element_at("crcs", -1)))
    tails = tails.select("doc_id", "doc_tokens", begin.alias("begin"), F.explode(F.arrays_zip("pieces", found.alias("crc"))).alias("p"))
    tails = tails.select(
        "doc_id",
        (F.col("begin") + F.col("p.pieces.start")).alias("start"),
        F.col("p.pieces.length").cast("long").alias("length"),
        F.col("p.crc").alias("ids_crc32"),
        "doc_tokens",
        F.col("p.pieces.sequence").alias("sequence_id"),
        F.col("p.pieces.offset").cast("long").alias("offset"),
    )
    count = F.floor(F.col("doc_tokens") / capacity)
    whole = running_offset(meta.where(count > 0), [], "bucket", ["row"], count, "before")
    whole = whole.select("doc_id", "doc_tokens", "before", F.posexplode(F.slice("crcs", F.lit(1), count.cast("int"))).alias("k", "ids_crc32"))
    whole = whole.withColumns({"start": F.col("k").cast("long") * capacity, "length": F.lit(capacity).cast("long"), "sequence_id": F.lit(n_packs) + F.col("before") + F.col("k"), "offset": F.lit(0).cast("long")})
    return tails.select(out).unionByName(whole.select(out))
