"""Spelling variants, whitening and shortest-pack-first packing: brute force, and the cases that every one must handle."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, table
from vecspan.llm import shortest_pack, spelling, whitening
from vecspan.llm.common import join_ranks
from vecspan.llm.tokens import word_encoder


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).cache()


# --- spelling variants -----------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n_of):
    near = {w: [v for v in n_of if one_edit(w, v)] for w in n_of}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n_of[v], v), default=None)
        form[w] = best if best and n_of[best] >= 5 * n_of[w] else None
    out = set()
    for w in n_of:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n_of[w], len(near[w]), n_of[form[w]] if form[w] else None))
    return out


def test_variants_against_all_pairs(spark):
    """Words of few letters in one block, long ones, chains of forms, ties, and À to ÿ; in blocks of two words and of many."""
    r = random.Random(2)
    base = ["aaaaaa", "aaaaaaa", "abcabc", "éèéèéè", "ÀBÀBÀB", "internationalisation"]
    n_of = Counter()
    for w in base:
        n_of[w.replace("B", "b")] += 700
    for _ in range(400):
        w = list(r.choice(list(n_of)))
        for _ in range(r.randint(1, 2)):
            i = r.randrange(len(w))
            w[i : i + r.randrange(2)] = [r.choice("abé")] * r.randrange(2)
        if len(w) >= 6:
            n_of["".join(w)] += r.choice([5, 5, 30, 160])
    words = spark.createDataFrame(list(n_of.items()), "word string, n long")
    text = " ".join(w for w, n in n_of.items() for _ in range(n))
    free = next(d for d in range(10**6) if not any(zlib.crc32(f"{d}:{w}".encode()) % spelling.DAMAGE == 0 for w in n_of))
    for limit in (2, 128):
        found = spelling.near_pairs(spelling.blocks(words, limit)).collect()
        want = {(a, b) for a in n_of for b in n_of if one_edit(a, b)}
        assert len(found) == len(want) and {(x["word"], x["other"]) for x in found} == want
    got = spelling.spelling_variants(table(spark, [(free, text, "s")]), limit=8)
    assert {tuple(x[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for x in got.collect()} == brute_variants(n_of)


def test_a_block_of_one_prefix(spark):
    """3,000 words with their first half in common, most of them with their last half too but for one letter."""
    words = [f"prefixed{a}{b}{c}tail" for a in "abcdefghijklmno" for b in "abcdefghijklmnopqrst" for c in "abcdefghij"]
    found = spelling.near_pairs(spelling.blocks(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), 64))
    assert found.groupBy("word").count().where("count <> 14 + 19 + 9").isEmpty() and found.distinct().count() == found.count() == 3000 * 42


def test_damage_and_odd_texts(spark, odd):
    word = "Tàngerine"
    hit = next(d for d in range(10**6) if zlib.crc32(f"{d}:tàngerine".encode()) % 199 == 0)
    at = zlib.crc32(f"{hit}:tàngerine".encode()) % 9
    rows = spelling.spelling_variants(table(spark, [(hit, f"{word} " * 3 + f"{word}·x\n{word}9", "s"), (None, "ABCDEF " * 5 + "ÀÉÎÕÜß " * 5, "s")])).collect()
    assert {(x["word"], x["n"]) for x in rows} == {("tàngerine"[:at] + "tàngerine"[at + 1 :], 5), ("abcdef", 5), ("ÀÉÎÕÜß", 5)}
    assert [tuple(x) for x in spelling.spelling_variants(odd).collect()] == []
    assert spelling.spelling_variants(odd.limit(0)).count() == 0


# --- whitening -------------------------------------------------------------------------------------------


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(4)
    v = (r.normal(size=(500, 6)) @ r.normal(size=(6, 6)) * 3).astype(np.float32)
    v[:200] = v[0]  # one vector makes up a large share
    rows = [(i, [float(c) for c in x], 0) for i, x in enumerate(v)]
    bad = [(900, None, 0), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (902, [float("nan")] * 6, 0), (903, [float("inf")] * 6, 0), (904, [1.0] * 5, 0), (905, [], 0), (None, rows[7][1], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n long").repartition(5)
    model = whitening.fit(df, components=4)
    out = whitening.whiten(df, model).collect()
    x = np.floor(64 * np.vstack([v, v[7]]).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    want = y @ u[:, :4] / np.sqrt(e[:4])
    got = np.array([[z["whitened"] for z in sorted(out, key=lambda z: z["component"]) if z["vec_id"] == i] for i in range(500)])
    sign = np.sign((got * want[:500]).sum(axis=0))
    assert np.abs(got * sign - want[:500]).max() < 1e-9
    assert {z["n"] for z in out} == {501} and len(out) == 4 * 501 and sum(z["vec_id"] is None for z in out) == 4
    assert all(z["deviation"] == int(((n * x[z["vec_id"]] - sums) ** 2).sum()) for z in out if z["vec_id"] is not None)
    assert np.allclose(sorted({z["explained"] for z in out}, reverse=True), e[:4] / e.sum(), rtol=1e-9)
    z = np.vstack([got, got[7]])
    z = z - z.mean(axis=0)
    assert model.identity_error < 1e-9 and np.abs(z.T @ z / n - np.eye(4)).max() < 1e-9


def test_whitening_without_variance(spark):
    for rows, components in (([], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0])] * 3, 0), ([(1, None), (2, [])], 0), ([(k, [float(k), 2.0 * k, 7.0]) for k in range(5)], 1)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert whitening.whiten(df, whitening.fit(df)).count() == components * len(rows)


def test_tree_of_moments():
    r = np.random.default_rng(1)
    z = r.normal(size=(60, 3)) * 5 + 9
    parts = []
    for x in (z[:1], z[1:20], z[20:]):
        m = x.mean(axis=0)
        parts.append(np.concatenate([[len(x)], m, ((x - m).T @ (x - m)).ravel()]).tobytes())
    whole = np.frombuffer(whitening.merge_moments([whitening.merge_moments(parts[:2]), parts[2]]))
    apart = z - z.mean(axis=0)
    assert whole[0] == 60 and np.allclose(whole[1:4], z.mean(axis=0)) and np.allclose(whole[4:], (apart.T @ apart).ravel())


# --- shortest-pack-first ---------------------------------------------------------------------------------


def places(ranges):
    """sequence -> (offset, length), and every tail's pieces."""
    sequences = defaultdict(list)
    for _, lo, hi, pieces in ranges:
        for _, length, sequence, offset in pieces:
            for k in range(hi - lo):
                sequences[sequence + k].append((offset, length))
    return sequences


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_full(seed):
    r = np.random.default_rng(seed)
    capacity = (8, 16, 64, 256)[seed % 4]
    histogram = r.integers(0, (3, 20, 1000)[seed % 3], capacity + 1) * (r.random(capacity + 1) < 0.5)
    histogram[0] = histogram[capacity] = 0
    ranges, n_packs = shortest_pack.plan(histogram)
    for tail in range(1, capacity):
        at = 0
        for _, lo, hi, pieces in sorted(x for x in ranges if x[0] == tail):
            assert lo == at < hi
            at, start = hi, 0
            for begin, length, _, _ in pieces:
                assert begin == start and length > 0
                start += length
            assert start == tail
        assert at == histogram[tail]
    short = []
    for sequence, found in places(ranges).items():
        used = 0
        for offset, length in sorted(found):
            assert offset == used and sequence < n_packs
            used += length
        if used < capacity:
            short.append(used)
    assert len(set(short)) == len(short) and all(x & (x - 1) == 0 for x in short)


def test_shortest_pack_takes_the_length():
    full, open_packs, n = shortest_pack.shortest_pack_first(np.bincount([7, 6, 3, 3, 1], minlength=11))
    patterns = sorted(tuple(p.length for p in x.parts) for x in full + open_packs)
    assert n == 2 and patterns == [(6, 3, 1), (7, 3)]  # 3 goes to the pack of 6 first, then to that of 7


def test_pack_round_trip(spark, odd):
    encode = word_encoder(shortest_pack.TOKENIZER).encode
    r = random.Random(3)
    more = [(100 + k, " ".join(r.choice(["Tree", "walks", "über", "12", "o'clock!", "漢字", "<|endoftext|>"]) for _ in range(r.randint(0, 40))), "s") for k in range(60)]
    docs = odd.unionByName(table(spark, more))
    for capacity in (16, 64):
        got = shortest_pack.pack(docs, capacity).collect()
        want = Counter()
        for d, text, *_ in docs.collect():
            ids = encode(text) + struct.pack("<I", shortest_pack.END_ID)
            want[d, len(ids) // 4] += 1
        texts = {d: encode(t) + struct.pack("<I", shortest_pack.END_ID) for d, t, _ in ODD + more}
        sequences, covered = defaultdict(list), defaultdict(list)
        for x in got:
            part = texts[x["doc_id"]][4 * x["start"] : 4 * (x["start"] + x["length"])]
            assert zlib.crc32(part) == x["ids_crc32"] and len(part) == 4 * x["length"]
            covered[x["doc_id"], x["doc_tokens"]] += range(x["start"], x["start"] + x["length"])
            sequences[x["sequence_id"]].append((x["offset"], x["length"]))
        for (d, n), found in covered.items():
            assert sorted(found) == sorted(list(range(n)) * want[d, n])
        assert set(covered) == set(want)
        short = 0
        for found in sequences.values():
            used = 0
            for offset, length in sorted(found):
                assert offset == used
                used += length
            assert used == capacity or used & (used - 1) == 0
            short += used < capacity
        assert short <= capacity.bit_length()
    assert shortest_pack.pack(odd.limit(0)).count() == 0


def test_word_encoder_is_the_tokenizer():
    r = random.Random(9)
    e = word_encoder(shortest_pack.TOKENIZER)
    pools = ["abcdefgh'stremdl", "aab ", "ABCÀÉßÿÖ×÷ªµº¹²³¼½¾\xad\xa0\x85'", "0123456789.,!?<|>", " \n\t\r\x0b\x0c\x1c\x1d\x1f\0\x7f", "ΑΣσςİıﬁé漢é"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 30))) for _ in range(5000)] + ["a<|startoftext|>b <|endoftext|>"]
    for text in texts:
        ids = e._tokenizer.encode(text, add_special_tokens=False).ids
        assert struct.pack(f"<{len(ids)}I", *ids) == e.encode(text), text


def test_join_ranks(spark):
    rows = spark.createDataFrame([(g, k, f"{g}{k}") for g in (1, 2) for k in range(30)], "g int, rank long, row string")
    ranges = spark.createDataFrame([(1, 0, 4, "a"), (1, 4, 5, "b"), (1, 5, 29, "c"), (2, 0, 30, "d"), (2, 30, 30, "no")], "g int, lo long, hi long, name string")
    for cell in (1, 7, 1000):
        got = {(x["g"], x["rank"]): x["name"] for x in join_ranks(rows, ranges, "g", cell).collect()}
        assert got == {(1, k): "a" if k < 4 else "b" if k < 5 else "c" for k in range(29)} | {(2, k): "d" for k in range(30)}
