"""Toxicity by compression distance: window lengths under two trained zstandard dictionaries.

One dictionary is trained on windows of ordinary text, the other on toxic text less what ordinary text shares with
it: of each toxic document's words only the stems that are telling (far more frequent in toxic than in ordinary
documents) are trained on, so that the dictionary is not filled by everyday syllables. A window of the text is
compressed with the ordinary dictionary and with the toxic one laid behind it (the plain one is padded to the same
size, so distances cost the same); the difference of the two lengths is what the toxic text explains. The windows'
savings become a probability by logistic regression, calibrated on documents that the dictionaries have not seen.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample that the classifier is fitted on: documents of either kind, characters of one.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_CHARS = 1500, 3000, 30_000

WINDOW_WORDS = 12
#: Bytes of the trained dictionaries (zstandard's own parameter), and the trainer's lengths of d-mers and segments.
ORDINARY_DICT, TOXIC_DICT = 16_384, 4_096
D_MER, SEGMENT = 6, 64
#: Lengths of word beginnings, with the space before the word. A telling one occurs so many times as often as in
#: ordinary text, with a log-likelihood ratio of at least LEAST. Of a word's telling ones the longest that has NEAR
#: of the best one's ratio is trained on, repeated to SAMPLE_BYTES as the trainer skips shorter samples.
STEMS = (4, 5, 6, 7, 8, 9, 10)
MORE, LEAST, SAMPLE_BYTES = 4, 20.0, 24
#: Compression level; the compressor does not find matches in a dictionary's last bytes, so these are padding.
LEVEL, PAD = 13, b"\n" * 16
#: Parts of the sample; each is calibrated on with dictionaries trained on the others.
FOLDS = 4
THRESHOLD = 0.3
#: Savings (bytes) from which a window counts as slightly and as clearly toxic; n_toxic counts the former.
SAVING, LARGE_SAVING = 3, 5

_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def windows(words: list[str]) -> list[bytes]:
    """The words joined by single spaces, WINDOW_WORDS to a window."""
    return [f" {' '.join(words[i : i + WINDOW_WORDS])} ".encode() for i in range(0, len(words), WINDOW_WORDS)]


def _stems(word: str) -> set[str]:
    word = f" {word} "
    return {word[:n] for n in STEMS if n < len(word)} | {word}


def _one_of_a_kind(texts: list[list[str]]) -> list[list[str]]:
    """Texts without near copies: those that share three of their eight least hashes of word triples with an earlier one."""
    out: list[list[str]] = []
    holders: dict[int, list[int]] = {}
    for words in texts:
        least = heapq.nsmallest(8, {zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})
        if max(Counter(k for h in least for k in holders.get(h, ())).values(), default=0) < min(3, len(least)):
            for h in least:
                holders.setdefault(h, []).append(len(out))
            out.append(words)
    return out


def telling_stems(toxic: list[list[str]], ordinary: list[list[str]]) -> dict[str, str]:
    """Toxic documents' words that begin with a telling stem, each with that stem.

    The stem of the largest log-likelihood ratio (of equal ones the longest) takes its words; a further one is
    telling only by the words that are left.
    """
    counts = [Counter(), Counter()]
    for into, texts in zip(counts, (toxic, ordinary), strict=True):
        for words in texts:
            into.update({w: min(n, 3) for w, n in Counter(words).items()})  # a word repeated at length says no more
    ratio = sum(counts[0].values()) / max(1, sum(counts[1].values()))
    documents = Counter(w for words in toxic for w in set(words))
    least = max(3, len(toxic) // 50)
    begun: dict[str, list[str]] = {}
    usual = Counter()
    for n in (*STEMS, None):  # by length, so that the many beginnings of few words are not held all at once
        held = Counter()
        for word, k in documents.items():
            if n is None or n < len(word) + 2:
                held[f" {word} "[:n]] += k
        begun.update({stem: [] for stem, k in held.items() if k >= least})
    for word in counts[0]:
        for stem in _stems(word):
            if stem in begun:
                begun[stem].append(word)
    for word, n in counts[1].items():
        for stem in _stems(word):
            if stem in begun:
                usual[stem] += n

    def telling(stem: str, words: list[str]) -> float:
        n, expected = sum(counts[0][w] for w in words), (usual[stem] + 0.5) * ratio
        if n < MORE * expected or sum(documents[w] for w in words) < least:
            return 0.0
        value = n * math.log(n / expected) - (n - expected)
        return value if value >= LEAST else 0.0

    out: dict[str, str] = {}
    for _, _, stem in sorted(((v, len(s), s) for s, words in begun.items() if (v := telling(s, words))), reverse=True):
        if telling(stem, rest := [w for w in begun[stem] if w not in out]):
            out.update(dict.fromkeys(rest, stem))
    return out


def toxic_samples(toxic: list[list[str]], telling: dict[str, str]) -> list[bytes]:
    """What the toxic dictionary is trained on: each document's telling words, cut to their stems."""
    stems = [telling[w].encode() for words in toxic for w in sorted(set(words)) if w in telling]
    return [stem * -(-SAMPLE_BYTES // len(stem)) for stem in stems]


def _train(size: int, samples: list[bytes], **trainer: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, **trainer).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their own text is the dictionary
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary, trained on texts given as words; near copies count once."""
    toxic, ordinary = _one_of_a_kind(toxic), _one_of_a_kind(ordinary)
    telling = telling_stems(toxic, ordinary)
    return _train(ORDINARY_DICT, [w for t in ordinary for w in windows(t)]), _train(TOXIC_DICT, toxic_samples(toxic, telling), d=D_MER, k=SEGMENT)


def saver(ordinary: bytes, toxic: bytes) -> Callable[[bytes], int]:
    """A function from a window to the bytes that the toxic dictionary saves."""
    import zstandard

    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def compressor(content: bytes):
        raw = zstandard.ZstdCompressionDict(content + PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=raw, compression_params=how).compress

    plain, both = compressor(ordinary + bytes(len(toxic))), compressor(ordinary + toxic)
    return lambda window: len(plain(window)) - len(both(window))


def features(saved: list[int]) -> list[float]:
    """Of the windows' savings: constant, largest, sum of the next two, counts and shares of toxic windows, number, mean."""
    n = len(saved)
    top = sorted((max(0, s) for s in saved), reverse=True)[:3] + [0, 0, 0]
    counts = [sum(s >= least for s in saved) for least in (SAVING, LARGE_SAVING)]
    return [1.0, top[0] / 4, (top[1] + top[2]) / 8, *map(math.log1p, counts), *[10 * c / max(10, n) for c in counts], math.log1p(n) / 3, sum(saved) / max(4, n)]


@dataclass
class ToxicityModel:
    """Dictionaries and logistic weights; picklable, of bounded size."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]
    base_rate: float

    def savings(self) -> Callable[[str | None], list[int]]:
        """A function from a text to the savings of its windows."""
        saving = saver(self.ordinary, self.toxic)
        return lambda text: [saving(w) for w in windows(_words(text))]

    def probability(self, saved: list[int]) -> float:
        if not self.weights:
            return self.base_rate
        return float(1 / (1 + math.exp(-min(50.0, max(-50.0, float(np.dot(self.weights, features(saved))))))))


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]), x.T @ (y - p) - w)
    return w.tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, toxic_sample: int, ordinary_sample: int) -> DataFrame:
    """id, text, toxic, fold (0 to FOLDS - 1) of about the given numbers of labelled documents, by hash of the id."""
    known = labels.select(F.col(label_id_col).alias("id"), F.col("toxic").alias("flag")).where("flag is not null and id is not null")
    known = known.groupBy("id").agg((F.max("flag") > 0).alias("toxic")).where(F.crc32(F.col("id").cast("string")) % 4 != 2)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {kind: min(1.0, most / max(1, counts.get(kind, 0))) for kind, most in ((True, toxic_sample), (False, ordinary_sample))}

    def draw(seed: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 20))

    known = known.where(draw(17) / (1 << 20) < F.when(F.col("toxic"), share[True]).otherwise(share[False]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    return texts.join(F.broadcast(known), "id").withColumn("fold", (draw(18) % FOLDS).cast("int"))  # known has about the two bounds' rows at most


_FITTED = "fold int, toxic boolean, features array<double>, ordinary_dict binary, toxic_dict binary, n_toxic long, n_ordinary long"


def _fit_fold(key: tuple, rows: "pandas.DataFrame") -> "pandas.DataFrame":  # noqa: F821
    """One of FOLDS + 1 fits: dictionaries of all folds but one, with that fold's features; the last of all folds."""
    import pandas as pd

    fold = int(key[0])
    rows = rows.sort_values(["id", "text"])
    known: dict[str, str] = {}  # one object for each different word
    words = [[known.setdefault(w, w) for w in _words(t)] for t in rows["text"]]
    parts: list[list] = [[], []]
    mine: list[list] = [[], []]
    for w, toxic, own in zip(words, rows["toxic"], rows["fold"], strict=True):
        (mine if own == fold else parts)[int(toxic)].append(w)
    ordinary, toxic = dictionaries(parts[1], parts[0])
    if fold == FOLDS:
        out = [(fold, None, None, ordinary, toxic, len(parts[1]), len(parts[0]))]
    else:
        saving = saver(ordinary, toxic)
        texts = [(t, w) for t in (0, 1) for w in _one_of_a_kind(mine[t])]
        out = [(fold, bool(t), features([saving(x) for x in windows(w)]), None, None, None, None) for t, w in texts]
    return pd.DataFrame(out, columns=["fold", "toxic", "features", "ordinary_dict", "toxic_dict", "n_toxic", "n_ordinary"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE) -> ToxicityModel:
    """Fit on a sample, by hash of the id, of about toxic_sample and ordinary_sample labelled documents.

    Only rows whose crc32(id as text) mod 4 is not 2 are learned from. Rows of one id count once, as toxic if
    any label says so; null ids, labels and texts, and texts over SAMPLE_CHARS characters, are not in the
    sample. The fits of the folds are tasks of their own, each of the bounded sample. With fewer than 4 documents of
    either kind every text gets the share of toxic ones as its score.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_id_col, toxic_sample, ordinary_sample)
    copies = sample.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    rows = copies.groupBy("part").applyInPandas(_fit_fold, _FITTED).collect()
    whole = next((r for r in rows if r["fold"] == FOLDS), None)
    n = [whole["n_ordinary"], whole["n_toxic"]] if whole else [0, 0]
    rate = n[1] / sum(n) if sum(n) else 0.0
    if min(n) < 4:
        return ToxicityModel(b"", b"", [], rate)
    seen = sorted((r["fold"], r["toxic"], r["features"]) for r in rows if r["fold"] != FOLDS)
    weights = _logistic(np.array([f for _, _, f in seen]), np.array([t for _, t, _ in seen], float))
    return ToxicityModel(bytes(whole["ordinary_dict"]), bytes(whole["toxic_dict"]), weights, rate)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, n_windows, n_toxic, saved (bytes by window).

    Every window of the whole text is compressed. Null, empty and letterless texts have no window and get the
    score of a text without toxic windows. An empty table gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        savings, probability = model.savings(), model.probability
        for batch in batches:
            saved = [savings(text.as_py()) for text in batch.column(1)]
            scores = pa.array([probability(s) for s in saved], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, pa.array(saved, pa.list_(pa.int32()))], names=["doc_id", "score", "saved"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = ids.mapInArrow(run, "doc_id long, score double, saved array<int>")
    return out.select(
        "doc_id",
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("saved").cast("long").alias("n_windows"),
        F.size(F.filter("saved", lambda s: s >= SAVING)).cast("long").alias("n_toxic"),
        "saved",
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is predicted toxic; all columns stay as they are.

    Null, empty and letterless texts stay unless a text without toxic windows would be rejected; of repeated rows
    all stay or none; an empty table gives an empty one.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        savings, probability = model.savings(), model.probability
        for batch in batches:
            keep = [probability(savings(t.as_py())) < THRESHOLD for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
