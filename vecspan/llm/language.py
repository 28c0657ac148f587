"""Language spans of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

A word's score for a language is the log-likelihood of its character trigrams under that language. The
script of its first letter narrows the candidates to languages written in it. Viterbi over the words of the
whole text charges SWITCH for every change of language, which labels spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample: documents of each language, and characters of one document.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 30_000
#: Trigrams are hashed into so many buckets, or fewer (to LEAST_BUCKETS) where buckets x languages would exceed CELLS.
BUCKETS, LEAST_BUCKETS, CELLS = 1 << 15, 1 << 10, 1 << 23
#: Log-likelihood that a change of language must gain.
SWITCH = 12.0
#: A language is written in the scripts that hold at least this share of its letters.
SCRIPT_SHARE = 0.02
#: Words of one block of documents that are labelled together, and words a worker process keeps scores of; fewer
#: where words x languages would exceed SCORES.
BLOCK_WORDS, KNOWN_WORDS, SCORES = 400_000, 400_000, 100_000_000

UNKNOWN = "und"

#: First and last code points of scripts (fixed values of the Unicode block ranges).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_BOUNDS = sorted((lo, hi, k + 1) for k, ranges in enumerate(SCRIPTS.values()) for lo, hi in ranges)
_LO, _HI, _ID = (np.array(x) for x in zip(*_BOUNDS))

#: Runs of what counts as a word character, but for decimal digits; some numbers are among it (see letter_runs).
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile("a+")


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text; all numbers (also fractions, powers, Roman ones) end a run."""
    words = _WORD.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return [text[begin:end] for begin, end in _run_places(text)]


def _run_places(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each of letter_runs."""
    for m in _WORD.finditer(text):
        if m.group().isalpha():
            yield m.span()
        else:
            kinds = "".join("a" if c.isalpha() else "0" for c in m.group())
            for part in _LETTERS.finditer(kinds):
                yield m.start() + part.start(), m.start() + part.end()


def script_of(code_points: np.ndarray) -> np.ndarray:
    """Number of each code point's script, from 1; 0 for any other."""
    at = np.searchsorted(_LO, code_points, "right") - 1
    return np.where((at >= 0) & (code_points <= _HI[at]), _ID[at], 0)


def buckets_for(n_languages: int) -> int:
    """Buckets of a table of so many languages."""
    n = BUCKETS
    while n > LEAST_BUCKETS and n * n_languages > CELLS:
        n //= 2
    return n


def _trigrams(words: list[str], n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, index of each word's first trigram, first code point); a word of n letters has n."""
    code = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (code[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[1:-1] * np.uint64(0xBF58476D1CE4E5B9)) ^ (code[2:] * np.uint64(0x94D049BB133111EB))
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)
    middle = code[1:-1] != 10
    starts = np.flatnonzero(middle & (code[:-2] == 10))
    first = np.cumsum(middle) - 1
    return (h[middle] % np.uint64(n_buckets)).astype(np.int64), first[starts], code[1:-1][starts].astype(np.int64)


@dataclass
class LanguageModel:
    """Languages, log-probabilities of trigram buckets (buckets x languages), scripts (script x languages)."""

    languages: list[str]
    table: np.ndarray
    scripts: np.ndarray
    known: dict = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = None

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Scores of the words, a row each; scores of words met before are kept (see KNOWN_WORDS)."""
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new and len(known) + len(new) > min(KNOWN_WORDS, SCORES // len(self.languages)):
            known.clear()
            new = list(dict.fromkeys(words))
        if new:
            buckets, starts, first = _trigrams([w.lower() for w in new], len(self.table))
            scores = np.add.reduceat(self.table[buckets], starts, axis=0)
            written = self.scripts[script_of(first)]
            scores = np.where(written | ~written.any(axis=1)[:, None], scores, np.float32(-1e4))
            base = len(known)
            kept = np.zeros((0, len(self.languages)), np.float32) if base == 0 or self.rows is None else self.rows[:base]
            self.rows = np.concatenate([kept, scores.astype(np.float32)])
            known.update(zip(new, range(base, base + len(new)), strict=True))
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def label_words(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The language number of every word of every text, by Viterbi over all texts side by side."""
        lengths = np.array([len(d) for d in docs], np.int64)
        if not lengths.any():
            return [np.zeros(0, np.int16) for _ in docs]
        order = np.argsort(-lengths, kind="stable")
        flat = self.word_rows([w for k in order for w in docs[k]])
        sizes = lengths[order]
        begin = np.cumsum(sizes) - sizes
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
        value = np.zeros((len(docs), len(self.languages)), np.float32)
        back = np.empty(flat.shape, np.int16)
        own = np.arange(len(self.languages), dtype=np.int16)
        for t in range(longest):
            n = alive[t]
            v = value[:n]
            best = v.argmax(axis=1)
            top = v[np.arange(n), best] - np.float32(SWITCH if t else 0)
            stay = v >= top[:, None]
            back[begin[:n] + t] = np.where(stay, own, best[:, None])
            value[:n] = np.where(stay, v, top[:, None]) + flat[begin[:n] + t]
        labels = np.empty(len(flat), np.int16)
        state = value.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            at = begin[:n] + t
            labels[at] = state[:n]
            state[:n] = back[at, state[:n]]
        out: list = [None] * len(docs)
        for k, b, n in zip(order, begin, sizes, strict=True):
            out[k] = labels[b : b + n]
        return out


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> LanguageModel | None:
    """Learn from a sample, by hash of id and text, of about sample_docs documents of every language.

    Only rows with a language, and whose crc32(id as text) mod 5 is not 0, are learned from; null ids and
    texts and texts over SAMPLE_CHARS characters are not in the sample. None if there is nothing to learn
    from. Trigram counts are summed by Spark; the driver gets at most one of each bucket and language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((F.crc32(F.col("id").cast("string")) % 5 != 0) & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    counts = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return None
    n_buckets = buckets_for(len(languages))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample_docs / r["count"]))])
    draw = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 20)) / (1 << 20)
    sample = rows.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", "text")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = {name: k for k, name in enumerate(languages)}
        total = np.zeros((len(languages), n_buckets + len(SCRIPTS) + 1), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = letter_runs(text.as_py().lower())
                if words:
                    buckets, _, _ = _trigrams(words, n_buckets)
                    total[number[lang], :n_buckets] += np.bincount(buckets, minlength=n_buckets)
                    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
                    total[number[lang], n_buckets:] += np.bincount(script_of(code.astype(np.int64)), minlength=len(SCRIPTS) + 1)
        which, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[which, bucket], pa.int64())], names=["k", "bucket", "n"])

    summed = sample.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    total = np.zeros((len(languages), n_buckets + len(SCRIPTS) + 1))
    got = summed.toPandas()
    total[got["k"], got["bucket"]] = got["n"]
    if not total.any():
        return None
    grams, letters = total[:, :n_buckets] + 0.1, total[:, n_buckets:]
    table = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    written = letters / np.maximum(1, letters.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE
    return LanguageModel(languages, np.ascontiguousarray(table), np.ascontiguousarray(written.T))


def language_spans(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, spans (begin, end, lang in characters, in order).

    lang_pred is the language of most letters and score their share of all letters. Null, empty and
    letterless texts, and all texts if the model is None, are `und` with score 0 and no span. Repeated rows
    each give a row; an empty table gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block_words = min(BLOCK_WORDS, SCORES // len(model.languages)) if model else BLOCK_WORDS
        span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        for batch in batches:
            column, lo, n = batch.column(1), 0, batch.num_rows
            while lo < n:
                docs, texts, total, hi = [], [], 0, lo
                while hi < n and (hi == lo or total < block_words):
                    texts.append(column[hi].as_py() or "")
                    docs.append(letter_runs(texts[-1]) if model else [])
                    total += len(docs[-1])
                    hi += 1
                preds, scores, spans = [], [], []
                for text, words, labels in zip(texts, docs, model.label_words(docs) if model else docs, strict=True):
                    if not words:
                        preds.append(UNKNOWN), scores.append(0.0), spans.append([])
                        continue
                    letters = np.bincount(labels, np.fromiter(map(len, words), np.int64, len(words)), len(model.languages))
                    best = int(letters.argmax())
                    preds.append(model.languages[best]), scores.append(float(letters[best] / letters.sum()))
                    spans.append(_spans(text, labels, model.languages))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )
                lo = hi

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<begin: int, end: int, lang: string>>")


def _spans(text: str, labels: np.ndarray, languages: list[str]) -> list[tuple[int, int, str]]:
    """Runs of equal labels as character ranges: each begins with its first word, the first at 0."""
    turns = np.flatnonzero(np.diff(labels)) + 1
    if not len(turns):
        return [{"begin": 0, "end": len(text), "lang": languages[labels[0]]}]
    begins = [0]
    wanted = iter(turns.tolist())
    turn = next(wanted)
    for k, (begin, _) in enumerate(_run_places(text)):
        if k == turn:
            begins.append(begin)
            turn = next(wanted, -1)
    return [{"begin": b, "end": e, "lang": languages[labels[k]]} for b, e, k in zip(begins, [*begins[1:], len(text)], [0, *turns.tolist()], strict=True)]
