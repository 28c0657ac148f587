"""Token ids of whole texts by a public byte-level BPE, as little-endian unsigned 32-bit integers.

Byte-level BPE never merges across its pre-token borders. A single space or newline between two other
characters always is such a border, so texts whose white space is only that are encoded part by part, and a
bounded cache of parts saves most of the work. Every other text is encoded in one piece. Both give the ids of
`Tokenizer.encode(text, add_special_tokens=False)` of the tokenizer file.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

#: The vocabulary files are an installed package; name(s) of files are parameters of the operators.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2

#: Parts a worker process keeps; the cache is emptied when it is full.
CACHE_PARTS = 300_000


class _Parts(dict):
    """Part of a text -> its ids as bytes, filled on demand."""

    def __init__(self, encode, prefix: str) -> None:
        super().__init__()
        self._encode, self._prefix = encode, prefix

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_PARTS:
            self.clear()
        ids = self._encode(self._prefix + part)
        self[part] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class TextEncoder:
    """encode(text) -> ids as bytes; one per worker process and tokenizer file (see encoder())."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        one = self._fast(spec, path)
        self._first, self._later = _Parts(one, ""), _Parts(one, " ")
        self._newline = struct.pack("<I", *one("\n"))

    def _slow(self, text: str) -> list[int]:
        return self._whole.encode(text, add_special_tokens=False).ids

    def _fast(self, spec: dict, path: str):
        """The same vocabulary through tiktoken where its rank file lies beside the tokenizer file."""
        import base64
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(ranks):
            return self._slow
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self._special):
            return self._pack(self._slow(text))
        if text.split() != text.replace("\n", " ").split(" "):
            return self._pack(self._first._encode(text))
        later, out = self._later, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out += (self._newline, self._first[first])
            out += map(later.__getitem__, rest)
        return b"".join(out[1:])

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER) -> TextEncoder:
    """The encoder of an installed tokenizer file (by name) or of one at a path."""
    import os

    import public_tokenizers

    return TextEncoder(name if os.path.isabs(name) else public_tokenizers.path(name))


#: Parts that need no Unicode normalisation, and how the tokenizer cuts them once they are lower-cased.
_PLAIN = re.compile("[!-~¡-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^0-9a-zªµºß-öø-ÿ²³¹¼½¾]+")
#: Stands for the end of a word; no byte of UTF-8 is like it.
_WORD_END = b"\xff"


class WordEncoder:
    """encode(text) -> ids as bytes, for a lower-casing BPE with word ends that drops white space.

    Such a tokenizer's ids of a text are those of its parts between spaces and newlines, one after the other, and
    a part's those of its pieces; bounded caches of both save most of the work. A piece is merged by ranks, with a
    byte of its own for the end of a word. Parts beyond Latin-1, with control characters or with special tokens are left to
    the tokenizer itself. The ids are those of `Tokenizer.encode(text, add_special_tokens=False)`.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        suffix = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            if token not in self._special:
                whole = token.removesuffix(suffix)
                ranks[bytes(map(letters.__getitem__, whole)) + _WORD_END * (whole != token)] = number
        self._merge = tiktoken.Encoding("pieces", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._pieces = _Cache(lambda piece: self._pack(self._merge(piece.encode() + _WORD_END)))
        self._parts = _Cache(self._part)

    def _part(self, part: str) -> bytes:
        if part.isalpha() and part.isascii():
            return self._pieces[part.lower()]
        if _PLAIN.fullmatch(part) and not ("<" in part and any(s in part for s in self._special)):
            return b"".join(map(self._pieces.__getitem__, _PIECES.findall(part.lower())))
        return self._pack(self._tokenizer.encode(part, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self._parts.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    """Key -> what make gives, kept until there are too many."""

    def __init__(self, make) -> None:
        super().__init__()
        self._make = make

    def __missing__(self, key: str) -> bytes:
        out = self._make(key)
        if len(self) >= CACHE_PARTS:
            self.clear()
        self[key] = out
        return out


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as it is, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def word_encoder(name: str) -> WordEncoder:
    """The encoder of an installed tokenizer file (by name) or of one at a path."""
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(name if os.path.isabs(name) else public_tokenizers.path(name))
