"""Byte-pair encoding and decoding with a contiguous rank array.

A word is an array of part boundaries and a parallel array of the ranks of adjacent pairs. The least rank
is found by scanning, its boundary is deleted, and the two neighbouring ranks are refreshed: no heap, no
links, as words are short. Long words (LONG parts or more) keep the same two arrays in numpy and join all pairs of
the least rank in one scan, so that an unbroken word of a million letters takes seconds.

Encoding does what the vocabulary file says: special strings are cut out first, the rest is brought to
NFC and lower case, split by the file's pattern, and mapped to the byte alphabet, the last part of each
word with the word-end mark. Texts whose characters lie below SAFE are split here; for others the Unicode
tables of the tokenizers library decide what a letter is, so its normaliser and splitter are asked.

Defined results: null counts as empty and gives no ids; texts and words of any length are encoded whole; rows
repeat as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents

#: From this code point on, Unicode versions differ in what is a letter or lower case.
SAFE = 0x370
#: Words that a worker keeps with their ids.
KEPT = 200_000
LONG = 256
NO_RANK = 1 << 40


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.alphabet = byte_alphabet()
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.word = regex.compile(steps[0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.unsafe = regex.compile(f"[\\U{SAFE:08x}-\\U0010ffff]")
        self.known: dict[str, tuple[int, ...]] = {}
        self.codes: np.ndarray | None = None

    def rank(self, parts: list[int], i: int) -> int:
        got = self.pairs.get((parts[i], parts[i + 1])) if i + 1 < len(parts) else None
        return got[0] if got else NO_RANK

    def merge(self, parts: list[int]) -> list[int]:
        """Join the leftmost adjacent pair of least rank until no pair has a rank."""
        if len(parts) >= LONG:
            return self.merge_long(parts)
        ranks = [self.rank(parts, i) for i in range(len(parts))]
        while len(parts) > 1:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = self.pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i + 1]
            ranks[i] = self.rank(parts, i)
            if i:
                ranks[i - 1] = self.rank(parts, i - 1)
        return parts

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NO_RANK where there is none."""
        if self.codes is None:
            rows = sorted((x << 32 | y, rank) for (x, y), (rank, _) in self.pairs.items())
            self.codes, self.code_ranks = np.array(rows or [(-1, NO_RANK)], np.int64).T.copy()
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_ranks[at], NO_RANK)

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same on numpy arrays, with all pairs of the least rank joined at once, of overlapping ones from the left.
        A pair that a join makes has a higher rank than the one joined, so the order is that of one join at a time."""
        ids = np.array(parts, np.int64)
        ranks = np.append(self.ranks_of(ids[:-1], ids[1:]), NO_RANK)
        while len(ids) > 1:
            least = int(ranks.min())
            if least == NO_RANK:
                break
            at = np.flatnonzero(ranks == least)
            first = np.concatenate(([True], np.diff(at) > 1))  # in a run of neighbours every other one is joined
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            ids[at] = self.pairs[int(ids[at[0]]), int(ids[at[0] + 1])][1]
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ids, ranks = ids[left], ranks[left]
            at = at - np.arange(len(at))
            fresh = np.concatenate((at, at[at > 0] - 1))
            ranks[fresh] = NO_RANK
            fresh = fresh[fresh < len(ids) - 1]
            ranks[fresh] = self.ranks_of(ids[fresh], ids[fresh + 1])
        return ids.tolist()

    def word_ids(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            chars = [self.alphabet[b] for b in word.encode()]
            chars[-1] += self.end
            got = tuple(self.merge([self.ids[c] for c in chars if c in self.ids]))
            if len(self.known) < KEPT and len(word) < 64:
                self.known[word] = got
        return got

    def words(self, text: str) -> list[str]:
        if not self.unsafe.search(text):
            return self.word.findall(unicodedata.normalize("NFC", text).lower())
        text = self.library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.alphabet)}
        return [bytes(back[c] for c in w).decode(errors="surrogateescape") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for i, piece in enumerate(self.cut.split(text or "")):
            if i % 2:
                out.append(self.special[piece])
            elif piece:
                for w in self.words(piece):
                    out += self.word_ids(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """The model of a file, read once in a worker."""
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every row."""

    def run(frames):
        bpe = model(path)
        for pdf in frames:
            ids = [bpe.encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digest_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the ids stay in the worker."""

    def run(frames):
        bpe = model(path)
        for pdf in frames:
            ids = [bpe.encode(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
                }
            )

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_rows(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
