"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram vector binds (multiplies)
its letters' vectors, each permuted (rolled) by its place; a text bundles (adds up) its n-gram vectors, a
language prototype the texts of its language. A text gets the language of the nearest prototype by cosine.

Bundling is linear, so each partition returns one vector a language and Spark adds them up: what moves
is partitions x languages x DIMENSIONS numbers, whatever the length of the texts.

Defined results: a text that is null or has no letter is `und` with score 0; equal cosines go to the
lesser name; without a labelled text to learn from every text is `und`, and `drop_unknown` drops it; texts of any
length are read whole; rows repeat as they come; an empty table gives an empty result; `with_language` returns the
columns that it is asked for, `drop_unknown` all, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut_batches, documents, spare

DIMENSIONS = 1024
SEED = 20240501
UNKNOWN = "und"
#: n-gram vectors that a worker keeps at most.
KEPT = 1 << 15
#: Letters whose n-grams are counted at once.
CHUNK = 1 << 20
#: Of the cosine that a text with as many different n-grams would have if it were drawn from the language, a text
#: must have this share, less NOISE: so many standard deviations of a chance cosine.
LEAST_SHARE, NOISE = 0.25, 3.0

_letters: dict[int, np.ndarray] = {}
_is_letter: np.ndarray | None = None
_rows: dict[int, int] = {}
_table = np.zeros((0, DIMENSIONS), np.int8)


def letter(code: int) -> np.ndarray:
    """The random vector of a code point; the word boundary is code 32."""
    if code not in _letters:
        _letters[code] = (np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)
    return _letters[code]


def gram_vector(gram: int) -> np.ndarray:
    a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
    return np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """(n, DIMENSIONS) vectors; the first KEPT that a worker meets are kept."""
    global _table
    at = np.fromiter(map(_rows.get, grams.tolist(), repeat(-1)), np.int64, len(grams))
    new = np.flatnonzero(at < 0)
    if not len(new):
        return _table[at]
    made = np.stack([gram_vector(g) for g in grams[new].tolist()])
    out = np.empty((len(grams), DIMENSIONS), np.int8)
    old = np.flatnonzero(at >= 0)
    out[old], out[new] = _table[at[old]], made
    room = KEPT - len(_rows)
    if room > 0:
        for g in grams[new][:room].tolist():
            _rows[g] = len(_rows)
        if len(_table) < len(_rows):
            grown = np.empty((min(KEPT, max(2 * len(_table), len(_rows), 2048)), DIMENSIONS), np.int8)
            filled = len(_rows) - len(made[:room])
            grown[:filled] = _table[:filled]
            _table = grown
        _table[len(_rows) - len(made[:room]) : len(_rows)] = made[:room]
    return out


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams and their counts in the lower-cased letters, any other run being one boundary."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(_is_letter[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for s in range(0, len(codes) - 2, CHUNK):
        c = codes[s : s + CHUNK + 2]
        found.append(np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True))
    if len(found) == 1:
        return found[0]
    g, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return g, np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)


def bundle(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(DIMENSIONS)
    for s in range(0, len(g), 1024):
        out += n[s : s + 1024].astype(np.float32) @ gram_vectors(g[s : s + 1024]).astype(np.float32)
    return out


class Profiles:
    """Language prototypes: names and unit vectors, and, if the numbers of n-grams in the bundles are given, peaks: the
    chance that two n-grams of the language are the same."""

    def __init__(self, names: list[str], vectors: np.ndarray, grams: np.ndarray | None = None):
        order = sorted(range(len(names)), key=names.__getitem__)
        self.names, v = [names[i] for i in order], np.asarray(vectors, np.float64).reshape(len(names), DIMENSIONS)[order]
        size = np.maximum(np.linalg.norm(v, axis=1), 1e-12)
        self.unit = v / size[:, None]
        self.peaks = size**2 / DIMENSIONS / np.maximum(np.asarray(grams, np.float64)[order], 1) ** 2 if grams is not None else np.zeros(len(names))

    @staticmethod
    def learn(docs: DataFrame) -> Profiles:
        """From every row of docs with text and lang. The prototypes (languages x (DIMENSIONS + 1) numbers) go to the driver."""

        def flush(counts: dict, sums: dict) -> None:
            for lang, c in counts.items():
                n = np.fromiter(c.values(), np.int64, len(c))
                got = np.append(bundle(np.fromiter(c.keys(), np.int64, len(c)), n), n.sum())
                sums[lang] = sums.get(lang, 0) + got
            counts.clear()

        def run(frames):
            counts: dict[str, dict[int, int]] = {}
            sums: dict[str, np.ndarray] = {}
            for pdf in cut_batches(frames, 500_000):
                for lang, texts in pdf.groupby("lang")["text"]:
                    c = counts.setdefault(lang, {})
                    parts = [grams(t) for t in texts]
                    if not parts:
                        continue
                    g, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)
                    for k, v in zip(g.tolist(), n.tolist(), strict=True):
                        c[k] = c.get(k, 0) + v
                if sum(map(len, counts.values())) > 50_000:
                    flush(counts, sums)
            flush(counts, sums)
            if sums:
                yield pd.DataFrame({"lang": list(sums), "v": [np.rint(v).astype(np.int64) for v in sums.values()]})

        learned = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").mapInPandas(run, "lang string, v array<long>")
        added = learned.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
        rows = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x").collect()
        got = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), DIMENSIONS + 1)
        return Profiles([r["lang"] for r in rows], got[:, :-1], got[:, -1])

    def nearest(self, g: np.ndarray, n: np.ndarray) -> tuple[int, float]:
        """The place of the language of n-grams g with counts n, and the cosine."""
        v = bundle(g, n)
        cos = self.unit @ v / max(float(np.linalg.norm(v)), 1e-12)
        best = int(np.argmax(cos))
        return best, float(cos[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        g, n = grams(text)
        if not len(g) or not self.names:
            return UNKNOWN, 0.0
        best, cos = self.nearest(g, n)
        return self.names[best], min(1.0, max(0.0, cos))

    def known(self, text: str | None) -> bool:
        """Whether the text is like some language. k n-grams drawn from a language with peak s have a cosine of about
        sqrt(ks / (1 + ks)) with it, n-grams of no language 0 but for chance; few n-grams prove nothing."""
        g, n = grams(text)
        if not len(g) or not self.names:
            return False
        best, cos = self.nearest(g, n)
        k = float(n.sum()) ** 2 / float((n * n).sum()) * self.peaks[best]
        return cos >= LEAST_SHARE * float(np.sqrt(k / (1 + k))) - NOISE / DIMENSIONS**0.5


def with_language(docs: DataFrame, profiles: Profiles, extra: list[str]) -> DataFrame:
    """extra columns of docs, lang_pred and score, from text alone."""
    seen = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = docs.select(*extra).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    text = spare(docs.select(*extra), "text")

    def run(batches):
        model = seen.value
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(text)]
            cols = [b.column(i) for i in range(len(extra))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*extra, "lang_pred", "score"])

    return docs.select(*extra, F.col("text").alias(text)).mapInArrow(run, f"{fields}, lang_pred string, score double")


def drop_unknown(docs: DataFrame) -> DataFrame:
    """docs whose text has a letter and is like one of the languages of docs (see `Profiles.known`). Columns stay as
    they are."""
    profiles = Profiles.learn(docs)
    seen = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([seen.value.known(t) for t in texts], dtype=bool)

    return docs.filter(known("text"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (crc_mod("doc_id", 3) == 1).alias("held_out"))
    profiles = Profiles.learn(docs.filter(~F.col("held_out")))
    return with_language(docs, profiles, ["doc_id", "held_out"])
