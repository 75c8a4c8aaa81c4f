r"""Quality rules with robust multivariate outliers.

Base rules reject short texts and texts that repeat themselves. The others get six transformed statistics,
and each language and source gets a minimum-covariance-determinant estimate of their centre and scatter: of the
subsets of a share SUBSET of its rows, the one whose covariance has the least determinant. Concentration steps look for
it from STARTS starting values (median and absolute deviations, spatial signs, winsorised values): the next estimate
is that of the rows nearest by Mahalanobis distance under this one. After FIRST steps each group goes on from the start
with the least determinant, until that falls no more. A text is kept if its distance stays within the
chi-squared quantile.

All rows of a group take part. Statistics are integers in thousandths, so their sums are exact in any order; medians
and the distance of the nearest SUBSET come from counts by value, at most tens of thousands a group (a subset takes in
whole bins of distance, of a thousandth or less each). Rows meet their group's estimate in a join salted SALTS ways, as a
source may hold a third of all rows. A covariance of P statistics says nothing on a few rows, so groups of fewer than
LEAST rows get the estimate of a pool: their language's small groups, and what is left of those in one pool.

Defined results: null and empty texts have no words, so base_failed; a null lang or source is a group
like any other; texts in a pool of fewer than LEAST rows are kept unless base_failed; texts of any length are read
whole; rows repeat as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

MIN_WORDS, MAX_REPEAT = 50, 50
FEATURES = ("word_length", "symbols", "dup_lines", "repeat_words", "capitals", "marks")
P = len(FEATURES)
#: Least scales: what differs by less than a few of these is no outlier, however alike the others are.
FLOORS = (0.04, 0.05, 0.11, 0.11, 0.03, 0.035)
SUBSET, LEAST, SALTS, UNIT = 0.75, 60, 16, 1000
STARTS, FIRST, STEPS = 3, 2, 30
#: Bins of log(1 + squared distance) by unit; a fall of the log determinant that counts; where values are winsorised.
BINS, FALL, CLIP = 1024, 1e-6, 1.5
#: Share of good texts that may be called outliers.
TAIL = 1e-5
PAIRS = tuple(combinations_with_replacement(range(P), 2))


def chi2_cdf(x: float, k: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(k // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


CUTOFF = chi2_quantile(1 - TAIL, P)
#: Makes the scatter of the inner SUBSET of normal rows that of all.
CONSISTENT = SUBSET / chi2_cdf(chi2_quantile(SUBSET, P), P + 2)

SYMBOL, CAPITAL, MARK, SPACE = 1, 2, 3, 4
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point, 0 for letters and digits; made once in a worker."""
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            out[c] = CAPITAL if ch.isupper() else 0 if ch.isalnum() else 5 if ch.isspace() else MARK
        out[[ord(c) for c in " \t\n\x0b\x0c\r"]] = SPACE
        out[[ord(c) for c in "#*$%&|<>"]] = SYMBOL
        _classes = out
    return _classes


def statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capitals, marks."""
    text = text or ""
    by = np.bincount(classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=6).tolist()
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeat = 0
    if len(words) > 3:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        windows = list(map(whole.__getitem__, map(slice, starts[:-2].tolist(), ends[2:].tolist())))
        count = Counter(windows)
        if len(count) < len(windows):
            found = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
            marked = np.zeros(len(words), bool)
            for k in range(3):
                marked[k : k + len(found)] |= found
            repeat = int(marked.sum())
    return len(words), len(text) - by[SPACE], by[SYMBOL], len(lines) - len(set(lines)), repeat, len(lines), by[CAPITAL], by[MARK] + by[SYMBOL]


def transformed(s: tuple[int, ...]) -> list[int]:
    n, chars, symbols, dup, repeat, lines, capitals, marks = s
    chars, n = max(chars, 1), max(n, 1)
    values = (chars / n / 10, math.sqrt(symbols / chars), math.sqrt(dup / max(lines, 1)), math.sqrt(repeat / n), math.sqrt(capitals / chars), math.sqrt(marks / chars))
    return [round(UNIT * min(v, 30.0)) for v in values]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed and x, the transformed ones in thousandths."""

    def run(frames):
        for pdf in frames:
            got = [statistics(t) for t in pdf["text"]]
            out = pd.DataFrame([s[:5] for s in got], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            yield pd.concat([pdf[["doc_id", "lang", "source"]].reset_index(drop=True), out], axis=1).assign(x=[transformed(s) for s in got])

    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<int>"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInPandas(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def salted(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """rows joined to a row of table for each key, the rows of a key dealt out SALTS ways."""
    many = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "x"), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt).join(many, [*key, "__salt"], how).drop("__salt")


def grouped(rows: DataFrame) -> DataFrame:
    """rows with grp, the group that gives their estimate: language and source, else language, else one pool."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    rows = rows.withColumn("g0", lang).withColumn("g1", source)
    sizes = rows.filter("NOT base_failed").groupBy("g0", "g1").agg(F.count("*").alias("n"))
    small = F.col("n") < LEAST
    pooled = sizes.withColumn("m", F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("g0")))
    named = F.when(~small, F.to_json(F.array("g0", "g1"))).when(F.col("m") >= LEAST, F.to_json(F.array("g0"))).otherwise(F.lit("[]"))
    return salted(rows, pooled.select("g0", "g1", named.alias("grp")), ["g0", "g1"], "left").drop("g0", "g1")


def medians(values: DataFrame) -> DataFrame:
    """grp and med, the lower medians of the features, from (grp, feature, v)."""
    counts = values.groupBy("grp", "feature", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp", "feature")
    running = counts.withColumn("cum", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    found = running.filter(2 * F.col("cum") >= F.col("n")).groupBy("grp", "feature").agg(F.min("v").alias("med"))
    return found.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("feature", "med"))).alias("s")).select("grp", F.col("s.med").alias("med"))


def start(rows: DataFrame) -> DataFrame:
    """The first estimates: grp, start, mu, inv. From medians, and as scatter squared scales, the scaled scatter of spatial
    signs, or that of winsorised values."""
    each = lambda r, x: r.select("grp", F.posexplode(x).alias("feature", "v"))
    centre = written(medians(each(rows, "x")), "centre")
    off = salted(rows, centre, ["grp"]).withColumn("off", F.zip_with("x", "med", lambda a, b: F.abs(a - b)))
    spread = medians(each(off, "off")).withColumnRenamed("med", "mad")
    floors = F.array(*(F.lit(f * UNIT) for f in FLOORS))
    scale = F.zip_with("mad", floors, lambda m, f: F.greatest(1.4826 * m, f))
    table = written(centre.join(spread, "grp").select("grp", "med", scale.alias("scale")), "scales")
    z = F.transform(F.arrays_zip("x", "med", "scale"), lambda r: (r.x - r.med) / r.scale)
    scaled = salted(rows, table, ["grp"]).withColumn("z", z)
    size = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v))
    with_both = scaled.select("grp", F.transform("z", lambda v: F.when(size > 0, v / size).otherwise(0.0)).alias("sign"), F.transform("z", lambda v: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), v))).alias("clip"))
    g = lambda c, i: F.get(c, F.lit(i))
    sums = [F.array(*(F.avg(g(c, i) * g(c, j)) for i, j in PAIRS)).alias(c) for c in ("sign", "clip")]
    shift = F.array(*(F.avg(g("clip", i)) for i in range(P))).alias("shift")
    moments = with_both.groupBy("grp").agg(*sums, shift).join(table, "grp")

    def run(frames):
        for pdf in frames:
            out = []
            for grp, sign, clip, shift, med, scale in zip(*(pdf[c] for c in ("grp", "sign", "clip", "shift", "med", "scale")), strict=True):
                scale, shift = np.asarray(scale) / UNIT, np.asarray(shift)
                ways = (np.eye(P), P * full(sign), (full(clip) - np.outer(shift, shift)))
                for k, way in enumerate(ways):
                    mu = np.asarray(med) / UNIT + (k == 2) * shift * scale
                    out.append((grp, k, list(mu), packed(np.linalg.inv(floored(way * np.outer(scale, scale))))))
            yield pd.DataFrame(out, columns=["grp", "start", "mu", "inv"])

    return moments.mapInPandas(run, "grp string, start int, mu array<double>, inv array<double>")


def full(triangle) -> np.ndarray:
    """A symmetric matrix from the values at PAIRS."""
    out = np.zeros((P, P))
    for v, (i, j) in zip(triangle, PAIRS, strict=True):
        out[i, j] = out[j, i] = v
    return out


def floored(cov: np.ndarray) -> np.ndarray:
    """With no variance below the square of its least scale."""
    return cov + np.diag(np.maximum(np.square(FLOORS) - np.diag(cov), 0))


def packed(inverse: np.ndarray) -> list[float]:
    """The upper triangle, the terms off the diagonal doubled, so that a distance is a sum over PAIRS."""
    return [float(inverse[i, j] * (1 + (i != j))) for i, j in PAIRS]


def distance() -> Column:
    off = [F.get("x", F.lit(i)) / UNIT - F.get("mu", F.lit(i)) for i in range(P)]
    return sum((F.get("inv", F.lit(k)) * off[i] * off[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def estimated(sums: DataFrame) -> DataFrame:
    """Estimates with their log determinants from n, s (sums) and ss (sums of products, by PAIRS) of each grp and start."""

    def run(frames):
        for pdf in frames:
            mus, invs, dets = [], [], []
            for n, s, ss in zip(pdf["n"], pdf["s"], pdf["ss"], strict=True):
                mu = np.asarray(s, float) / n
                cov = floored(CONSISTENT * (full(ss) / n - np.outer(mu, mu)) / UNIT**2)
                mus.append(list(mu / UNIT))
                invs.append(packed(np.linalg.inv(cov)))
                dets.append(float(np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame({"grp": pdf["grp"], "start": pdf["start"], "mu": mus, "inv": invs, "det": dets})

    return sums.mapInPandas(run, "grp string, start int, mu array<double>, inv array<double>, det double")


def step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """The next estimates, from the SUBSET of each group that is nearest under these (all of the last bin)."""
    bin_of = F.floor(F.log1p(F.greatest(distance(), F.lit(0.0))) * BINS)
    counts = salted(rows, now, ["grp"]).groupBy("grp", "start", bin_of.alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp", "start")
    running = counts.withColumn("cum", F.sum("c").over(w.orderBy("bin"))).withColumn("n", F.sum("c").over(w))
    edge = running.filter(F.col("cum") >= SUBSET * F.col("n")).groupBy("grp", "start").agg(F.min("bin").alias("edge"))
    inner = salted(rows, now.join(edge, ["grp", "start"]), ["grp"]).filter(bin_of <= F.col("edge"))
    x = [F.get("x", F.lit(i)).cast("long") for i in range(P)]
    sums = inner.groupBy("grp", "start").agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in PAIRS)).alias("ss"))
    return written(estimated(sums), "estimate")


def fit(rows: DataFrame) -> DataFrame:
    """grp, mu, inv and det, the log determinant, for each group of rows (grp, doc_id, x) that has LEAST rows."""
    enough = rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("grp")
    now = written(start(rows.join(written(enough, "enough"), "grp", "left_semi")), "estimate")
    for _ in range(FIRST):
        now = step(rows, now)
    order = F.struct("det", "start")
    best = written(now.groupBy("grp").agg(F.min_by(F.struct(*now.columns), order).alias("b")).select("b.*", F.lit(True).alias("fell")), "best")
    for _ in range(STEPS):
        after = step(rows, best.filter("fell").drop("fell")).select("grp", *(F.col(c).alias(f"{c}_after") for c in ("mu", "inv", "det")))
        fell = F.coalesce(F.col("det_after") < F.col("det") - FALL, F.lit(False))
        took = [F.when(fell, F.col(f"{c}_after")).otherwise(F.col(c)).alias(c) for c in ("mu", "inv", "det")]
        best = written(best.join(after, "grp", "left").select("grp", "start", *took, fell.alias("fell")), "best")
        if best.filter("fell").isEmpty():
            break
    return best.select("grp", "mu", "inv", "det")


def judged(docs: DataFrame) -> DataFrame:
    """`measured` with d2, the squared distance (null where there is no estimate), and kept."""
    rows = written(grouped(measured(docs)), "measured")
    model = fit(rows.filter("NOT base_failed").select("grp", "doc_id", "x"))
    out = salted(rows, model, ["grp"], "left").withColumn("d2", distance())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)).drop("mu", "inv", "det")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
