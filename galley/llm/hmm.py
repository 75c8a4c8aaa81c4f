"""Language-model scoring with a hidden Markov model.

A token is a word or the end of a text. Each token has a class that the word alone decides: the end, one
of the TOP most frequent words, or one of SUFFIXES classes of word endings. Latent states emit classes,
and a class emits its words by smoothed counts, so the model is a distribution over whole token sequences:
    P(text) = P_hmm(classes) * product of P(word | class).

Counting: tasks count words and Spark adds the counts up. Training: Baum-Welch; each task adds up the
expected transitions and emissions of its rows (forward-backward over whole training texts), Spark adds up the
tasks' numbers, and the new model goes to the next round. Of a long text the backward pass holds SEGMENT steps
at a time and computes their forward values again from the segment's start. Scoring: the scaled forward recursion over
whole texts, in lockstep for many texts.

The counts of the at most HEAD most frequent words of at most HEAD_BYTES bytes go to every task; other words, which grow
with the corpus, meet their counts in a join. Only starting values come from a sample: the SEEDS different texts whose
hashes are least, so they do not depend on how the table is laid out.

Defined results: null and empty texts are one end token; without training texts the base gives every token
probability 1 and the score is that of a uniform model; texts of any length are learned from and scored whole; rows
repeat as they come; an empty table gives an empty result; columns other than doc_id, text and held_out are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, written

STATES, TOP, SUFFIXES, ROUNDS = 8, 1024, 1024, 6
CLASSES = 1 + TOP + SUFFIXES
HEAD, HEAD_BYTES, FLUSH, SEEDS = 1 << 17, 64, 300_000, 256
PSEUDO, PRIOR = 0.1, 50.0
#: Cells of a padded block of texts in the recursions.
CELLS = 1 << 20
#: Time steps whose forward values the backward pass holds at once.
SEGMENT = 2048
END = b""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def counted(train: DataFrame) -> DataFrame:
    """word, c of every token of the training texts; the end is the empty word."""

    def run(batches):
        count: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "c"])
            count.clear()
            return rows

        for b in batches:
            for t in b.column("text"):
                count.update(words_of(t.as_py()))
                count[END] += 1
                if len(count) >= FLUSH:
                    yield out()
        yield out()

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Counts of frequent words, classes, and what a class's words are divided by. Its size is bounded by HEAD words of
    HEAD_BYTES bytes."""

    def __init__(self, vocab: DataFrame):
        scale = F.floor(F.log2("c") * 8).cast("int")
        n = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.tokens, self.types = int(n[0]), int(n[1])
        short = vocab.filter(F.length("word") <= HEAD_BYTES)
        sizes = sorted(((r[0], r[1]) for r in short.groupBy(scale).count().collect()), reverse=True)
        self.least, seen = 1 << 20, 0
        for at, many in sizes:
            seen += many
            if seen > HEAD:
                break
            self.least = at
        head = short.filter(scale >= self.least).collect()
        rows = sorted(((r["c"], bytes(r["word"])) for r in head if r["word"] != END), key=lambda x: (-x[0], x[1]))
        self.end_count = int(vocab.filter(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
        rows = [(self.end_count, END), *rows]
        self.index = {w: i for i, (_, w) in enumerate(rows)}
        counts = np.array([c for c, _ in rows], np.float64)
        self.log_count = np.log10(counts + PSEUDO)
        self.known = counts > 0
        self.cls = np.array([i if i <= TOP else self.suffix(w) for i, (_, w) in enumerate(rows)], np.int16)
        by = F.crc32(F.substring("word", -3, 3)) % SUFFIXES
        size, kinds = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
        for r in vocab.filter(F.length("word") > 0).groupBy(by.alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            size[r["s"]], kinds[r["s"]] = r["c"], r["v"]
        for c, w in rows[1 : TOP + 1]:
            s = zlib.crc32(w[-3:]) % SUFFIXES
            size[s] -= c
            kinds[s] -= 1
        #: log10 of the divisor of each class's word counts; the end and the TOP words are alone in theirs.
        self.log_divisor = np.zeros(CLASSES)
        self.log_divisor[TOP + 1 :] = np.log10(size + PSEUDO * (kinds + 1))
        each = np.zeros(CLASSES)
        each[: min(len(rows), TOP + 1)] = counts[: TOP + 1]
        each[TOP + 1 :] = size
        self.prior = (each + PSEUDO) / (each + PSEUDO).sum()
        self._suffix: dict[bytes, int] = {}

    @staticmethod
    def suffix(word: bytes) -> int:
        return 1 + TOP + zlib.crc32(word[-3:]) % SUFFIXES

    def encode(self, text: str | None):
        """Classes of the tokens, sums of log10(count + PSEUDO) over frequent tokens and of log10 P(word | class) as
        far as it is known here, the number of known ones among them, and the other words with their numbers."""
        words = [*words_of(text), END]
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(at < 0)
        z = self.cls[at]
        others: list[bytes] = [words[i] for i in rare.tolist()]
        if others:
            z[rare] = np.fromiter(map(self.suffix, others), np.int16, len(others))
        here = at[at >= 0]
        log_count = self.log_count[here]
        inner = float(log_count[here > TOP].sum()) - float(self.log_divisor[z].sum())
        return z, float(log_count.sum()), inner, int(self.known[here].sum()), Counter(others)


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row of numbers for each row of docs (doc_id, held_out, text), with its rare words. Write it before use:
    uid numbers the rows of a task."""
    seen = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = ["uid", "doc_id", "held_out", "n_tokens", "z", "base_sum", "inner_sum", "known", "rare", "rare_n"]

    def run(batches):
        from pyspark import TaskContext

        lex, uid = seen.value, TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in (whole.slice(s, 1024) for s in range(0, len(whole), 1024)):
                got = [lex.encode(t.as_py()) for t in b.column("text")]
                ids = np.arange(uid, uid + len(got))
                uid += len(got)
                cols = [
                    pa.array(ids, pa.int64()),
                    b.column("doc_id"),
                    b.column("held_out"),
                    pa.array([len(x[0]) for x in got], pa.int64()),
                    pa.array([x[0].tobytes() for x in got], pa.binary()),
                    *(pa.array([x[k] for x in got], pa.float64()) for k in (1, 2)),
                    pa.array([x[3] for x in got], pa.int64()),
                    pa.array([list(x[4]) for x in got], pa.list_(pa.binary())),
                    pa.array([list(x[4].values()) for x in got], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, z binary, base_sum double, inner_sum double, known long, rare array<binary>, rare_n array<int>"
    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, schema)


class Hmm:
    """start, move (states x states), emit (states x classes)."""

    #: Of a flat array of expected counts: where start, move, emit and the log10 likelihood begin.
    PARTS = np.cumsum([0, STATES, STATES**2, STATES * CLASSES])

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = (np.asarray(x, np.float32) for x in (start, move, emit))

    @staticmethod
    def from_seeds(shares: list[np.ndarray], prior: np.ndarray) -> Hmm:
        """Starting values from texts' counts by class: spherical k-means, with the farthest texts as first centres."""
        share = np.stack(shares or [prior]).astype(np.float64)
        x = np.sqrt(share / share.sum(axis=1, keepdims=True))
        centres = [x[int(np.argmax(share.sum(axis=1)))]]
        while len(centres) < STATES:
            centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
        c = np.array(centres)
        for _ in range(8):
            near = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(STATES)])
            c /= np.linalg.norm(c, axis=1, keepdims=True)
        emit = np.stack([share[near == k].sum(axis=0) + PRIOR * prior * (1 + k / STATES) for k in range(STATES)])
        return Hmm(np.full(STATES, 1 / STATES), 0.9 * np.eye(STATES) + 0.1 / STATES, emit / emit.sum(axis=1, keepdims=True))

    @staticmethod
    def from_counts(v: np.ndarray, prior: np.ndarray) -> Hmm:
        start, move, emit = (v[a:b] for a, b in zip(Hmm.PARTS, Hmm.PARTS[1:], strict=False))
        start, move = start + 0.1, move.reshape(STATES, STATES) + 0.1
        emit = emit.reshape(STATES, CLASSES) + PRIOR * prior
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def steps(self, block: np.ndarray, active: np.ndarray, begin: int, end: int, alpha: np.ndarray | None):
        """The scaled alphas of the time steps from begin to end, and what they were divided by; alpha: of the step before."""
        by_class = np.ascontiguousarray(self.emit.T)
        for t in range(begin, end):
            m = active[t]
            alpha = (self.start if t == 0 else alpha[:m] @ self.move) * by_class[block[t, :m]]
            s = alpha.sum(axis=1)
            alpha /= s[:, None]
            yield alpha, s

    def forward(self, block: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 likelihoods of the columns of block (time x texts, longest first)."""
        active = np.searchsorted(-lengths, -np.arange(len(block)), "left")
        logs = np.zeros(len(lengths))
        for _, s in self.steps(block, active, 0, len(block), None):
            logs[: len(s)] += np.log10(s)
        return logs

    def expected(self, block: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts over the columns of block, and their log10 likelihood, flat as in PARTS."""
        active = np.searchsorted(-lengths, -np.arange(len(block)), "left")
        by_class = np.ascontiguousarray(self.emit.T)
        begins, before = range(0, len(block), SEGMENT), [None]
        for a, b in itertools.pairwise(begins):  # the alphas at the ends of segments
            for alpha, _ in self.steps(block, active, a, b, before[-1]):
                pass
            before.append(alpha)
        move, emit, log = np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES)), 0.0
        beta, scale = None, None  # of the time step after
        for a, alpha in zip(reversed(begins), reversed(before), strict=True):
            b = min(a + SEGMENT, len(block))
            alphas, scales = zip(*self.steps(block, active, a, b, alpha), strict=True)
            log += sum(float(np.log10(s).sum()) for s in scales)
            gammas = []
            for t in range(b - 1, a - 1, -1):
                if beta is None:
                    beta = np.ones((active[t], STATES), np.float32)
                else:
                    m, more = active[t + 1], active[t] - active[t + 1]
                    ahead = by_class[block[t + 1, :m]] * beta / scale[:, None]
                    move += alphas[t - a][:m].T @ ahead
                    beta = ahead @ self.move.T
                    if more:
                        beta = np.concatenate([beta, np.ones((more, STATES), np.float32)])
                scale = scales[t - a]
                gammas.append(alphas[t - a] * beta)
            z = np.concatenate([block[t, : active[t]] for t in range(b - 1, a - 1, -1)])
            gamma = np.concatenate(gammas)
            emit += np.stack([np.bincount(z, gamma[:, k], CLASSES) for k in range(STATES)])
        return np.concatenate([gammas[-1].sum(axis=0), (move * self.move).ravel(), emit.ravel(), [log]])


def blocks(seqs: list[np.ndarray]):
    """Positions, and padded blocks time x sequences of about CELLS cells, longest sequences first."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        longest = len(seqs[order[at]])
        group = order[at : at + max(1, min(2048, CELLS // longest))]
        block = np.zeros((longest, len(group)), np.int16)
        for j, i in enumerate(group):
            block[: len(seqs[i]), j] = seqs[i]
        yield group, block, np.array([len(seqs[i]) for i in group])
        at += len(group)


def classes_in(batch, column: str = "z") -> list[np.ndarray]:
    return [np.frombuffer(z.as_py(), np.int16) for z in batch.column(column)]


def baum_welch(rows: DataFrame, model: Hmm, prior: np.ndarray) -> tuple[Hmm, float]:
    """One round over the training rows (z): the next model, and the log10 likelihood under this one."""
    seen = rows.sparkSession.sparkContext.broadcast(model)
    size = int(Hmm.PARTS[-1]) + 1

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for _, block, lengths in blocks(classes_in(b)):
                total += seen.value.expected(block, lengths)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "v"])

    got = rows.select("z").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(size)
    v[[r["i"] for r in got]] = [r["v"] for r in got]
    return Hmm.from_counts(v, prior), float(v[-1])


def seeds(train: DataFrame) -> list[np.ndarray]:
    """Counts by class of the SEEDS different texts whose hashes are least; copies count once."""
    hashed = train.select(F.xxhash64("z").alias("h"), "z")
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SEEDS).collect()]

    def run(batches):
        for b in batches:
            rows = [np.bincount(z, minlength=CLASSES) for z in classes_in(b)]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(rows, pa.list_(pa.int64()))], ["h", "share"])

    chosen = hashed.filter(F.col("h").isin(least)).groupBy("h").agg(F.min("z").alias("z"))
    return [np.array(r["share"]) for r in sorted(chosen.mapInArrow(run, "h long, share array<long>").collect(), key=lambda r: r["h"])]


def trained(rows: DataFrame, lexicon: Lexicon) -> Hmm:
    train = rows.filter("NOT held_out")
    model = Hmm.from_seeds(seeds(train), lexicon.prior)
    for _ in range(ROUNDS):
        model, _ = baum_welch(train, model, lexicon.prior)
    return model


def likelihoods(rows: DataFrame, model: Hmm) -> DataFrame:
    """rows without z and rare, with hmm, the log10 likelihood of the classes."""
    seen = rows.sparkSession.sparkContext.broadcast(model)
    keep = ["uid", "doc_id", "held_out", "n_tokens", "base_sum", "inner_sum", "known"]

    def run(batches):
        for b in batches:
            out = np.zeros(len(b))
            for group, block, lengths in blocks(classes_in(b)):
                out[group] = seen.value.forward(block, lengths)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out)], [*keep, "hmm"])

    return rows.select(*keep, "z").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, base_sum double, inner_sum double, known long, hmm double")


def scored(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, held_out. Learns from rows that are not held out and scores every row."""
    vocab = written(counted(docs.filter("NOT held_out")), "vocabulary")
    lexicon = Lexicon(vocab)
    rows = written(encoded(docs, lexicon), "encoded")
    model = trained(rows, lexicon)
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    counts = vocab.filter((F.floor(F.log2("c") * 8) < lexicon.least) | (F.length("word") > HEAD_BYTES))
    met = rare.join(counts.hint("merge"), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(PSEUDO))
    sums = met.groupBy("uid").agg(F.sum(F.col("n") * log).alias("rare_sum"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    out = likelihoods(rows, model).join(sums, "uid", "left")
    rest = F.coalesce("rare_sum", F.lit(0.0))
    divisor = math.log10(lexicon.tokens + PSEUDO * (lexicon.types + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") + rest - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        (F.col("hmm") + F.col("inner_sum") + rest).alias("score"),
    )


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs.select("doc_id", "text", (crc_mod("doc_id", 10) == 0).alias("held_out")))
