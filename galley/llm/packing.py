"""Best-fit packing by minimum bin slack.

Documents become token ids; each is one piece, or pieces of CAPACITY tokens, the first with what is left over, if it
is longer. Only the number of pieces of each length matters for packing: a histogram of at most CAPACITY numbers, whatever
the corpus. For each bin the longest piece left is laid down and a subset-sum dynamic program over the
lengths left, held as one bitset, finds the fullest feasible combination for the rest. The combination is
removed as often as the histogram allows, so the number of programs depends on the number of lengths, not
of bins.

Pieces then get their places without moving texts: each task numbers its pieces of a length as it makes
them, the counts by task and length are summed up, and the number of a piece among all of its length
leads to its bin. The result of tokenising is written before that, so numbers stay when tasks are lost.

Defined results: null counts as empty: one piece of the end id alone. Repeated rows are documents of their
own; pieces of equal length may take each other's places from run to run, never their own cuts. Texts of any length
are read whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import documents, written

CAPACITY = 2048
END_ID = 0


class IdEncoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian 32-bit integers.

    The file is byte-level with ids in the order of its merges, so tiktoken finds the same ids in a third of
    the time (tests compare them). Texts with characters from SAFE on, where Unicode versions differ in
    what a letter is, and texts with a special string go to the tokenizers library.
    """

    SAFE = 0x370
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in specials}
        order = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("the ids of the vocabulary are not in the order of its merges")
        self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = regex.compile("|".join(map(regex.escape, specials)))
        self.unsafe = regex.compile(f"[\\U{self.SAFE:08x}-\\U0010ffff]")

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.unsafe.search(text) or self.special.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """The encoder of a file, made once in a worker."""
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and for placing: part (the task) and number (among the task's
    pieces of that length). With with_ids also the ids. Write it before placing."""

    def run(frames):
        model, counts = encoder(path), [0] * (capacity + 1)
        part = TaskContext.get().partitionId()
        for pdf in frames:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = memoryview(model.encode(text) + END_ID.to_bytes(4, "little"))
                first = (len(data) // 4 - 1) % capacity + 1
                for k, end in enumerate(range(4 * first, len(data) + 1, 4 * capacity)):
                    at = 4 * first + 4 * capacity * (k - 1) if k else 0
                    ids = data[at:end]
                    n = len(ids) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(ids), part, counts[n], *([bytes(ids)] if with_ids else [])))
                    counts[n] += 1
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def fullest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The combination of at most room tokens with the largest sum, as (length, how many); lengths has
    (length, how many there are), longest first. Bit s of the bitset: some combination has the sum s."""
    mask, bits = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length, count in lengths:
        if length > room:
            continue
        left, lot = min(count, room // length), 1
        while left:  # lots of 1, 2, 4, ... of a length make every number of it
            lot = min(lot, left)
            steps.append((length, lot, bits))
            bits |= (bits << (length * lot)) & mask
            left, lot = left - lot, lot * 2
        if bits >> room & 1:
            break
    at, taken = bits.bit_length() - 1, {}
    for length, lot, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + lot
            at -= length * lot
    return sorted(taken.items(), reverse=True)


@dataclass(frozen=True)
class Slot:
    """The pieces of a length numbered from first: many in each of bins bins from bin on, at offset."""

    first: int
    bin: int
    bins: int
    many: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[Slot]]:
    """Slots of each length, by first. The histogram gives the number of pieces by length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    order, used = sorted(left, reverse=True), dict.fromkeys(left, 0)
    slots: dict[int, list[Slot]] = {n: [] for n in left}
    at = 0
    while order:
        top = order[0]
        left[top] -= 1
        rest = fullest([(n, left[n]) for n in order if left[n]], capacity - top)
        left[top] += 1
        take = dict(rest)
        take[top] = take.get(top, 0) + 1
        bins, offset = min(left[n] // k for n, k in take.items()), 0
        for n, k in sorted(take.items(), reverse=True):
            slots[n].append(Slot(used[n], at, bins, k, offset))
            used[n] += bins * k
            left[n] -= bins * k
            offset += n * k
        at += bins
        order = [n for n in order if left[n]]
    return slots


def place(slots: dict[int, list[Slot]], length: int, number: int) -> tuple[int, int]:
    """sequence_id and offset of a piece by its number among all of its length."""
    of = slots[length]
    s = of[bisect.bisect_right(of, number, key=lambda x: x.first) - 1]
    row, k = divmod(number - s.first, s.many)
    return s.bin + row, s.offset + k * length


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of a written `pieces` with sequence_id and offset instead of part and number."""
    by_task = written(made.groupBy("length", "part").agg(F.count("*").alias("n")), "by_task")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = made.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    keep = [f for f in made.schema if f.name not in ("part", "number")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", sequence_id long, offset long"

    def run(frames):
        for pdf in frames:
            got = [place(slots.value, n, k) for n, k in zip(pdf["length"], pdf["number"], strict=True)]
            out = pdf[[f.name for f in keep]]
            yield out.assign(sequence_id=[x[0] for x in got], offset=[x[1] for x in got])

    # Counts by task and length grow with the number of tasks, so they are not broadcast.
    numbered = made.join(first.hint("merge"), ["length", "part"]).withColumn("number", F.col("number") + F.col("before"))
    return numbered.select(*(f.name for f in keep), "number").mapInPandas(run, schema)


def sequences(packed: DataFrame, path_ids: str = "ids") -> DataFrame:
    """sequence_id and its ids in order; a sequence has CAPACITY ids at most."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", path_ids))).alias("x"))
    return rows.select("sequence_id", F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p[path_ids])).alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, path, capacity), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
