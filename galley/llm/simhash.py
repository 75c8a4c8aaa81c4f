r"""SimHash near-dedup with pivot distance tables.

1. Fingerprints: the majority of each bit over the 64-bit hashes of a text's word shingles; a
   fingerprint has one or more 64-bit parts, each from its own mix of the hashes.
2. Equal fingerprints are joined by a partial aggregation, so copies cost one row.
3. Distinct fingerprints that can be near meet in buckets. `exact_keys` is lossless for a radius of 3:
   of four 16-bit blocks one is equal, and of four 12-bit blocks of the other 48 bits one is equal, so
   16 keys of 28 bits suffice. Large buckets are keyed once more, by four quarters of the last 36 bits.
4. In a bucket each fingerprint has a table of its Hamming distances to PIVOTS, rows of the 64-bit
   Walsh-Hadamard code, which lie 32 bits apart. By the triangle inequality two fingerprints within r
   differ by at most r in every coordinate; pairs that differ by more are discarded, survivors are
   verified by their own Hamming distance. A breadth-first search that never looks back at what it has
   reached links a bucket's components without listing its pairs. A bucket of more than BLOCK
   fingerprints is dealt out as pairs of blocks, so that no task holds more than two blocks of it.
5. The links of all buckets are joined by distributed connected components.

`drop_near` fingerprints five-word shingles and takes the same links as proposals, but judges by the exact similarity of
the shingle sets. Fingerprints alone are too coarse for a similarity of 0.8: there 64 bits differ in ten places on
average, far beyond any radius that keys or pivots can tell from chance. So MinHash bands over the very shingles that
are judged propose what fingerprints miss, and all that meet in a band are compared (see `similar_links`).

Defined results: null and empty texts have fingerprint zero, which links like any other, and in `drop_near` are copies
of each other; texts of any length are read whole, one of fewer words than a shingle is one shingle; repeated rows
are copies; of equal choices the smallest doc_id (null last) stays, then the first row; an empty table gives an empty
result; other columns are ignored or, in `drop_near`, kept, whatever their names. Rows are numbered in a written table.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import discard, documents, numbered, shuffle_parts
from .common import written as stored
from .components import components

SEED = 42
#: Fingerprints of one bucket that one task compares with each other, or with as many others.
BLOCK = 4096
#: Reference fingerprints in a distance table.
PIVOTS = np.array([sum((((i & j).bit_count() & 1) << j) for j in range(64)) for i in range(1, 64, 4)], dtype=np.uint64)
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: MinHash bands and the least hashes in each. Two sets of similarity j share a band's key with j ** BAND_ROWS: of the
#: pairs at exactly 0.8 all but 5 in a million share one, whatever the difference looks like.
BANDS, BAND_ROWS = 40, 6
FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts of one bucket whose shingles one task compares with each other, or with as many others.
SET_BLOCK = 256
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def written(df: DataFrame, tag: str) -> DataFrame:
    return stored(df, tag, plain=True)


def shingle_hashes(text: str | None, size: int, once: bool = False) -> np.ndarray:
    """XXH64 of each shingle of size words, space-joined, A-Z lowered; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        return np.array([xxh64_intdigest(whole, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    got = map(xxh64_intdigest, map(whole.__getitem__, map(slice, starts, ends[size - 1 :].tolist())), repeat(SEED))
    hashes = np.fromiter(got, np.uint64, len(starts))
    return np.unique(hashes) if once else hashes


def mixed(h: np.ndarray, part: int) -> np.ndarray:
    """An independent 64-bit hash for each part after the first."""
    if part == 0:
        return h
    h = h + np.uint64((0x9E3779B97F4A7C15 * part) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, parts: int = 1) -> np.ndarray:
    """parts 64-bit fingerprints; a bit is 1 if set in over half the hashes."""
    ones, columns = np.zeros((8 * parts, 256), np.int64), np.arange(8 * parts) * 256
    for at in range(0, len(hashes), CHUNK):
        block = hashes[at : at + CHUNK]
        data = np.stack([mixed(block, p) for p in range(parts)], axis=1).view(np.uint8).reshape(len(block), -1)
        ones += np.bincount((data + columns).ravel(), minlength=ones.size).reshape(ones.shape)
    over = (2 * (ones.astype(np.float64) @ BITS) > len(hashes)).astype(np.uint8)
    return np.packbits(over.ravel(), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, parts: int = 1, once: bool = False) -> DataFrame:
    """row_id, doc_id, fp (array of parts longs: the unsigned fingerprints as signed)."""

    def run(batches):
        for b in batches:
            rows = [fingerprint(shingle_hashes(t.as_py(), shingle, once), parts) for t in b.column("text")]
            flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * parts), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), fp], ["row_id", "doc_id", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "row_id long, doc_id long, fp array<long>")


def masks() -> list[tuple[int, int, list[int]]]:
    """For each of the 16 keys the number of its first bit block and sub-block, and the masks of the four quarters of the
    36 bits that it leaves out."""
    out = []
    for i in range(4):
        rest = [b for b in range(64) if b // 16 != i]
        for j in range(4):
            left = rest[: 12 * j] + rest[12 * j + 12 :]
            out.append((i, j, [sum(1 << b for b in left[9 * q : 9 * q + 9]) for q in range(4)]))
    return out


def exact_keys(fp: np.ndarray) -> list[np.ndarray]:
    """16 bucket keys for each one-part fingerprint; any two within 3 bits share one at least."""
    x, out = fp[:, 0].view(np.uint64), []
    for i in range(4):
        block = (x >> np.uint64(16 * i)) & np.uint64(0xFFFF)
        low = x & np.uint64((1 << (16 * i)) - 1)
        rest = low | (x >> np.uint64(16 * i + 16) << np.uint64(16 * i)) if i < 3 else low
        for j in range(4):
            sub = (rest >> np.uint64(12 * j)) & np.uint64(0xFFF)
            out.append((np.uint64(4 * i + j) << np.uint64(28)) | (block << np.uint64(12)) | sub)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances over all parts; the arrays broadcast."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances to the pivots, (n, pivots); a pivot repeats its 64 bits over all parts."""
    return np.stack([distances(fp, p) for p in PIVOTS], axis=1)


def near(q: np.ndarray, qt: np.ndarray, fp: np.ndarray, table: np.ndarray, order: np.ndarray, radius: int) -> np.ndarray:
    """Which of fp[order], sorted by their first pivot distance, lie within radius of q: a slice of the first
    coordinate, then coordinate by coordinate, then the verified distance."""
    first = table[order, 0]
    found = order[np.searchsorted(first, qt[0] - radius) : np.searchsorted(first, qt[0] + radius, "right")]
    for k in range(1, len(qt)):
        if len(found) < 16:
            break
        found = found[np.abs(table[found, k] - qt[k]) <= radius]
    return found[distances(fp[found], q) <= radius]


def links(fp: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within radius, as positions. With two sides, links run between the sides;
    links of either side with itself come from that block's own task."""
    table, out = pivot_table(fp), []
    rest = np.argsort(table[:, 0], kind="stable")
    two = side.any()
    while len(rest):
        queue = [rest[0]]
        rest = rest[1:]
        while queue and len(rest):
            q = queue.pop()
            found = near(fp[q], table[q], fp, table, rest, radius)
            if two:
                found = found[side[found] != side[q]]
            if len(found):
                out += [(q, x) for x in found]
                queue += found.tolist()
                gone = np.zeros(len(fp), bool)
                gone[found] = True
                rest = rest[~gone[rest]]
    return out


def by_group(done):
    """For frames sorted by key and pair: done(group) of each group of two rows or more, without its Nones."""

    def run(frames):
        held: list[pd.DataFrame] = []

        def cut(pdf: pd.DataFrame, last: bool):
            same = ((pdf["key"].shift() == pdf["key"]) & (pdf["pair"].shift() == pdf["pair"])).to_numpy()
            at = np.flatnonzero(~same)
            ends = np.append(at[1:], len(pdf))
            full = at if last else at[:-1]
            ends = ends[: len(full)]
            for g in np.flatnonzero(ends - full > 1):
                yield done(pdf.iloc[full[g] : ends[g]])
            held[:] = [] if last else [pdf.iloc[at[-1] :]]

        for pdf in frames:
            if len(pdf):
                yield from (x for x in cut(pd.concat([*held, pdf], ignore_index=True), False) if x is not None)
        if held:
            yield from (x for x in cut(pd.concat(held, ignore_index=True), True) if x is not None)

    return run


def bucket_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) of node ids that connect what lies within radius, 3 bits at most. nodes: node long, fp array<long>,
    distinct fingerprints. Buckets of more than BLOCK are keyed again by quarters of the bits left, of which one is equal
    too; what is still larger is dealt out as pairs of blocks."""
    parts = shuffle_parts(nodes.sparkSession)

    def keyed(batches):
        for b in batches:
            fp = np.stack(b.column("fp").to_numpy(zero_copy_only=False)) if len(b) else np.zeros((0, 1), np.int64)
            for k in exact_keys(fp):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), b.column("node")], ["key", "node"])

    def done(group: pd.DataFrame):
        got = links(np.stack(group["fp"].to_numpy()).view(np.uint64), group["side"].to_numpy(), radius)
        ids = group["node"].to_numpy()
        return pd.DataFrame({"u": ids[[a for a, _ in got]], "v": ids[[b for _, b in got]]}) if got else None

    run = by_group(done)
    linked = lambda df: df.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", "node").mapInPandas(run, "u long, v long")
    whole = lambda df: df.filter(F.col("n") <= BLOCK).select("key", F.lit(0).alias("pair"), F.lit(0).alias("side"), "node", "fp")

    def met(rows: DataFrame) -> DataFrame:
        """rows (key, node) with n, the size of their bucket, and fp, which travels only with keys that are shared."""
        shared = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
        out = written(rows.join(shared, "key").join(nodes, "node"), "met")
        discard(rows, shared)
        return out

    first = met(written(nodes.mapInArrow(keyed, "key long, node long"), "keyed"))
    edges, wide = linked(whole(first)), first.filter(F.col("n") > BLOCK)
    if wide.isEmpty():
        return edges
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    table = F.array(*(signed(m) for _, _, quarters in masks() for m in quarters))
    quarter = wide.select("key", "node", F.col("fp")[0].alias("x"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    mask = F.get(table, (F.shiftright("key", 28) * 4 + F.col("q")).cast("int"))
    second = met(written(quarter.select(F.xxhash64("key", "q", F.col("x").bitwiseAND(mask)).alias("key"), "node"), "quarters"))
    edges, wide = edges.union(linked(whole(second))), second.filter(F.col("n") > BLOCK)
    if wide.isEmpty():
        return edges
    # Block b of m meets every block: (b, c) for c >= b as the left side, (a, b) for a < b as the right one.
    m = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), m).cast("int")
    dealt = wide.withColumn("m", m).withColumn("b", block).select("key", "node", "fp", "m", "b", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("c"))
    pair = F.least("b", "c") * F.col("m") + F.greatest("b", "c")
    return edges.union(linked(dealt.select("key", pair.alias("pair"), (F.col("b") > F.col("c")).cast("int").alias("side"), "node", "fp")))


def near_components(rows: DataFrame, edges_of) -> DataFrame:
    """rows (row_id, doc_id, fp) with component_id, the smallest doc_id reachable, and keep_row, that document's
    first row. rows must be a table; edges_of gives the edges of nodes (node, fp), a row_id for each fingerprint."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id"))
    nodes = written(rows.groupBy("fp").agg(first.alias("b")).select(F.col("b.row_id").alias("node"), F.col("b").alias("best"), "fp"), "nodes")
    member = components(edges_of(nodes.select("node", "fp")))
    linked = written(nodes.join(member, "node").select("node", "root", "best"), "linked")
    least = linked.groupBy("root").agg(F.min("best").alias("least"))
    better = written(linked.join(least, "root").select("node", "least"), "better")
    table = written(nodes.join(better, "node", "left").select("fp", F.coalesce("least", "best").alias("best")), "classes")
    out = rows.join(table.hint("merge"), "fp")
    return out.select("row_id", "doc_id", "fp", F.col("best.doc_id").alias("component_id"), F.col("best.row_id").alias("keep_row"))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each MinHash band of a set of hashes; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, (FACTORS[:, None] * hashes[None, at : at + 256]).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """row_id, doc_id, fp (two longs, a digest of the set of shingles), sim (its fingerprint) and keys of its bands, from
    row_id, doc_id, text."""

    def run(batches):
        for b in batches:
            sets = [shingle_hashes(t.as_py(), words, True) for t in b.column("text")]
            fp = pa.array([np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64) for s in sets], pa.list_(pa.int64()))
            sim = pa.array([fingerprint(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), fp, sim, keys], ["row_id", "doc_id", "fp", "sim", "keys"])

    return docs.mapInArrow(run, "row_id long, doc_id long, fp array<long>, sim array<long>, keys array<long>")


def shingle_sets(docs: DataFrame, of: DataFrame, words: int) -> DataFrame:
    """node and s, the distinct shingle hashes, of the rows of docs (row_id, text) that are in of (node)."""

    def run(batches):
        for b in batches:
            s = pa.array([shingle_hashes(t.as_py(), words, True).view(np.int64) for t in b.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), s], ["node", "s"])

    texts = docs.select(F.col("row_id").alias("node"), "text").join(of, "node", "left_semi")
    return texts.mapInArrow(run, "node long, s array<long>")


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges whose sets have this Jaccard similarity or more."""
    side = lambda e: sets.select(F.col("node").alias(e), F.col("s").alias(f"s{e}"))
    both = edges.join(side("u"), "u").join(side("v"), "v").withColumn("n", F.size(F.array_intersect("su", "sv")))
    return both.filter(F.col("n") >= F.lit(similarity) * (F.size("su") + F.size("sv") - F.col("n"))).select("u", "v")


def set_links(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is similar, as positions, where nodes of one root are connected already. With two
    sides, links run between the sides. Every pair is compared whose ends aren't connected by then."""
    size, out, two = np.array([len(s) for s in sets]), [], side.any()
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, at = np.repeat(np.arange(len(sets)), size), np.concatenate(([0], np.cumsum(size)))
    _, part = np.unique(root, return_inverse=True)
    mark, rest = np.zeros(codes.max() + 1, bool), np.ones(len(sets), bool)
    for p in np.argsort(np.bincount(part), kind="stable"):  # the largest last, which has nothing left to search for
        queue = [p] if rest[part == p].all() else []
        rest[part == p] = False
        while queue and rest.any():
            for q in np.flatnonzero(part == queue.pop()):
                may = np.flatnonzero(rest & (side != side[q])) if two else np.flatnonzero(rest)
                if not len(may):
                    continue
                own = codes[at[q] : at[q + 1]]
                mark[own] = True
                n = np.bincount(owner[mark[codes]], minlength=len(sets))[may]
                mark[own] = False
                found = may[n >= similarity * (size[q] + size[may] - n)]
                reached, first = np.unique(part[found], return_index=True)
                out += [(q, x) for x in found[first]]
                queue += reached.tolist()
                rest[np.isin(part, reached)] = False
    return out


def similar_links(nodes: DataFrame, rows: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """Edges (u, v) that connect what is similar among the nodes whose fingerprints link or that share a band's key.

    First the links of fingerprints are judged, and each bucket's least node is compared with the others. What these
    links leave apart in a bucket is compared in full, by blocks: all nodes with those outside the bucket's largest
    component. Of buckets with the same nodes one is enough. So no pair that shares a key is left out unless its ends
    are connected.
    """
    keys = written(rows.join(nodes.select(F.col("node").alias("row_id")), "row_id", "left_semi").select(F.col("row_id").alias("node"), "sim", "keys"), "keys")
    prints = written(keys.groupBy("sim").agg(F.min("node").alias("node")).select("node", F.col("sim").alias("fp")), "prints")
    alike = keys.select("node", "sim").join(prints.select(F.col("node").alias("u"), F.col("fp").alias("sim")).hint("merge"), "sim").filter("node <> u").select("u", F.col("node").alias("v"))
    proposed = written(bucket_links(prints).union(alike), "proposed")
    each = keys.select("node", F.explode("keys").alias("key"))
    shared = written(each.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1").drop("n"), "shared")
    met = written(each.join(shared, "key"), "met")
    discard(keys, prints, shared)
    ends = met.select("node").union(proposed.select("u")).union(proposed.select("v")).distinct()
    sets = written(shingle_sets(docs, ends, words), "sets")
    star = met.filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    pairs = proposed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    first = written(verified(star.union(pairs).distinct(), sets, similarity), "first")
    state = met.filter("node <> hub").join(components(first), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    state = written(state, "state")
    discard(met)
    mixed_ids = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    roots = state.groupBy("key", "root").agg(F.count("*").alias("n"), *mixed_ids)
    top = F.max(F.struct("n", "root")).alias("top")
    buckets = roots.groupBy("key").agg(top, F.sum("n").alias("n"), F.count("*").alias("roots"), *(F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)))
    open_ones = written(buckets.filter("roots > 1").groupBy("x0", "x1", "n", "top").agg(F.min("key").alias("key")).select("key", "n", "top"), "open")
    if open_ones.isEmpty():
        return first
    # Blocks 0 to m - 1 hold the largest component, the others the rest; only pairs with one of the rest are made.
    blocks = lambda n: F.ceil(n / SET_BLOCK).cast("int")
    wide, main = F.col("n") > SET_BLOCK, F.col("root") == F.col("top.root")
    left = state.join(open_ones, "key").withColumns({"m": F.when(wide, blocks(F.col("top.n"))).otherwise(0), "k": F.when(wide, blocks(F.col("n") - F.col("top.n"))).otherwise(1)})
    of = F.xxhash64("node")
    left = left.withColumn("b", F.when(~wide, 0).when(main, F.pmod(of, "m")).otherwise(F.col("m") + F.pmod(of, "k")).cast("int"))
    end = F.col("m") + F.col("k") - 1
    left = left.withColumn("c", F.explode(F.sequence(F.when(wide & main, F.col("m")).otherwise(0), end)))
    pair = F.least("b", "c") * (end + 1) + F.greatest("b", "c")
    dealt = written(left.select("key", pair.alias("pair"), (F.col("b") > F.col("c")).cast("int").alias("side"), "node", "root"), "dealt")

    def done(group: pd.DataFrame):
        got = set_links([s.view(np.uint64) for s in group["s"]], group["root"].to_numpy(), group["side"].to_numpy(), similarity)
        ids = group["node"].to_numpy()
        return pd.DataFrame({"u": ids[[a for a, _ in got]], "v": ids[[b for _, b in got]]}) if got else None

    ready = dealt.join(sets, "node").repartition(shuffle_parts(docs.sparkSession), "key", "pair").sortWithinPartitions("key", "pair", "node")
    return first.union(ready.mapInPandas(by_group(done), "u long, v long"))


def drop_near(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """docs with one document of each group of near copies: similarity or more over shingles of words words.

    Documents of equal sets of shingles are one node. Nodes whose fingerprints link or that share a MinHash band's key are
    compared exactly.
    """
    table, row = numbered(docs)
    texts = table.select(F.col(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(signatures(texts, words), "signatures")
    found = near_components(rows.select("row_id", "doc_id", "fp"), lambda nodes: similar_links(nodes, rows, texts, similarity, words))
    kept = found.filter("row_id = keep_row").select(F.col("row_id").alias(row))
    return table.join(kept, row, "left_semi").drop(row)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(fingerprints(documents(spark, sf_dir)), "fingerprints")
    out = near_components(rows, bucket_links)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
