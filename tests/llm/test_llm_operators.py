"""The operators' own interfaces: models, indexes, masks, parts that queries do not show."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from galley.llm import bpe, common, components, exact_dedup, hmm, language, line_dedup, packing, pii, quality, registry, simhash, url_filter
from galley.llm.common import written


def test_forward_is_exact():
    """Against the sum over all state paths."""
    rng = np.random.default_rng(1)
    rows = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    model = hmm.Hmm(rows(hmm.STATES), rows(hmm.STATES, hmm.STATES), rows(hmm.STATES, hmm.CLASSES))
    seqs = [np.array(z, np.int16) for z in ([3, 5, 0], [7], [1, 2])]
    for group, block, lengths in hmm.blocks(seqs):
        got = model.forward(block, lengths)
        for i, log in zip(group, got, strict=True):
            z, total = seqs[i], 0.0
            for path in itertools.product(range(hmm.STATES), repeat=len(z)):
                p = model.start[path[0]] * model.emit[path[0], z[0]]
                for t in range(1, len(z)):
                    p *= model.move[path[t - 1], path[t]] * model.emit[path[t], z[t]]
                total += float(p)
            assert abs(log - np.log10(total)) < 1e-4


@pytest.mark.parametrize("segment", [hmm.SEGMENT, 2, 1])
def test_expected_counts(monkeypatch, segment):
    """Against the sum over all state paths, whatever the segments."""
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng = np.random.default_rng(2)
    rows = lambda *s: (x := rng.random(s) + 0.1) / x.sum(axis=-1, keepdims=True)
    k = hmm.STATES
    model = hmm.Hmm(rows(k), rows(k, k), rows(k, hmm.CLASSES))
    seqs = [np.array(z, np.int16) for z in ([3, 5, 7, 3, 0], [9, 0], [0], [4, 4, 0])]
    got = sum(model.expected(block, lengths) for _, block, lengths in hmm.blocks(seqs))
    want, log = np.zeros(len(got)), 0.0
    for z in seqs:
        mine, total = np.zeros(len(got)), 0.0
        for path in itertools.product(range(k), repeat=len(z)):
            p = float(model.start[path[0]] * model.emit[path[0], z[0]])
            for t in range(1, len(z)):
                p *= float(model.move[path[t - 1], path[t]] * model.emit[path[t], z[t]])
            total += p
            mine[path[0]] += p
            for t in range(len(z)):
                mine[k + k * k + path[t] * hmm.CLASSES + z[t]] += p
                if t:
                    mine[k + path[t - 1] * k + path[t]] += p
        want, log = want + mine / total, log + np.log10(total)
    want[-1] = log
    assert np.allclose(got, want, atol=1e-4)


def test_training_does_not_lose_likelihood(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in (rng.zipf(1.5, 6000 if i == 0 else 80) % 300) + 300 * (i % 3)) for i in range(60)]
    d = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    lexicon = hmm.Lexicon(written(hmm.counted(d), "vocab"))
    rows = written(hmm.encoded(d, lexicon), "rows")
    model, logs = hmm.Hmm.from_seeds(hmm.seeds(rows), lexicon.prior), []
    for _ in range(5):
        model, log = hmm.baum_welch(rows, model, lexicon.prior)
        logs.append(log)
    assert logs == sorted(logs) and logs[-1] > logs[0] + 100


def test_scores_do_not_depend_on_layout(spark, tmp_path):
    """The same rows in one file and in seven; words of any length, some beyond what the head takes."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" " + "long" * 40))).otherwise(F.col("text")).alias("text"))
    got = []
    for n in (1, 7):
        d.repartition(n).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got.append({r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in hmm.op2_hmm(spark, f"{tmp_path}/{n}").collect()})
    assert got[0].keys() == got[1].keys() and len(got[0]) == d.count()
    for k, a in got[0].items():
        assert a == pytest.approx(got[1][k], rel=1e-4)


def test_end_is_counted_outside_the_head(spark, monkeypatch):
    """More words than the head holds are as frequent as the end."""
    monkeypatch.setattr(hmm, "HEAD", 4)
    d = spark.createDataFrame([(" ".join(f"w{i}" for i in range(50)),)], "text string")
    lexicon = hmm.Lexicon(written(hmm.counted(d), "vocab"))
    assert lexicon.end_count == 1 and lexicon.known[lexicon.index[hmm.END]] and len(lexicon.index) == 1
    assert lexicon.encode("w1")[3] == 1


def test_index_over_batches(spark):
    first = written(spark.createDataFrame([(1, "a b"), (2, "ab  "), (3, "c")], "doc_id long, text string"), "t")
    second = written(spark.createDataFrame([(4, "c"), (5, "d"), (6, "d"), (7, None), (8, " ")], "doc_id long, text string"), "t")
    index = exact_dedup.DigestIndex(spark, buckets=4)
    got = [{r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(d, index).collect()} for d in (first, second)]
    assert got[0] == {1: (2, False), 2: (2, True), 3: (3, True)}
    assert got[1] == {4: (3, False), 5: (5, True), 6: (5, False), 7: (8, False), 8: (8, True)}
    assert index.read().count() == 4
    again = exact_dedup.drop_copies(written(first, "t"))
    assert sorted(r["doc_id"] for r in again.collect()) == [2, 3]


def test_repeated_rows_keep_one(spark):
    d = written(spark.createDataFrame([(1, "a", "x")] * 3, "doc_id long, text string, digest string"), "t")
    assert [tuple(r) for r in exact_dedup.drop_copies(d).collect()] == [(1, "a", "x")]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_near_pairs_are_all_linked(spark, monkeypatch, block):
    """A dense ball and strangers; small blocks deal one bucket out as pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    ball = {0x1234567890ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(120)}
    fps = np.array(sorted(ball | {int(x) for x in rng.integers(0, 2**63, 200)}), np.uint64)
    nodes = written(spark.createDataFrame([(i, [int(x)]) for i, x in enumerate(fps.view(np.int64))], "node long, fp array<long>"), "n")
    got = {r["node"]: r["root"] for r in components.components(simhash.bucket_links(nodes)).collect()}
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            up[max(top(i), top(j))] = min(top(i), top(j))
    assert [got.get(i, i) for i in range(len(fps))] == [top(i) for i in range(len(fps))]


def test_keys_are_lossless():
    """Any two fingerprints within 3 bits share a key and, of it, a quarter."""
    rng = np.random.default_rng(14)
    for _ in range(300):
        a = int(rng.integers(0, 2**63)) * 2 + 1
        b = a ^ sum(1 << int(x) for x in rng.choice(64, 3, replace=False))
        keys = [simhash.exact_keys(np.array([[x]], np.uint64)) for x in (a, b)]
        same = [k for k in range(16) if keys[0][k][0] == keys[1][k][0]]
        assert same and all(any((a ^ b) & m == 0 for m in simhash.masks()[k][2]) for k in same)
        assert all(sum(m.bit_count() for m in q) == 36 for _, _, q in simhash.masks())


def test_pivots():
    d = np.bitwise_count(simhash.PIVOTS[:, None] ^ simhash.PIVOTS)
    assert set(d[~np.eye(len(d), dtype=bool)].tolist()) == {32}


def test_near_copies_stage(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = {}
    for g in range(12):
        base = [word() for _ in range(300)]
        texts[g * 10] = " ".join(base)
        for k in range(1, 4):
            copy = list(base)
            copy[k * 60] = word()
            texts[g * 10 + k] = " ".join(copy)
        far = list(base)
        for i in range(0, 300, 10):
            far[i] = word()
        texts[g * 10 + 9] = " ".join(far)
    d = written(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("fp", F.lit(1)), "t")
    got = simhash.drop_near(d)
    assert got.columns == d.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i in texts if i % 10 in (0, 9))


def similar_groups(texts, words=5, similarity=0.8):
    """The ids that stay, by brute force over all pairs."""
    sets = {i: {tuple(t.split()[k : k + words]) for k in range(len(t.split()) - words + 1)} for i, t in texts.items()}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return sorted(i for i in texts if top(i) == i)


def test_block_edits_are_near(spark):
    """A passage replaced, put in or appended: just at 0.8 over five-word shingles, against brute force."""
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    texts = {}
    for g in range(60):
        base = words(404)  # 400 shingles, of which the replacement leaves 356, the insertion 396 of 495
        copy = [base[:150] + words(40) + base[190:], base[:150] + words(91) + base[150:], base + words(100)][g % 3]
        texts |= {2 * g: " ".join(base), 2 * g + 1: " ".join(copy)}
    d = written(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "t")
    got = sorted(r["doc_id"] for r in simhash.drop_near(d).collect())
    assert len(got) == 60 and got == similar_groups(texts)


@pytest.mark.parametrize("block", [simhash.SET_BLOCK, 4])
def test_families_joined_by_one_pair(spark, monkeypatch, block):
    """Families of close copies, joined by some pairs at 0.8 or more and not by others, against brute force."""
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    rng = np.random.default_rng(10)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    texts = {}
    for g in range(8):
        base = words(404)
        for f, change in enumerate((0, 38)):  # 7 copies each, every one with 1 word of its own or more
            for k in range(7):
                copy = base[:200] + words(change) + base[200 + change :] if k == 0 else list(family)
                if k == 0:
                    family = list(copy)
                for at in (300 + 8 * k,) if k in (0, 3) else (300 + 8 * k, 360 + 3 * k):
                    copy[at] = words(1)[0]
                texts[100 * g + 10 * f + k] = " ".join(copy)
    d = written(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "t")
    got = sorted(r["doc_id"] for r in simhash.drop_near(d).collect())
    assert got == similar_groups(texts)


def test_set_links():
    """Three parts in a bucket: the middle one is similar to one node of each of the others only."""
    s = lambda *r: np.concatenate([np.arange(a, b, dtype=np.uint64) for a, b in r])
    sets = [s((0, 100)), s((0, 110)), s((10, 115)), s((500, 600)), s((18, 122))]
    root, one = np.array([0, 0, 2, 3, 4]), np.zeros(5, int)
    assert {tuple(sorted(map(int, x))) for x in simhash.set_links(sets, root, one, 0.8)} == {(1, 2), (2, 4)}
    assert {tuple(sorted(map(int, x))) for x in simhash.set_links(sets, root, np.array([0, 0, 1, 1, 1]), 0.8)} == {(1, 2)}


def test_fullest():
    assert packing.fullest([(7, 1), (5, 2), (3, 4)], 13) in ([(7, 1), (3, 2)], [(5, 2), (3, 1)])
    assert packing.fullest([(9, 3)], 5) == []
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = sorted({int(x): int(rng.integers(1, 4)) for x in rng.integers(2, 30, 5)}.items(), reverse=True)
        room = int(rng.integers(5, 60))
        best = max((sum(n * k for (n, _), k in zip(lengths, ks, strict=True)) for ks in itertools.product(*(range(c + 1) for _, c in lengths)) if sum(n * k for (n, _), k in zip(lengths, ks, strict=True)) <= room))
        got = packing.fullest(lengths, room)
        assert sum(n * k for n, k in got) == best and all(k <= dict(lengths)[n] for n, k in got)


def test_plan_places_each_piece_once():
    hist = {2048: 3, 1500: 10, 548: 4, 300: 25, 7: 500}
    slots = packing.plan(hist)
    taken = {}
    for n, c in hist.items():
        for i in range(c):
            b, at = packing.place(slots, n, i)
            taken.setdefault(b, []).append((at, n))
    for b in taken.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(taken) <= -(-sum(n * c for n, c in hist.items()) // 2048) + 1


def test_sequences_hold_the_ids(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    d = spark.createDataFrame([(1, "hello there"), (2, "x " * 5000), (3, None)], "doc_id long, text string")
    packed = packing.pack(written(packing.pieces(d, path, with_ids=True), "p"))
    got = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in got) == 4 * sum(r["length"] for r in packed.collect())


def accepted_spans(text):
    """Spans of the kinds beyond the base, one match at a time."""
    import regex

    def moved(c):
        digits = "".join(str(int(x, 36)) for x in c[4:] + c[:4])
        return int(digits) % 97 == 1

    def luhn(c):
        return sum(v - 9 * (v > 9) for v in (int(x) * (1 + i % 2) for i, x in enumerate(reversed(c)))) % 10 == 0

    out = []
    for kind in pii.KINDS[4:]:
        for m in regex.finditer(kind.pattern, text or ""):
            bare = m[0].replace(" ", "").replace("-", "")
            if kind.name == "iban" and not (15 <= len(bare) <= 34 and moved(bare)) or kind.name == "short_card" and not luhn(bare):
                continue
            near = text[max(0, m.start() - pii.BEFORE) : m.end() + pii.AFTER].lower()
            score = pii.PROPOSED + pii.CHECKED * kind.checked + pii.CONTEXT * bool(regex.search(kind.words, near))
            if score >= pii.ACCEPT:
                out.append((kind.name, m.start(), m.end()))
    return sorted(out)


def test_method_spans_by_brute_force(spark):
    import random

    rnd = random.Random(17)
    parts = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE88370400440532013000", "378282246310005", "3782-822463-10005", "3782-822463-10006", "123-45-6789", "900-45-6789", "(212) 555-0188", "212.555.0188", "0123456789abcdef" * 2, "ABCDEF0123456789" * 3, "a" * 31]
    parts += ["ssn", "iban", "token:", "phone", "amex", "Tax ID", "é\U0001f600", "and so on and so forth and more of it", ".", ", ", "\n", "x"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.choice((2, 6, 40)))) for _ in range(400)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for r in pii.with_spans(d).select("doc_id", "pii_spans").collect():
        got = sorted((pii.KINDS[s["k"]].name, s["start"], s["end"]) for s in r["pii_spans"] if s["k"] >= len(pii.BASE))
        assert got == accepted_spans(texts[r["doc_id"]])
        found += len(got)
    assert found > 500


def test_masks(spark):
    rows = [(1, "write a@b.org or +1 (800) 555-1234.", "k"), (2, None, None), (3, "nothing", None)]
    got = {r["doc_id"]: r["text"] for r in pii.mask_pii(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect()}
    assert got == {1: "write <EMAIL> or <PHONE>.", 2: None, 3: "nothing"}


@pytest.mark.parametrize(("code", "want"), [("GB82WEST12345698765432", True), ("GB83WEST12345698765432", False)])
def test_mod97(spark, code, want):
    assert spark.range(1).select(pii.mod97(F.lit(code))).first()[0] is want


def test_context_moves_the_score(spark):
    rows = [(1, "ssn 123-45-6789"), (2, "part 123-45-6789"), (3, "ssn 000-45-6789")]
    got = {r["doc_id"]: len(r["pii_spans"]) for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_secrets_without_equals_sign(spark):
    key = "0123456789abcdef" * 2
    texts = [f"token: {key}", f"the api key {key} is old", f'{{"secret": "{key.upper()}"}}', f"token = {key}", f"commit {key}"]
    got = {r["doc_id"]: r["text"] for r in pii.mask_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "token: <SECRET>", 1: "the api key <SECRET> is old", 2: '{"secret": "<SECRET>"}', 3: "token = <SECRET>", 4: texts[4]}


def concentrated(y, mu, inv, floors):
    """Concentration steps with exact subsets until the determinant falls no more: log determinant, centre, inverse."""
    best = (np.inf, mu, inv)
    while True:
        d = np.einsum("ij,jk,ik->i", y - best[1], best[2], y - best[1])
        inner = y[d <= np.sort(d)[int(np.ceil(quality.SUBSET * len(y))) - 1]]
        cov = quality.CONSISTENT * np.cov(inner.T, bias=True)
        cov = cov + np.diag(np.maximum(floors**2 - np.diag(cov), 0))
        now = (np.linalg.slogdet(cov)[1], inner.mean(axis=0), np.linalg.inv(cov))
        if now[0] >= best[0] - quality.FALL:
            return best
        best = now


def test_outliers_against_many_starts(spark):
    """Two groups, one with a fifth of its rows far off in one place, against the least determinant of 100 random starts."""
    rng = np.random.default_rng(6)
    normal = lambda n: rng.normal((500, 60, 150, 200, 130, 170), (60, 40, 130, 120, 40, 45), (n, 6))
    far = rng.normal((800, 500, 100, 100, 130, 600), 40, (100, 6))
    tables = {"a": np.concatenate([normal(400), far]), "b": normal(300)}
    tables = {g: x.round().astype(int) for g, x in tables.items()}
    data = [(g, i, list(map(int, v))) for g, x in tables.items() for i, v in enumerate(x)]
    rows = written(spark.createDataFrame(data, "grp string, doc_id long, x array<int>"), "x")
    model = written(quality.fit(rows), "model")
    dets = {r["grp"]: r["det"] for r in model.collect()}
    found = quality.salted(rows, model, ["grp"]).withColumn("d2", quality.distance()).collect()
    floors = np.array(quality.FLOORS)
    for g, x in tables.items():
        y, starts = x / quality.UNIT, []
        for _ in range(100):
            some = y[rng.choice(len(y), 12, replace=False)]
            cov = np.cov(some.T)
            starts.append(concentrated(y, some.mean(axis=0), np.linalg.inv(cov + np.diag(np.maximum(floors**2 - np.diag(cov), 0))), floors))
        det, mu, inv = min(starts, key=lambda s: s[0])
        assert dets[g] <= det + 0.1
        want = np.einsum("ij,jk,ik->i", y - mu, inv, y - mu) > quality.CUTOFF
        got = np.array([d for _, d in sorted((r["doc_id"], r["d2"]) for r in found if r["grp"] == g)]) > quality.CUTOFF
        assert (got == want).mean() > 0.99 and got[400:].all() and got[:400].mean() < 0.01


def test_each_statistic_can_reject(spark):
    """A text that is odd in one statistic alone, among like ones."""
    rng = np.random.default_rng(12)
    centre = np.array([500, 20, 0, 100, 130, 170])
    rows = [("g", i, list(map(int, centre + rng.integers(-15, 16, 6) * (centre > 0)))) for i in range(300)]
    for k, v in enumerate((900, 600, 700, 750, 500, 600)):
        odd = centre.copy()
        odd[k] = v
        rows.append(("g", 1000 + k, list(map(int, odd))))
    t = written(spark.createDataFrame(rows, "grp string, doc_id long, x array<int>"), "x")
    found = quality.salted(t, quality.fit(t), ["grp"]).withColumn("d2", quality.distance()).filter(F.col("d2") > quality.CUTOFF)
    assert {r["doc_id"] for r in found.collect()} == set(range(1000, 1006))


def test_small_groups_are_kept(spark):
    text = " ".join(f"word{i}" for i in range(80))
    d = spark.createDataFrame([(1, text, None, None), (2, None, "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["kept"] for r in quality.judged(d).collect()} == {1: True, 2: False}


def test_unknown_language_goes(spark):
    d = written(spark.createDataFrame([(1, "the house is red and the dog", "en", "c"), (2, "123 !!", "en", "c"), (3, None, None, None)], "doc_id long, text string, lang string, score string"), "t")
    got = language.drop_unknown(d)
    assert got.columns == d.columns and [r["doc_id"] for r in got.collect()] == [1]


def test_vectors_do_not_depend_on_the_table(monkeypatch):
    g = np.array([(97 << 42) | (98 << 21) | 99, (32 << 42) | (97 << 21) | 98, (97 << 42) | (97 << 21) | 97])
    once = language.gram_vectors(g).copy()
    monkeypatch.setattr(language, "KEPT", 0)
    assert (language.gram_vectors(g) == once).all() and (np.stack([language.gram_vector(int(x)) for x in g]) == once).all()


def test_long_words_merge_alike():
    import public_tokenizers

    m = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    parts = [m.ids[c] for c in "thethethingandthe" * 10]
    assert m.merge_long(list(parts)) == m.merge(list(parts))


def test_templates(spark):
    lines = [f"Report number {i} was filed by clerk{i} at the desk of {n} today" for i, n in enumerate("ann bob cid dan eve fay gus hal ivy joy kim lea".split())]
    rows = [(i, f"{w} {w}{w} own words of text\n{x}\n") for (i, x), w in zip(enumerate(lines), "abcdefghijkl", strict=True)]
    d = written(spark.createDataFrame([*rows, (90, None), (91, ""), (92, "a\n\nb")], "doc_id long, text string").withColumn("leaf", F.lit("c")), "t")
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(d).collect()}
    assert all(got[i]["n_dropped"] == 1 and lines[i] not in got[i]["text"] for i in range(12))
    assert got[90]["text"] is None and got[91]["text"] == "" and got[92]["text"] == "a\n\nb" and got[92]["n_lines"] == 2


def test_intervals(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("a", "block", "x.org", day(2), "add"), ("a", "block", "x.org", day(5), "remove"), ("b", "allow", "ok.x.org", day(3), "add"), ("a", "block", "y.org", day(4), "add"), ("a", "block", "y.org", day(4), "remove"), ("a", "block", None, day(1), "add")], "list string, kind string, domain string, since date, action string")
    asked = [("http://x.org/", 1), ("http://x.org/", 2), ("http://a.X.org:8/", 4), ("http://x.org/", 5), ("http://ok.x.org/", 2), ("http://ok.x.org/", 4), ("http://y.org", 9), ("http://nox.org", 3), (None, 3)]
    captures = written(spark.createDataFrame([(i, u, day(n), "c") for i, (u, n) in enumerate(asked)], "id int, url string, fetched date, domain string"), "c")
    got = [r["decision"] for r in url_filter.judged(captures, entries).orderBy("id").collect()]
    assert got == ["none", "block", "block", "none", "block", "allow", "none", "none", "none"]


def test_spellings_of_a_domain_are_one(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("a", None, "X.org.", day(2), "add"), ("a", None, "x.org", day(5), "remove"), ("a", None, "y.org", None, "add")], "list string, kind string, domain string, since date, action string")
    captures = spark.createDataFrame([(1, "http://x.org./", day(4)), (2, "http://x.org", day(6)), (3, "http://y.org", day(6))], "id int, url string, fetched date")
    assert [r["decision"] for r in url_filter.judged(captures, entries).orderBy("id").collect()] == ["block", "none", "none"]


def test_scratch(spark, tmp_path, monkeypatch):
    """Tables go with their scratch, kept ones and those outside it stay, also where it ends in an error."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    left = lambda: sorted(x.name for x in tmp_path.glob("*/*"))
    rows = spark.range(3)
    outer = written(rows, "outer")
    with common.scratch(spark):
        written(rows, "one")
        with pytest.raises(KeyError), common.scratch(spark):
            written(rows, "two")
            raise KeyError
        assert left() == ["one", "outer"]
        kept = written(rows, "kept", keep=True)
    assert left() == ["kept", "outer"] and kept.count() == outer.count() == 3
    common.discard(kept, outer)
    assert list(tmp_path.iterdir()) == []


def changed(rng, base, how, share):
    """A copy of base (words) with about this similarity over five-word shingles."""
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    n = len(base) - 4
    if how == "appended":
        return base + words(round(n / share) - n)
    if how == "cut":
        return base[: round(n * share) + 4]
    if how == "replaced":
        m = max(1, round(n * (1 - share) / (1 + share)) - 4)
        return base[:100] + words(m) + base[100 + m :]
    out = list(base)
    for k in range(round(n * (1 - share) / (1 + share) / 5)):
        out[5 + 6 * k] = words(1)[0]
    return out


def test_recall_near_the_threshold(spark):
    """Pairs from 0.8 to 0.9 by kind of edit, against brute force: every one is found."""
    rng = np.random.default_rng(20)
    texts, kind = {}, {}
    for g, (how, share) in enumerate(itertools.product(("appended", "cut", "replaced", "scattered"), np.repeat(np.linspace(0.8, 0.9, 6), 8))):
        base = [f"w{x}" for x in rng.integers(0, 1_000_000, 454)]
        texts |= {2 * g: " ".join(base), 2 * g + 1: " ".join(changed(rng, base, how, share))}
        kind[g] = how
    d = written(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "t")
    got, want = {r["doc_id"] for r in simhash.drop_near(d).collect()}, set(similar_groups(texts))
    true = [g for g in kind if 2 * g + 1 not in want]
    assert len(true) > 150 and set(kind.values()) == {kind[g] for g in true}
    assert got == want


def test_rows_stay_the_same_whoever_plans_them(spark, tmp_path):
    """The plan is made for one number of cores and run for another."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.repartition(5).write.parquet(f"{tmp_path}/d")
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    read = lambda: spark.read.parquet(f"{tmp_path}/d")
    captures = lambda: read().select(F.col("doc_id").alias("id"), F.concat(F.lit("http://"), "source", F.lit(".org/")).alias("url"), F.lit("2024-05-01").cast("date").alias("fetched"))
    entries = spark.createDataFrame([("a", "block", "src1.org", "2024-01-01", "add")], "list string, kind string, domain string, since string, action string").withColumn("since", F.col("since").cast("date"))
    for call in (lambda: exact_dedup.drop_copies(read()), lambda: simhash.drop_near(read()), lambda: line_dedup.drop_lines(read()), lambda: url_filter.judged(captures(), entries)):
        want = rows(call())
        df = call()
        spark.conf.set("spark.sql.files.minPartitionNum", "23")
        try:
            assert rows(df) == want
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")


CLASHES = ("row_id", "row_id_", "spans", "dropped", "lines", "best", "salt", "host", "fp", "node", "keys", "digest", "key", "u", "v")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_anything(spark, name):
    """Empty tables, and columns with names that are used inside."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    none = written(docs.limit(0), "none")
    out = stage(spark, none, "")
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(c).alias(c) for c in CLASHES)).limit(60)
    more = spark.createDataFrame([(None, None, None, None, None, *CLASHES), (-1, "", "", "", 0, *CLASHES), (-1, "", "", "", 0, *CLASHES)], odd.schema)
    odd = written(odd.union(more), "odd")
    out = stage(spark, odd, "")
    if name != "packing":
        assert out.columns == odd.columns
        assert all(r[c] == c for r in out.collect() for c in CLASHES)
    if name == "pii":
        assert out.count() == odd.count()


def test_megabytes(spark, tmp_path):
    """One text of a million letters without a space, one of a million characters in words and lines, one of digits."""
    rng = np.random.default_rng(8)
    letters = "".join(rng.choice(list("abcdefgh"), 1_000_000))
    words = "".join(f"w{x}\n" if x % 9 == 0 else f"w{x} " for x in rng.integers(0, 99_999, 150_000))
    rows = [(1, letters), (2, words), (3, "1 " * 500_000), (4, words + " more")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    for name, query in registry.QUERIES.items():
        if name != "op1_url_filter":
            assert {r["doc_id"] for r in query(spark, str(tmp_path)).collect()} == {1, 2, 3, 4}
    assert {r["doc_id"] for r in simhash.drop_near(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()} == {1, 2, 3}


def test_long_hosts_have_short_parents(spark):
    host = "x." * 300 + "bad.org"
    got = spark.createDataFrame([(host,), ("a.b.c",), ("y" * 300,)], "host string").select(url_filter.parents(F.col("host")).alias("p")).collect()
    labels = host.split(".")
    assert got[0]["p"] == [host, *(x for i in range(1, len(labels)) if len(x := ".".join(labels[i:])) <= url_filter.LONGEST)]
    assert got[1]["p"] == ["a.b.c", "b.c", "c"] and got[2]["p"] == ["y" * 300]


def test_junk_letters_go(spark):
    """Letters drawn at random and a language that nobody learned go; clean texts of any length stay."""
    rng = np.random.default_rng(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    draw = lambda letters: "".join(rng.choice(list(letters), 1500, p=[0.15, *[0.85 / (len(letters) - 1)] * (len(letters) - 1)]))
    junk = [(10**6 + i, draw(" abcdefghijklmnopqrstuvwxyz" if i % 2 else " абвгдежзиклмнопрстуфхц"), None) for i in range(40)]
    out = language.drop_unknown(written(docs.union(spark.createDataFrame(junk, docs.schema)), "t"))
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in out.collect()} == letters


def test_language_by_brute_force(spark):
    """Prototypes and cosines from plain sums of gram vectors."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()

    def vector(text):
        s = re.sub(r" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
        v = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            v += np.roll(language.letter(ord(a)).astype(int), 2) * np.roll(language.letter(ord(b)).astype(int), 1) * language.letter(ord(c))
        return v

    sums = {}
    for r in rows[:40]:
        if r["lang"] and r["text"]:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vector(r["text"])
    d = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string")
    profiles = language.Profiles.learn(spark.createDataFrame([tuple(r) for r in rows[:40]], d.schema))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.with_language(d, profiles, ["doc_id"]).collect()}
    for r in rows:
        v = vector(r["text"])
        if not v.any():
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        cos = {n: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for n, p in sums.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[r["doc_id"]][0] == best and abs(got[r["doc_id"]][1] - max(0, cos[best])) < 1e-5


def merged_one_by_one(m, parts):
    """The leftmost pair of least rank, again and again."""
    parts = list(parts)
    while True:
        found = [(m.pairs[p][0], i) for i, p in enumerate(itertools.pairwise(parts)) if p in m.pairs]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [m.pairs[parts[i], parts[i + 1]][1]]


def test_merges_against_brute_force():
    import public_tokenizers

    m, rng = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), np.random.default_rng(11)
    for alphabet in ("aaab", "abcdefghijklmnopqrstuvwxyz", "etaoin"):
        for n in (1, 2, 3, 20, 255, 256, 400):
            parts = [m.ids[c] for c in rng.choice(list(alphabet), n)]
            want = merged_one_by_one(m, parts)
            assert m.merge(list(parts)) == want and m.merge_long(list(parts)) == want


def test_scores_by_brute_force(spark):
    """The learned model's probabilities of texts, class by class and word by word."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80).collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    texts[min(texts)] += " neverseen neverseen otherword"
    d = written(spark.createDataFrame([(i, t, i % 10 == 0) for i, t in texts.items()], "doc_id long, text string, held_out boolean"), "t")
    got = {r["doc_id"]: r["score"] for r in hmm.scored(d).collect()}
    lexicon = hmm.Lexicon(written(hmm.counted(d.filter("NOT held_out")), "vocab"))
    model = hmm.trained(written(hmm.encoded(d, lexicon), "rows"), lexicon)
    words = {i: [*hmm.words_of(t), hmm.END] for i, t in texts.items()}
    count = collections.Counter(w for i in texts if i % 10 for w in words[i])
    ranked = sorted((w for w in count if w != hmm.END), key=lambda w: (-count[w], w))
    alone = {hmm.END: 0} | {w: k + 1 for k, w in enumerate(ranked[: hmm.TOP])}
    kinds = collections.defaultdict(list)
    for w in ranked[hmm.TOP :]:
        kinds[hmm.Lexicon.suffix(w)].append(count[w])
    for i, ws in words.items():
        want, alpha = 0.0, None
        for w in ws:
            z = alone.get(w, hmm.Lexicon.suffix(w))
            p = (model.start if alpha is None else alpha @ model.move).astype(float) * model.emit[:, z]
            want += np.log10(p.sum())
            alpha = p / p.sum()
            if w not in alone:
                size = kinds.get(z, [])
                want += np.log10((count[w] + hmm.PSEUDO) / (sum(size) + hmm.PSEUDO * (len(size) + 1)))
        assert got[i] == pytest.approx(want, rel=1e-3)


def test_pipeline_by_brute_force(spark):
    """The documents that come through, by the rules of each stage applied one pair at a time."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {i: t for i, t in docs.items() if any(c.isalpha() for c in t)}
    by = collections.defaultdict(list)
    for i, t in kept.items():
        by["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i))
    kept = {i: kept[i] for i in (min(g)[1] for g in by.values())}
    small = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t) for i, t in kept.items()}
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    sets = {i: {tuple(split(t)[k : k + 5]) for k in range(max(1, len(split(t)) - 4))} for i, t in small.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            up[max(top(a), top(b))] = min(top(a), top(b))
    want = {i for i in sets if top(i) == i}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == want and len(want) < len(docs)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values())
    assert len(bins) <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = written(stage(spark, rows, sf), name)
        assert rows.columns == columns
    kept = {r["doc_id"] for r in rows.collect()}
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == kept
