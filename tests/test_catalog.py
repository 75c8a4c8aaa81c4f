"""Queries without SQL against brute force on small tables."""

import datetime as dt

from galley.operators import compare
from galley.plans import catalog, run
from galley.workspace import Workspace


def folder(spark, tmp_path, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_glyph_lines_of_whole_blocks(spark, tmp_path):
    """Brackets drawn in the right half of their box stay in place in boxes of this width; controls become blanks."""
    texts = {1: "a\x01b " + "\U0001f600中x" * 300 + " the end", 2: "short", 3: "《" + "word " * 2000 + "z"}
    sf = folder(spark, tmp_path, texts)
    got = {r["doc_id"]: r["line"] for r in catalog.QUERIES["glyph_lines"](spark, sf).collect()}
    blocks = {r["doc_id"]: r["text"] for r in catalog.blocks(spark, sf).collect()}
    assert min(len(blocks[1]), len(blocks[3])) > 400
    assert got == {d: t.replace("a\x01b", "a b").strip() for d, t in blocks.items()}


def test_doc_diff_pairs_every_document(spark, tmp_path):
    """Against the edit script of each document and the next; 4 has no next, 6 no even neighbour."""
    texts = {1: "One. Two.", 2: "One. Three.", 3: "One. Three. Four.", 4: "Five.", 6: "Six.", 7: "Six. Seven."}
    sf = folder(spark, tmp_path, texts)
    want = []
    for d in texts:
        old, new = ([x + "." for x in texts.get(i, "").replace(" ", "").split(".") if x] for i in (d, d + 1))
        want += [(d, n, len(a), len(b)) for n, (_, a, b, _, _) in enumerate(compare.script(old, new))]
    got = [(r["pair_id"], r["seq"], len(r["original_text"]), len(r["formatted_text"])) for r in catalog.QUERIES["doc_diff"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and {1, 3} <= {r[0] for r in got}


def test_review_of_a_document(spark, tmp_path):
    """From blocks to a record; saving fails once and is tried again, the model is not asked again."""
    texts = {1: "One line here.\nAnother line of it.", 2: "Two."}
    blocks = catalog.blocks(spark, folder(spark, tmp_path, texts))
    found = run.compute(blocks, catalog.stand_in, "rules", str(tmp_path / "run"))
    assert {r["doc_id"] for r in found.collect()} == {1, 2} and run.warnings(spark, str(tmp_path / "run")).count() == 0
    w = Workspace(spark, str(tmp_path / "w"))
    record = spark.createDataFrame([(1, "a", dt.datetime(2026, 1, 1))], "task_id long, doc_name string, created_at timestamp_ntz")
    real, calls = w.insert, []

    def failing(*a, **b):
        calls.append(a[0])
        if len(calls) == 2:
            raise OSError("lost")
        return real(*a, **b)

    w.insert = failing
    rid, ids = run.publish(w, str(tmp_path / "run"), 1, record, blocks)
    assert calls == ["issues", "records", "issues", "records"] and w.records().count() == 1 and w.orphans().count() == len(ids)
    rows = w.issues(rid).collect()
    assert len(rows) == len(ids) == w.records().first()["total_issues"] == 1
    assert rows[0]["original_text"] == "One line here.\nAnoth" and rows[0]["context_snippet"] == texts[1] and rows[0]["page_location"] == "第1段"
