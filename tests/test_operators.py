"""Chunks, places, layers, differences, layout and the workspace on small literals."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from galley import constants as K
from galley.functions import text as T
from galley.operators import chunking, classify, compare, export, feedback, glyphs, layout, locate, metrics, pages, repair, review_map
from galley.plans import catalog
from galley.sources import blocks as B
from galley.streaming import events
from galley.workspace import Workspace, upgraded

BLOCKS = "doc_id long, block_index int, page int, text string, block_type string, source_location string, ocr_confidence double"
FINDINGS = "doc_id long, ord long, original_text string, issue_type string, category string, confidence string, suggestion string, reason string, block_index int, chunk_index int, located boolean"


def block(i, text, kind="paragraph", page=1, conf=None):
    return {"block_index": i, "text": text, "block_type": kind, "page": page, "ocr_confidence": conf}


def table(spark, blocks):
    return spark.createDataFrame([(1, b["block_index"], b["page"], b["text"], b["block_type"], f"第{b['page']}页", b["ocr_confidence"]) for b in blocks], BLOCKS)


def finding(ord, text="示例原文", kind="标点符号问题", category="normal", confidence="high", suggestion="建议修改", reason="示例依据", block=0):
    return (1, ord, text, kind, category, confidence, suggestion, reason, block, 0, block is not None)


def test_chunks_cover_blocks():
    got = chunking.chunks_of([block(i, "字" * 400) for i in range(30)], chunking.Sizes())
    assert [b for c in got for b in c["block_indices"]] == list(range(30))
    assert all(c["char_count"] <= K.CHUNK_MAX for c in got)


def test_heading_is_pushed():
    sizes = chunking.Sizes(target=100, overlap=0)
    got = chunking.chunks_of([block(0, "X" * 80), block(1, "H" * 10, "heading"), block(2, "Y" * 30)], sizes)
    assert [c["block_indices"] for c in got] == [[0], [1, 2]]
    assert [c["block_indices"] for c in chunking.chunks_of([block(0, "X"), block(1, "H", "heading")], sizes)] == [[0], [1]]


def test_oversized_and_tables():
    sentence = "字" * 19 + "。"
    got = chunking.chunks_of([block(0, sentence * 400)], chunking.Sizes(overlap=0))
    assert len(got) > 1 and "".join(c["body"] for c in got) == sentence * 400 and all(c["body"].endswith("。") for c in got)
    assert chunking.chunks_of([block(0, "t" * 5000, "table")], chunking.Sizes()) == []
    assert chunking.split_long("ab。" + "x" * 7 + "。c", chunking.Sizes(most=5)) == ["ab。", "xxxxx", "xx。", "c"]


def test_overlap():
    got = chunking.chunks_of([block(i, "字" * 50, page=i + 1) for i in range(6)], chunking.Sizes(target=110))
    assert got[1]["overlap_prefix_blocks"] == [0, 1] and got[1]["block_indices"] == [2] and (got[1]["page_lo"], got[1]["page_hi"]) == (1, 3)


def test_chunks_of_table(spark):
    rows = chunking.gathered(table(spark, [block(0, "a"), block(1, "b")]))
    assert [r["body"] for r in chunking.chunks(rows).collect()] == ["a\nb"]
    assert chunking.chunks(rows.limit(0)).collect() == []


def test_classified_layers(spark):
    rows = [
        finding(0, "“一二三四五六七八九十”"),
        finding(1, category="factual", confidence="medium"),
        finding(2, category="style"),
        finding(3),
        finding(4, confidence="low", block=None),
        finding(5, kind="政治敏感性表述"),
    ]
    b = table(spark, [block(0, "示例原文", conf=0.95)])
    got = {r["ord"]: r for r in classify.reviewed(spark.createDataFrame(rows, FINDINGS), b).collect()}
    assert got[0]["layer"] == K.QUOTATION and got[0]["suggestion"] == classify.AS_QUOTED_WITH + "示例依据"
    assert got[4]["layer"] == K.DOUBTFUL and classify.NOTE["unlocated"] in got[4]["layer_notes"]
    best = [r for r in got.values() if r["block_index"] == 0 and r["original_text"] == "示例原文"]
    assert len(best) == 1 and best[0]["layer"] == K.DOUBTFUL and best[0]["position"] == 1


def test_unsure_recognition(spark):
    b = table(spark, [block(0, "示例原文", conf=0.85)])
    got = classify.reviewed(spark.createDataFrame([finding(0)], FINDINGS), b).first()
    assert got["layer"] == K.DOUBTFUL and got["suggestion"] == classify.FROM_OCR + "建议修改"


def test_noise(spark):
    rows = [finding(0, suggestion="此类不应报告为问题"), finding(1, "a\x01b"), finding(2, "能⼒", suggestion="应改为“能力”"), finding(3, reason="排版错乱"), finding(4)]
    got = spark.createDataFrame(rows, FINDINGS).select("ord", classify.drop_reason().alias("w")).collect()
    assert [r["w"] for r in sorted(got)] == ["self_declared", "control_chars", "no_change", "layout", None]


@pytest.mark.parametrize(("year", "want"), [(2026, False), (2027, True), (2028, True), (2029, False)])
def test_recency(spark, year, want):
    row = finding(0, f"{year}年发布", category="factual", reason="超出训练数据")
    assert spark.createDataFrame([row], FINDINGS).select(classify.recency_doubt()).first()[0] is want


def test_wrapped_blank_and_cut_off(spark):
    b = table(spark, [block(0, "教务管理教\n师很多"), block(1, "说到一半")])
    tails = spark.createDataFrame([(1, 1)], "doc_id long, block_index int")
    rows = spark.createDataFrame([finding(0, "管理教 师"), finding(1, "一半", block=1), finding(2, "说到", block=1), finding(3, "x y", block=None)], FINDINGS)
    got = classify.with_blocks(rows, b, tails).select("ord", classify.wrap_space().alias("a"), classify.cut_off().alias("b")).collect()
    assert [(r["a"], r["b"]) for r in sorted(got)] == [(True, False), (False, True), (False, False), (False, False)]


def test_simplified(spark):
    rows = spark.createDataFrame([finding(0, kind=K.TYPE_GRAMMAR), finding(1, kind=K.TYPE_TYPO, suggestion="改用破折号")], FINDINGS).withColumn("ocr_confidence", F.lit(None).cast("double"))
    assert {r["layer"] for r in classify.classified(rows, K.SIMPLIFIED).collect()} == {K.OPTIONAL}
    assert {r["layer"] for r in classify.classified(rows).collect()} == {K.CONFIRMED}


def test_unlocated_are_not_merged(spark):
    rows = spark.createDataFrame([finding(0, block=None), finding(1, block=None)], FINDINGS).withColumn("layer", F.lit(K.CONFIRMED))
    assert classify.deduplicated(rows).count() == 2


def test_locate(spark):
    b = table(spark, [block(0, "第一 块"), block(1, "第二块开"), block(2, "头第三块")])
    asked = spark.createDataFrame([(1, 10, "第一块"), (1, 11, "块开头第三"), (1, 12, "没有")], "doc_id long, item_id long, snippet string")
    got = {r["item_id"]: (r["block_index"], r["window"]) for r in locate.located(asked, b, ["doc_id"], "item_id").collect()}
    assert got == {10: (0, 1), 11: (1, 2)}
    items = asked.select("item_id", F.col("snippet").alias("text"))
    docs = spark.createDataFrame([(1, "第一 块\n第二块开\n头第三块"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, locate.candidates(items, docs).collect())) == [(1, 10), (1, 11)]


def test_narrowed():
    old, new = "珠三角成就标题系全国第一条城市快速路。后面一样。", "珠三角成就标题系全国第二条城市快速路。后面一样。"
    assert compare.narrowed("题，" + old, "题，" + new) == (old[:19], new[:19])
    assert [x[0] for x in compare.script(["a。", "b。"], ["a。", "b。", "c。"])] == ["insert"]


def test_diffs(spark):
    a = table(spark, [block(0, "我们去了公园。"), block(1, "第二段。")])
    b = table(spark, [block(0, "我们去了图书馆。\n第二段。\n第三段。")]).withColumn("doc_id", F.lit(2).cast("long"))
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, original_id long, formatted_id long")
    got = compare.diffs(pairs, a, b).orderBy("seq").collect()
    assert [(r["diff_type"], r["formatted_text"], r["block_index"]) for r in got] == [("文字替换", "我们去了图书馆。", 0), ("新增内容", "第三段。", 0)]
    same = b.withColumn("text", F.lit("我们去了公园。\n第二段。"))
    assert compare.diffs(pairs, a, same).count() == 0


def test_four_columns():
    boxes = [(x0, 100.0 + 20 * i, x1, 118.0 + 20 * i) for x0, x1 in ((50, 240), (260, 450), (550, 740), (760, 950)) for i in range(5)]
    assert [abs(s - w) <= 2 for s, w in zip(layout.boundaries(boxes, 1000.0), (250, 500, 750), strict=True)] == [True] * 3
    assert layout.boundaries([(50.0, 100.0 + 20 * i, 950.0, 118.0 + 20 * i) for i in range(5)], 1000.0) == []


def test_wrapped_merge():
    def line(y, text, x1=200.0):
        box = {"x0": 0.0, "y0": y, "x1": x1, "y1": y + 10}
        return {"place": int(y), "text": text, "column": "left", "bbox": box, "avg_size": 8.0, "last_row_bbox": box, "last_row_size": 8.0}

    assert [b["text"] for b in layout.merge_page([line(100.0, "是最根本的成"), line(111.0, "功要素。"), line(122.0, "下一段")])] == ["是最根本的成功要素。", "下一段"]
    assert [b["text"] for b in layout.merge_page([line(100.0, "Plant"), line(111.0, "Design")])] == ["Plant Design"]
    assert len(layout.merge_page([line(100.0, "短", 50.0), line(111.0, "下一行")])) == 2


def test_running_heads(spark):
    rows = [(1, p, "top", "刊名") for p in (1, 2)] + [(1, 1, "bottom", "12"), (1, 1, "body", "刊名"), (1, 2, "top", "只有一次")]
    got = layout.without_running_heads(spark.createDataFrame(rows, "doc_id long, page int, zone string, text string")).collect()
    assert sorted((r["zone"], r["text"]) for r in got) == [("body", "刊名"), ("top", "只有一次")]


def test_spread():
    density = [0.5] * 45 + [0.0] * 14 + [0.5] * 41
    assert layout.dark_gap(density) == (45, 59) and layout.spread_split(density, 200, 100) == 52
    assert layout.spread_split(density, 100, 100) is None


def test_extent_split():
    two = [{"x0": 10.0, "x1": 45.0, "text": "字" * 10}, {"x0": 55.0, "x1": 90.0, "text": "字" * 10}]
    assert abs(layout.extent_split(two, 0.0, 100.0) - 50) <= 1
    assert layout.extent_split(two[:1], 0.0, 100.0) is None


def line(spark, text, boxes):
    rows = [(i, c, float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(text, boxes, strict=True))]
    return spark.createDataFrame([(rows,)], "g array<struct<seq:int,c:string,x0:double,x1:double>>")


def test_glyph_rules(spark):
    read = lambda df, rule: df.select(glyphs.line_text(rule(F.col("g")))).first()[0]
    assert read(line(spark, "I\x01A中\x01A", [(i * 8, i * 8 + 7) for i in range(6)]), glyphs.restored) == "I A中\x01A"
    assert read(line(spark, "2《.", [(0, 5), (5, 15), (6, 9)]), glyphs.by_ink) == "2.《"
    assert read(line(spark, ". 《", [(0, 4), (5, 9), (3, 13)]), glyphs.without_fillers) == ".《"
    spaced = line(spark, "A PSXY", [(0, 5), (5, 6), (6, 11), (12, 17), (18, 23), (24, 29)])
    assert read(spaced, glyphs.without_tracking) == "APSXY"
    assert read(line(spark, " a ", [(0, 1), (1, 2), (2, 3)]), glyphs.stripped) == "a"


def test_repair():
    assert repair.repaired("第�届大会开幕", [1], "第五届大会开幕") == "第五届大会开幕"
    assert repair.repaired("第�届", [1], "全不一样") == "第□届"
    assert repair.repaired("第�届", [1], None) == "第□届"


def test_regions(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    lines = spark.createDataFrame([(1, 0, (1.0, 1.0, 3.0, 3.0), "乙", 0.9), (1, 1, (90.0, 90.0, 92.0, 92.0), "甲", 0.5)], f"page int, line int, bbox {box}, text string, score double")
    regions = spark.createDataFrame([(1, 0, (0.0, 0.0, 50.0, 50.0), "text"), (1, 1, (0.0, 0.0, 10.0, 10.0), "doc_title"), (1, 2, (60.0, 60.0, 80.0, 80.0), "seal")], f"page int, region int, box {box}, label string")
    assert sorted(map(tuple, layout.region_of(lines, regions, ["page"]).collect())) == [(1, 0, 1), (1, 1, 2)]
    assert [(r["text"], r["block_type"]) for r in layout.region_texts(lines, regions, ["page"]).collect()] == [("乙", "heading")]


ITEM = '{"original_text":"第一块","issue_type":"标点符号问题","category":"normal","confidence":"high","suggestion":"s","reason":"r"}'


def test_replies():
    assert len(review_map.ask(lambda s, u: f"```json\n[{ITEM}, {{}}]\n```", "", "")) == 1
    replies = iter(["no", f"[{ITEM}]"])
    assert len(review_map.ask(lambda s, u: next(replies), "", "")) == 1
    with pytest.raises(review_map.ReplyError):
        review_map.ask(lambda s, u: "{}", "", "")
    assert review_map.json_array('["a\nb"]') == ["a\nb"]


def test_retries():
    waits, answers = [], iter([(500, {}, ""), (429, {"Retry-After": "7"}, ""), (200, {}, "ok")])
    assert review_map.retrying(lambda: next(answers), sleep=waits.append) == "ok" and waits == [1, 7.0]
    with pytest.raises(review_map.CallError):
        review_map.retrying(lambda: (404, {}, ""), sleep=waits.append)


def test_model_stage(spark):
    b = table(spark, [block(0, "第一块"), block(1, "第二块")])
    chunks = chunking.chunks(chunking.gathered(b)).cache()
    answers = review_map.asked(chunks, lambda s, u: f"[{ITEM}]", "").cache()
    got = review_map.findings(answers, chunks, b).collect()
    assert [(r["block_index"], r["located"], r["page_location"]) for r in got] == [(0, True, "第1页")]
    failed = review_map.asked(chunks, lambda s, u: "no", "").collect()
    assert len(failed) == 1 and failed[0]["error"].startswith("ReplyError")


def test_prompt():
    rules = "x\n**1. a** one\n**2. b** two\n**3. c** three\n**10. d** ten"
    text = review_map.system_prompt(rules, K.SIMPLIFIED, template="{rules}|{learned}")
    assert "one" in text and "ten" in text and "three" not in text and text.endswith(review_map.NO_RULES)


def test_feedback_rules(spark):
    rows = spark.createDataFrame([(i, "t", "o", "s", "r") for i in range(3)], "feedback_id long, issue_type string, original_text string, suggestion string, reason string")
    reply = '[{"rule_text": "x", "matched_feedback_ids": [0, 1, 2, 9]}, {"rule_text": "y", "matched_feedback_ids": [0, 9]}]'
    assert [tuple(r) for r in feedback.regenerate(rows, lambda s, u: reply).collect()] == [("x", [0, 1, 2])]
    assert feedback.regenerate(rows.limit(2), lambda s, u: reply) is None
    assert feedback.regenerate(rows, lambda s, u: "no") is None


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{paragraphs}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="a1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="a1"/></w:pPr><w:r><w:t>题</w:t></w:r></w:p><w:p/><w:p><w:ins><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:ins><w:del><w:r><w:delText>x</w:delText></w:r></w:del></w:p>'
    (tmp_path / "a.DOCX").write_bytes(docx(body))
    got = B.read_docx(spark, str(tmp_path)).orderBy("block_index").collect()
    assert [(r["text"], r["block_type"], r["source_location"], r["page"]) for r in got] == [("题", "heading", "第1段", 0), ("a\tb", "paragraph", "第3段", 0)]


def test_workbook():
    row = dict.fromkeys(export.COLUMNS, "<x>\x01") | {"fill": export.RED}
    with zipfile.ZipFile(io.BytesIO(export.workbook([row]))) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row") == 2 and "&lt;x&gt;" in sheet and 's="1"' in sheet


def test_workspace(spark, tmp_path):
    w, now = Workspace(spark, str(tmp_path / "w")), dt.datetime(2026, 1, 1)
    task = w.create_task("期刊", now, created_by="a")
    record = spark.createDataFrame([(task, "b", now, K.RECORD_STANDARD)], "task_id long, author string, created_at timestamp_ntz, task_type string")
    issues = spark.createDataFrame([(i, f"t{i}", K.CONFIRMED) for i in range(3)], "seq int, original_text string, layer string")
    rid, ids = w.persist(record, issues)
    w.change("issues", ids[0], status=K.ACCEPTED)
    w.change("issues", ids[1], status=K.REJECTED, note="n")
    w.change("issues", ids[1], status=K.ACCEPTED)
    assert [r["status"] for r in w.issues(rid).collect()] == [K.ACCEPTED, K.ACCEPTED, K.PENDING]
    assert w.records().first()["accepted_count"] == 2 and w.orphans().count() == 0
    with pytest.raises(ValueError, match="changeable"):
        w.change("issues", ids[0], layer="x")
    with pytest.raises(ValueError, match="no row"):
        w.change("tasks", 99, status="x")
    w.change("tasks", task, status=K.STATUSES_TASK[2])
    assert w.tasks().count() == 0 and w.tasks(closed=True).count() == 1
    with pytest.raises(ValueError, match="no record"):
        export.export_record(w.read("issues"), w.read("records"), 77)
    assert export.export_record(w.read("issues"), w.read("records"), rid)[:2] == b"PK"


def test_review_from_run_to_export(spark, tmp_path):
    """Figures and contexts with a record, rejections remembered and forgotten, questions stored, a sheet with its path."""
    w, now = Workspace(spark, str(tmp_path / "w")), dt.datetime(2026, 1, 1, 12)
    task, other = w.create_task("a", now), w.create_task("b", now)
    record = spark.createDataFrame([(task, "稿:1", now, K.RECORD_STANDARD)], "task_id long, doc_name string, created_at timestamp_ntz, task_type string")
    rows = [(i, f"t{i}", "x", K.LAYERS[i % 4], K.HIGH if i < 3 else K.LOW, "s", None if i == 5 else i) for i in range(9)]
    issues = spark.createDataFrame(rows, "seq int, original_text string, issue_type string, layer string, priority string, suggestion string, block_index int").repartition(3)
    blocks = spark.createDataFrame([(i, f"b{i}") for i in range(9)], "block_index int, text string")
    rid, ids = w.persist(record, issues, blocks=blocks)
    got = w.issues(rid).collect()
    assert [r["issue_id"] for r in got] == list(ids) == list(range(1, 10)) and [r["original_text"] for r in got] == [f"t{i}" for i in range(9)]
    assert got[4]["context_snippet"] == "b2\nb3\nb4\nb5\nb6" and got[5]["context_snippet"] is None
    r = w.records().first()
    assert (r["total_issues"], r["count_confirmed"], r["count_optional"], r["high_priority_count"]) == (9, 3, 2, 3)
    w.decide(ids[0], K.REJECTED, now, "no")
    w.decide(ids[1], K.ACCEPTED, now)
    f = w.read("feedback").collect()
    assert [(x["original_text"], x["reason"], x["source_issue_id"], x["source_record_id"]) for x in f] == [("t0", "no", ids[0], rid)]
    assert [x["source_task_type"] for x in w.feedback().collect()] == [K.RECORD_STANDARD] and w.issue(ids[0])["status"] == K.REJECTED and w.issue(99) is None
    w.forget(f[0]["feedback_id"])
    assert w.read("feedback").count() == 0 and w.records().first()["rejected_count"] == 1
    said = []
    answer = lambda system, user: said.append(user) or f"a{len(said)}"
    assert [w.ask(ids[2], q, answer, now) for q in ("q1", "q2")] == ["a1", "a2"]
    assert "Q: q1\nA: a1" in said[1] and [t["answer"] for t in w.history(ids[2])] == ["a1", "a2"] and w.history(ids[3]) == []
    with pytest.raises(ValueError, match="no row"):
        w.ask(99, "q", answer, now)
    w.move(rid, other)
    w.change("tasks", task, status=K.STATUSES_TASK[2])
    with pytest.raises(ValueError, match="open task"):
        w.move(rid, task)
    assert w.records(other).count() == 1 and w.task(task)["status"] == K.STATUSES_TASK[2]
    assert [w.entered(t) and w.entered(t)["task_id"] for t in (task, other, 99, None)] == [None, other, None, None]
    for n in range(K.KEEP_FILES + 2):
        path = export.export_to(w, rid, f"file://{tmp_path}/out", now + dt.timedelta(seconds=n))
    assert path.endswith("20260101120011_稿_1_校对清单.xlsx") and w.records().first()["result_path"] == path
    assert len([x for x in (tmp_path / "out").iterdir() if x.suffix == ".xlsx"]) == K.KEEP_FILES


def test_comparison_record(spark, tmp_path):
    w, now = Workspace(spark, str(tmp_path / "w")), dt.datetime(2026, 1, 1)
    b = lambda d, *t: [(d, i, x, "paragraph", f"p{i}") for i, x in enumerate(t)]
    blocks = spark.createDataFrame(b(1, "甲。", "乙。") + b(2, "甲。", "丙。", "丁。"), "doc_id long, block_index int, text string, block_type string, source_location string")
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, original_id long, formatted_id long")
    diffs = compare.diffs(pairs, blocks, blocks)
    record = spark.createDataFrame([(1, now)], "task_id long, created_at timestamp_ntz")
    rid, ids = w.persist_comparison(record, diffs, blocks.filter("doc_id = 2").select("block_index", "text"))
    r, rows = w.records().first(), w.issues(rid).collect()
    assert len(rows) == len(ids) == diffs.count() == r["total_issues"] == r["count_confirmed"] and r["task_type"] == K.RECORD_COMPARE
    assert {x["priority"] for x in rows} == {K.MEDIUM} and rows[0]["context_snippet"] == "甲。\n丙。\n丁。"


def test_rules_are_replaced_at_once(spark, tmp_path):
    w, now = Workspace(spark, str(tmp_path / "w")), dt.datetime(2026, 1, 1)
    rules = lambda *t: spark.createDataFrame([(x, [1, 2, 3]) for x in t], feedback.RULE)
    w.replace_rules(rules("a", "b"), now)
    w.replace_rules(rules("c"), now)
    assert [r["rule_text"] for r in w.rules().collect()] == ["c"] and feedback.rules_text(w.rules()) == "- c"
    w.replace_rules(rules(), now)
    assert w.rules().count() == 0


def test_upgrade(spark):
    old = {
        "tasks": spark.createDataFrame([], "task_id long, name string, description string, status string"),
        "records": spark.createDataFrame([(1, None)], "record_id long, task_id long"),
        "issues": spark.createDataFrame([(1, "确定性错误", "r", "5")], "issue_id long, layer string, reject_reason string, doc_page string"),
    }
    new = upgraded(upgraded(old))
    assert new["issues"].columns == ["issue_id", "layer", "note"] and new["issues"].first()["layer"] == K.CONFIRMED
    assert new["records"].first()["task_id"] == 1 and new["tasks"].first()["name"] == K.LEGACY_TASK


def test_history(spark):
    rows = spark.createDataFrame([(1, t, f"q{t}", f"a{t}") for t in range(7)] + [(2, 0, "q", "a")], "issue_id long, turn int, question string, answer string")
    got = {r["issue_id"]: r["transcript"] for r in feedback.last_turns(rows).collect()}
    assert got[1].startswith("Q: q2\nA: a2\nQ: q3") and got[2] == "Q: q\nA: a"


def test_issue_noise(spark):
    rows = spark.createDataFrame([(1, "应用场\n景很多", "改为应用场景很多", None), (1, "1《 .", "x", "第\n页"), (1, "计划与排产\n实训班次数", "建议将“划与排产”与“实训班次”合并", None), (1, None, None, None)], "record_id long, original_text string, suggestion string, page_location string")
    assert metrics.issue_noise(rows).first().asDict() == {"record_id": 1, "total": 4, "n1": 1, "n2": 1, "n3_long": 0, "n3_short": 2}


def test_stream(spark, tmp_path):
    rows = [(i, i % 2, "s", dt.datetime(2026, 1, 1 + i)) for i in range(4)]
    spark.createDataFrame(rows + rows[:1], events.SCHEMA).write.parquet(str(tmp_path / "in"))
    source = events.read(spark, str(tmp_path / "in"))
    events.append(events.decisions(events.once(source)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("n")).first()[0] == 2  # the watermark is an hour before the last event, so two days are still open
    assert events.last_status(spark.read.parquet(str(tmp_path / "in"))).count() == 2


def test_route_and_kind(spark):
    row = spark.range(1).select(B.route(F.lit("x" * 20)).alias("a"), B.route(F.lit("")).alias("b"), B.kind_of(F.lit("x/a.PDF")).alias("c")).first()
    assert tuple(row) == ("native", "ocr", "pdf")
    with pytest.raises(Exception, match="unsupported"):
        spark.range(1).select(B.kind_of(F.lit("a.txt"))).collect()


def test_repair_folds_and_skips_codes():
    assert repair.agreement("侧", {0: "好"}, {0}) == 1.0
    assert repair.repaired("侧侧", [0, 1], "好的") == "好的"
    assert repair.repaired("侧侧", [0, 1], "") == K.UNREADABLE * 2
    assert repair.repaired("\x01⼚\ue000⼾里有侧", [6], "厂户里有字") == "\x01⼚\ue000⼾里有字"
    assert repair.repaired("abcdefgh侧", [8], "xxxxxxxx字") == "abcdefgh" + K.UNREADABLE


def test_codes(spark):
    rows = [("\U000f0000",), ("\U0010fffd",), ("\ue123",), ("\x02",), ("a",), ("字",), ("\U00020000",)]
    got = spark.createDataFrame(rows, "c string").select(glyphs.unreadable(F.col("c")).alias("u")).collect()
    assert [r["u"] for r in got] == [True] * 4 + [False] * 3


def glyph_line(text, x=0.0, y=0.0, size=8.0):
    g = [(i, c, x + 8.0 * i, x + 8.0 * i + 8.0) for i, c in enumerate(text)]
    return (g, (x, y, x + 8.0 * len(text), y + 12.0), size)


def test_assembled_blocks(spark):
    kind = "doc_id long, lines array<struct<glyphs:array<struct<seq:int,c:string,x0:double,x1:double>>,bbox:struct<x0:double,y0:double,x1:double,y1:double>,size:double>>"
    full = "这是一个写满了整行的句子还要接着往下写"
    rows = [
        (1, [glyph_line(full), glyph_line("下一行。", y=14.0)]),  # only wrapped
        (2, [glyph_line(full[:-1] + "。"), glyph_line("新的一行", y=14.0)]),  # a sentence ends
        (3, [glyph_line("a" * 20), glyph_line("b" * 20, y=14.0)]),  # a blank between Latin letters
        (4, [glyph_line("右边", x=40.0), glyph_line("左边", x=0.0)]),  # one row, the right part first
        (5, [glyph_line("\x01\x02"), glyph_line(" 字 ", y=14.0)]),  # only icons in a line; blanks at the ends
        (6, [glyph_line("\x01")]),
        (7, [([(0, "1", 0.0, 8.0), (1, ".", 8.0, 10.0), (2, "题", 22.0, 30.0)], (0.0, 0.0, 30.0, 12.0), 8.0), ([(0, "《", 10.0, 22.0)], (10.0, 0.0, 22.0, 12.0), 8.0)]),  # glyphs that mix
        (8, [glyph_line(full), glyph_line("1. 列表项", y=14.0)]),
        (9, None),
    ]
    got = {r["doc_id"]: r for r in pages.assembled(spark.createDataFrame(rows, kind)).collect()}
    want = {1: full + "下一行。", 2: full[:-1] + "。\n新的一行", 3: "a" * 20 + " " + "b" * 20, 4: "左边 右边", 5: "字", 7: "1.《题", 8: full + "\n1. 列表项"}
    assert {k: r["text"] for k, r in got.items()} == want
    assert tuple(got[4]["last_row_bbox"]) == (0.0, 0.0, 56.0, 12.0) and tuple(got[1]["last_row_bbox"]) == (0.0, 14.0, 32.0, 26.0)


def test_recognised_pages(spark):
    lines, regions = [], []
    for k, (x, y, kind) in enumerate([(0.0, 0.0, "text"), (540.0, 0.0, "text"), (0.0, 100.0, "text"), (540.0, 100.0, "image"), (0.0, 200.0, "text")]):
        regions.append((1, k, (x, y, x + 460.0, y + 80.0), kind, 1000.0))
        lines += [(1, 10 * k + j, (x + 5, y + 20 * j, x + 470, y + 20 * j + 15), "字" * (1 if k == 4 else 30) + str(k), 0.2 if k == 4 else 0.9) for j in range(1 if k == 4 else 2)]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    out = pages.recognised(spark.createDataFrame(lines, f"page int, line int, bbox {box}, text string, score double"), spark.createDataFrame(regions, f"page int, region int, box {box}, label string, width double"), ["page"]).orderBy("place").collect()
    assert [(r["region"], r["column"]) for r in out] == [(0, "left"), (2, "left"), (1, "right")] and out[0]["text"] == "\n".join(["字" * 30 + "0"] * 2)


def test_alarm_and_escapes(spark):
    rows = [(1, 0, 0, 2), (2, None, None, 0), (3, 4, 1, 2)]
    base = spark.createDataFrame(rows, "record_id long, total_issues long, high_priority_count long, warnings int").withColumns({c: F.lit(0) for c in ("count_confirmed", "count_doubtful", "count_quotation", "count_optional")})
    got = {r["record_id"]: r for r in metrics.summaries(base).collect()}
    assert got[1]["alarm"] and not got[2]["alarm"] and not got[3]["alarm"] and "**" not in got[3]["summary"] and " 4 " in got[3]["summary"]
    import html

    text = "<a href=\"x\">&'"
    assert spark.createDataFrame([(text,)], "t string").select(T.html_escaped("t")).first()[0] == html.escape(text)


def test_starts(spark):
    rows = [(list(range(n)),) for n in (0, 1, 63, 64, 65, 1000)]
    for r in spark.createDataFrame(rows, "n array<int>").select("n", T.starts(F.col("n")).alias("s")).collect():
        assert r["s"] == [sum(r["n"][:i]) for i in range(len(r["n"]))]


def test_text_dump(spark, tmp_path):
    rows = [(1, i, "p1", t) for i, t in enumerate(["a'b", 'a"b', "x\ny\t\\", "中\u3000\x01", ""])]
    got = metrics.text_dump(spark.createDataFrame(rows, "doc_id long, block_index int, source_location string, text string"))
    assert [r["line"] for r in got.sort("block_index").collect()] == [f"{p!r}\t{t!r}" for _, _, p, t in rows]
    metrics.findings_json(spark.createDataFrame([(2, "b"), (1, "a")], "ord int, original_text string"), str(tmp_path / "f"))
    assert [r["original_text"] for r in spark.read.json(str(tmp_path / "f")).sort("ord").collect()] == ["a", "b"]


def test_repair_of_long_lines():
    import random
    import time

    # difflib needs minutes for either
    for text, right in (("".join(random.Random(1).choices("abcdefgh ", k=20000)), True), ("abcab" * 4000, False)):
        bad = list(range(5, len(text), 13))
        wrong = "".join("侧" if i % 13 == 5 else c for i, c in enumerate(text))
        began = time.process_time()
        made = repair.repaired(wrong, bad, text)
        assert made == text if right else len(made) == len(text)  # a part of a text that repeats goes with its first likeness
        assert time.process_time() - began < 20


def test_glyph_repair_query(spark):
    sf = "/root/testdata/sf0.001"
    blocks = catalog.blocks(spark, sf).collect()
    want = set()
    for b in (b for b in blocks if len(b["text"]) <= 120):
        wrong = "".join("侧" if i % 13 == 5 else c for i, c in enumerate(b["text"]))
        read = "".join("#" if i % 40 == 7 else c for i, c in enumerate(b["text"]))
        want.add((b["doc_id"], b["block_index"], repair.repaired(wrong, list(range(5, len(wrong), 13)), read)))
    got = {tuple(r) for r in catalog.glyph_repair(spark, sf).collect()}
    assert want and want <= got and len(got) == len(blocks)


def test_assembly_takes_little_memory_for_a_glyph(spark):
    import tracemalloc

    n = 4000
    made = "transform(sequence(0, 49), k -> struct(transform(sequence(0, 79), i -> struct(i as seq, 'a' as c, i * 8D as x0, i * 8D + 8D as x1)) as glyphs, struct(0D as x0, k * 14D as y0, 640D as x1, k * 14D + 12D as y1) as bbox, 8D as size))"
    rows = spark.range(n // 50).select(F.transform(F.expr(made), pages.compact).alias("lines")).toArrow().column(0).combine_chunks()
    tracemalloc.start()
    got = pages.block.func(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n // 50 and peak < 20 * 80 * n


def test_assembled_ligatures(spark):
    kind = "lines array<struct<glyphs:array<struct<seq:int,c:string,x0:double,x1:double>>,bbox:struct<x0:double,y0:double,x1:double,y1:double>,size:double>>"
    first = ([(0, "ffi", 0.0, 8.0), (1, ".", 8.0, 10.0), (2, "题", 22.0, 30.0)], (0.0, 0.0, 30.0, 12.0), 8.0)
    rows = [([first, ([(0, "《", 10.0, 22.0)], (10.0, 0.0, 22.0, 12.0), 8.0)],)]
    assert [r["text"] for r in pages.assembled(spark.createDataFrame(rows, kind)).collect()] == ["ffi.《题"]
