"""Every query by name, over the tables of one folder. Stand-ins for review data are made by rule from those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley import constants as K
from galley import workspace as W
from galley.functions import lookalike
from galley.functions import text as T
from galley.operators import chunking, classify, compare, export, feedback, glyphs, layout, locate, metrics, pages, repair, review_map
from galley.sources import blocks as B

#: Latin stand-ins for the sentence marks, as the tables hold no full-width ones.
ENDS = ".!?"
SIZES = chunking.Sizes(ends=ENDS)
TYPES = ("错别字与拼写", "标点符号问题", "语法结构问题", "引用与成语准确性", "常识与事实性错误", "政治敏感性表述", "用词与搭配")
SUGGESTIONS = ("建议更通顺地表达", "请核对", "此条不应报告为问题", "用破折号", "存疑，建议人工核实", "删去重复", "建议润色", "改写这一句", "核对年份", "补全", "合并")
REASONS = ("依据规范", "超出训练数据", "排版错乱", "2027年较新", "表述重复")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.from_documents(table(spark, sf, "documents").select("doc_id", "text"))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return B.rows_of(table(spark, sf, "documents").select("doc_id", "text"))


def pick(values, at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (at % len(values)).cast("int"))


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """One finding for each block: its kind, and what it quotes, by rule from the document and block numbers."""
    b = blocks(spark, sf).select("doc_id", "block_index", "text")
    k, t = F.col("doc_id") * 31 + F.col("block_index") * 7, F.col("text")
    quote = F.lit('"')
    texts = (
        F.when(k % 8 == 0, F.substring(t, 1, 40))
        .when(k % 8 == 1, F.concat(quote, F.substring(t, 1, 12), quote))
        .when(k % 8 == 2, F.concat(F.lit("1998年"), F.substring(t, 1, 10)))
        .when(k % 8 == 3, F.concat(F.lit("主任"), F.substring(t, 1, 9)))
        .when(k % 8 == 4, F.lit("之乎者也"))
        .when(k % 8 == 5, F.concat(F.lit("\x01"), F.substring(t, 1, 9)))
        .when(k % 8 == 6, F.concat(F.substring(t, 1, 3), F.lit(" "), F.substring(t, 4, 5)))
        .otherwise(F.substring(t, -20, 20))
    )
    lost = k % 9 == 0
    return b.select(
        "doc_id",
        F.col("block_index").cast("long").alias("ord"),
        texts.alias("original_text"),
        pick(TYPES, k % 7).alias("issue_type"),
        pick(K.CATEGORIES, k % 4).alias("category"),
        pick(K.CONFIDENCES, k % 3).alias("confidence"),
        pick(SUGGESTIONS, k % 11).alias("suggestion"),
        pick(REASONS, k % 5).alias("reason"),
        F.when(~lost, (F.col("block_index") / 2).cast("int") * 2).cast("int").alias("block_index"),
        (~lost).alias("located"),
    )


def recognised(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks, every fifth of which was recognised with some doubt."""
    sure = F.when(F.col("block_index") % 5 == 0, (F.col("block_index") % 10 + 85) / 100)
    return blocks(spark, sf).withColumn("ocr_confidence", sure)


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunks(rows(spark, sf), SIZES)


def with_text(spark: SparkSession, sf: str) -> DataFrame:
    return classify.with_blocks(findings(spark, sf), recognised(spark, sf))


def classified(spark: SparkSession, sf: str, mode: str = K.DEEP) -> DataFrame:
    """Classified findings; noise that the JVM can tell is out."""
    found = with_text(spark, sf).withColumn("why", classify.drop_reason(False)).filter("why IS NULL").drop("why")
    return classify.classified(found, mode, clean_reason=False)


def final(spark: SparkSession, sf: str) -> DataFrame:
    return classify.numbered(classify.deduplicated(classify.modified(classified(spark, sf))))


def records(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", K.RECORD_COMPARE).otherwise(K.RECORD_STANDARD)
    return o.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("author"), kind.alias("task_type"), F.col("o_orderdate").alias("created_at"))


def issues(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    n = F.col("l_partkey") + F.col("l_linenumber")
    status = F.when(F.col("l_returnflag") == "A", K.ACCEPTED).when(F.col("l_returnflag") == "R", K.REJECTED).otherwise(K.PENDING)
    return li.select(
        F.col("l_orderkey").alias("record_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("issue_id"),
        F.when(n % 5 > 0, F.concat(F.lit("第"), F.col("l_linenumber").cast("string"), F.lit("页"))).alias("page_location"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("original_text"),
        pick(TYPES, n).alias("issue_type"),
        pick(K.PRIORITIES, n).alias("priority"),
        pick(K.LAYERS, F.col("l_suppkey")).alias("layer"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("suggestion"),
        status.alias("status"),
        F.when(n % 3 == 0, "seen").alias("note"),
    )


def rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback from error events; a tenth of the sources do not exist."""
    e = table(spark, sf, "events").filter("event_type = 'error'")
    source = F.when(F.col("event_id") % 7 > 0, F.col("event_id") * F.when(F.col("event_id") % 10 == 0, -1).otherwise(1))
    return e.select(F.col("event_id").alias("feedback_id"), F.col("ts").alias("created_at"), pick(TYPES, F.col("event_id")).alias("issue_type"), source.alias("source_record_id"))


def blocks_from_documents(spark, sf):
    return blocks(spark, sf).select("doc_id", "block_index", "text")


def context_snippet(spark, sf):
    return locate.contexts(rows(spark, sf))


def ws_strip_dedup_key(spark, sf):
    return blocks(spark, sf).select("doc_id", "block_index", T.no_space("text").alias("key"))


def compare_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalised("text").alias("normalized"))


def sentence_split_offsets(spark, sf):
    return compare.sentences(table(spark, sf, "documents"), ENDS).select("doc_id", "seq", F.col("start").cast("long"), "sentence")


def stream_block_asof(spark, sf):
    return compare.sentence_blocks(rows(spark, sf), ENDS).select("doc_id", "seq", F.col("start").cast("long"), "block_index")


def unreadable_clause_drop(spark, sf):
    return blocks(spark, sf).select("doc_id", "block_index", T.without_unreadable("text", "z", ENDS, "").alias("readable"))


def oversized_split(spark, sf):
    sizes = chunking.Sizes(most=200, ends=ENDS)
    cut = blocks(spark, sf).select("doc_id", "block_index", F.posexplode(chunking.oversized("text", sizes)).alias("piece_no", "piece"))
    return cut.select("doc_id", "block_index", "piece_no", "piece")


def chunk_greedy_overlap(spark, sf):
    c = chunk_rows(spark, sf)
    return c.select("doc_id", "chunk_index", F.element_at("block_indices", 1).alias("first_block"), F.element_at("block_indices", -1).alias("last_block"), F.size("block_indices").alias("n_blocks"), F.size("overlap_prefix_blocks").alias("n_overlap"), "char_count")


def chunk_tail_blocks(spark, sf):
    return chunking.tails(chunk_rows(spark, sf))


def chunk_owner(spark, sf):
    return chunking.owners(chunk_rows(spark, sf))


def chunk_sizes(spark, sf):
    return metrics.chunk_sizes(chunk_rows(spark, sf)).withColumn("avg_chars", F.round("avg_chars", 4))


def locate_snippet(spark, sf):
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    found = locate.candidates(items, docs)
    mine = B.from_documents(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi"))
    asked = found.join(items.withColumnRenamed("text", "snippet"), "item_id")
    return locate.located(asked, mine, ["doc_id"], "item_id")


def overlap_routing(spark, sf):
    c = chunk_rows(spark, sf).select("doc_id", "chunk_index", "body", "overlap")
    asked = F.array(F.substring("overlap", 1, 30), F.substring("body", 1, 30), F.concat(F.lit("§ "), F.col("doc_id").cast("string")))
    snippets = c.filter("chunk_index > 0").select("doc_id", "chunk_index", F.explode(asked).alias("snippet"))
    return locate.routed(snippets, c).groupBy("doc_id", "route").agg(F.count("*").alias("n"))


def control_char_filter(spark, sf):
    return findings(spark, sf).filter(~T.stray_controls("original_text")).groupBy("doc_id").agg(F.count("*").alias("n_kept"))


def linewrap_artifact(spark, sf):
    return with_text(spark, sf).filter(classify.wrap_space()).select("doc_id", "ord")


def recency_filter(spark, sf):
    return findings(spark, sf).filter(classify.recency_doubt()).select("doc_id", "ord", "issue_type")


def boundary_truncation(spark, sf):
    rows = classify.with_blocks(findings(spark, sf), recognised(spark, sf), chunking.tails(chunk_rows(spark, sf)))
    return rows.filter(classify.cut_off(ends="!?")).select("doc_id", "ord")


def drop_reason_counts(spark, sf):
    return findings(spark, sf).groupBy(F.coalesce(classify.drop_reason(False), F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


def classify_base(spark, sf):
    both = [classified(spark, sf, m).withColumn("mode", F.lit(m)) for m in (K.DEEP, K.SIMPLIFIED)]
    return both[0].unionByName(both[1]).select("mode", "doc_id", "ord", "layer", "priority", "suggestion", F.array_join("layer_notes", "|").alias("notes"))


def classify_modifiers(spark, sf):
    rows = classify.modified(classified(spark, sf))
    return rows.select("doc_id", "ord", "layer", "priority", "suggestion", F.size("layer_notes").alias("n_notes"))


def conservative_dedup(spark, sf):
    rows = classify.deduplicated(classify.modified(classified(spark, sf)))
    return rows.select("doc_id", "ord", "position", "block_index", "layer")


def issue_sort(spark, sf):
    return final(spark, sf).select("doc_id", "seq", "ord")


def record_stats(spark, sf):
    return classify.stats(final(spark, sf))


def records_by_task(spark, sf):
    return records(spark, sf).groupBy("task_id").agg(F.count("*").alias("n_records"))


def accepted_rejected_counts(spark, sf):
    return W.decided(issues(spark, sf))


def authors_union(spark, sf):
    tasks = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("created_by"))
    return W.authors(tasks, records(spark, sf))


def feedback_left_join(spark, sf):
    return feedback.with_source(rejections(spark, sf), records(spark, sf)).select("feedback_id", "issue_type", "source_record_id", "source_task_type")


def feedback_eligible(spark, sf):
    return feedback.eligible(feedback.with_source(rejections(spark, sf), records(spark, sf))).select("feedback_id")


def rules_min_support(spark, sf):
    """A rule for each user, naming the events of that user; only error events are feedback."""
    e = table(spark, sf, "events")
    rules = e.groupBy(F.col("user_id").alias("rule_id")).agg(F.sort_array(F.collect_list("event_id")).alias("matched_feedback_ids")).withColumn("rule_text", F.lit("rule"))
    out = feedback.supported(rules, rejections(spark, sf))
    return out.select("rule_id", F.size("matched_feedback_ids").alias("n_ids"), F.array_join(F.transform("matched_feedback_ids", lambda i: i.cast("string")), ",").alias("ids"))


def followup_last_turns(spark, sf):
    c = table(spark, sf, "conversations")
    history = c.select(F.col("conv_id").alias("issue_id"), "turn", F.col("role").alias("question"), F.coalesce("text", F.lit("")).alias("answer"))
    return feedback.last_turns(history)


def export_projection(spark, sf):
    return export.accepted(issues(spark, sf))


def retention_topk(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id"), F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modified"))
    return export.surplus(e, ["user_id"]).select("user_id", "path")


def latest_values(spark, sf):
    e = table(spark, sf, "events")
    return W.latest(e, ["user_id"], "event_type", "event_id", "props")


def layer_groups(spark, sf):
    rows = final(spark, sf).groupBy(W.layer_place(F.col("layer")).alias("place"), "layer", "priority").agg(F.count("*").alias("n"))
    return rows.orderBy("place", "priority")


def page_rows(spark, sf) -> DataFrame:
    """Blocks as pages of twelve, the first and last of which stand at the page's edges."""
    b = blocks(spark, sf)
    i = F.col("block_index") % 12
    zone = F.when(i == 0, "top").when(i == 11, "bottom").otherwise("body")
    return b.withColumn("page", (F.col("block_index") / 12).cast("int") + 1).withColumn("zone", zone)


def header_footer_strip(spark, sf):
    """All documents of a source as the pages of one."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    b = page_rows(spark, sf).join(d, "doc_id").select("source", F.col("doc_id").alias("page"), "block_index", "text", "zone")
    return layout.without_running_heads(b, "source").select("source", "page", "block_index")


def boxes(spark, sf) -> DataFrame:
    """Boxes on pages 1000 wide by rule: two columns, and every seventh over both."""
    p = page_rows(spark, sf).withColumn("i", F.col("block_index") % 12)
    right = (F.col("i") % 2).cast("double")
    wide = F.col("block_index") % 7 == 3
    x0 = F.when(wide, 50.0).otherwise(50.0 + 460.0 * right)
    x1 = F.when(wide, 950.0).otherwise(490.0 + 460.0 * right)
    y0 = ((F.col("i") * 5) % 12 * 60.0 + 40.0).cast("double")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 50.0).alias("y1"))
    size = F.when(F.length("text") < 40, 14.0).otherwise(10.0)
    return p.select("doc_id", "page", F.col("block_index").alias("ord"), "text", box.alias("bbox"), F.lit(1000.0).alias("width"), size.alias("avg_size"), "zone")


def reading_order(spark, sf):
    b = boxes(spark, sf).withColumn("seams", F.array(F.lit(500.0)))
    return layout.reading_order(b, ["doc_id", "page"]).select("doc_id", "page", "ord", "column", "place")


def block_kinds(spark, sf):
    return layout.with_kinds(boxes(spark, sf), ["doc_id", "page"]).select("doc_id", "page", "ord", "body_size", "block_type")


def majority_layout(spark, sf):
    p = page_rows(spark, sf).groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n"))
    mode = F.when(F.col("n") % 3 == 0, "single").otherwise("double")
    return layout.majority(p.select("doc_id", mode.alias("mode")))


def region_assignment(spark, sf):
    """The boxes of a page as recognised lines, and six overlapping regions on it."""
    b = boxes(spark, sf).select("doc_id", "page", F.col("ord").alias("line"), "bbox")
    r = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("region")
    g = b.select("doc_id", "page").distinct().select("doc_id", "page", r)
    x, y = (F.col("region") % 2) * 500.0, F.floor(F.col("region") / 2) * 200.0
    box = F.struct(x.alias("x0"), y.cast("double").alias("y0"), (x + 520.0).alias("x1"), (y + 260.0).alias("y1"))
    return layout.region_of(b, g.withColumn("box", box), ["doc_id", "page"])


def noise_metrics(spark, sf):
    return metrics.noise(blocks(spark, sf), ENDS, "z", ENDS, "")


def noise_delta(spark, sf):
    """Findings of each document against those of the next."""
    i = findings(spark, sf).withColumn("original_text", F.concat(F.substring("original_text", 1, 6), F.lit("\n"), F.substring("original_text", 7, 40))).withColumn("suggestion", F.replace(F.col("original_text"), F.lit("\n"), F.lit(""))).withColumn("page_location", F.lit(None).cast("string"))
    figures = metrics.issue_noise(i, "doc_id").withColumnRenamed("doc_id", "record_id")
    pairs = table(spark, sf, "documents").select(F.col("doc_id").alias("baseline"), (F.col("doc_id") + 1).alias("current"))
    return metrics.delta(pairs, figures)


def file_fingerprint_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"), F.md5(F.concat(F.coalesce("text", F.lit("")), F.col("source"))).alias("pair_fingerprint"))


def format_dispatch(spark, sf):
    path = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(".docx"))
    d = table(spark, sf, "documents")
    return d.select("doc_id", B.kind_of(path).alias("kind"), layout_route(F.col("text")).alias("route"))


def layout_route(text: Column) -> Column:
    return B.route(text, least=200)


def variant_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.folded(F.coalesce("text", F.lit("")))).alias("folded_md5"), F.md5(T.without_c0(F.coalesce("text", F.lit("")))).alias("clean_md5"))


def nfkc_noop(spark, sf):
    f = findings(spark, sf).withColumn("suggestion", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("应改为“"), "original_text", F.lit("”"))).otherwise(F.col("suggestion")))
    return f.groupBy(F.coalesce(classify.drop_reason(), F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


def review_chain(spark, sf):
    """All rules at once, those on Unicode forms included."""
    return classify.stats(classify.reviewed(findings(spark, sf), recognised(spark, sf), chunking.tails(chunk_rows(spark, sf))))


def doc_diff(spark, sf):
    """Each document against the next, both long ones with what they share."""
    d = table(spark, sf, "documents")
    pairs = d.select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("original_id"), (F.col("doc_id") + 1).alias("formatted_id"))
    b = blocks(spark, sf)
    return compare.diffs(pairs, b, b, ENDS)


def column_boundaries(spark, sf):
    return layout.column_seams(boxes(spark, sf), ["doc_id", "page"])


def wrapped_merge(spark, sf):
    b = boxes(spark, sf).withColumn("seams", F.array(F.lit(500.0)))
    r = layout.reading_order(b, ["doc_id", "page"]).withColumns({"last_row_bbox": F.col("bbox"), "last_row_size": F.col("avg_size")})
    return layout.merged(r, ["doc_id", "page"]).select("doc_id", "page", "place", "text")


def glyph_lines(spark, sf):
    """Blocks as glyphs eight units wide, spaces made narrow, and back to text."""
    t = F.split(F.coalesce("text", F.lit("")), "")  # one element for each code point, in one pass over the text
    g = F.transform(t, lambda c, i: F.struct((i + 1).alias("seq"), c.alias("c"), ((i + 1) * 8.0).alias("x0"), ((i + 1) * 8.0 + 7.0).alias("x1")))
    clean = glyphs.line_text(glyphs.stripped(glyphs.without_fillers(glyphs.by_ink(glyphs.restored(F.col("g"))))))
    return blocks(spark, sf).select("doc_id", "block_index", g.alias("g")).select("doc_id", "block_index", clean.alias("line"))


def llm_map_fake(spark, sf):
    """The model stage with a pure function of the chunk in the model's place."""
    return review_map.asked(chunk_rows(spark, sf), stand_in, "rules").select("doc_id", "chunk_index", "item", "original_text", "issue_type", "error")


def model_findings(spark, sf):
    """What the stand-in found, with the place of each finding in its document. A real model's answers are written first."""
    chunks = chunk_rows(spark, sf)
    found = review_map.findings(review_map.asked(chunks, stand_in, "rules"), chunks, blocks(spark, sf))
    return found.select("doc_id", "chunk_index", "ord", "original_text", "block_index", "page_location", "located")


def stand_in(system: str, user: str) -> str:
    """A reply that quotes the first words of the body, now and then in a fence, and fails for texts of a certain length."""
    body = user.split(K.BODY_MARK)[-1].strip()
    if len(user) % 17 == 0:
        return "no array"
    import json

    item = {"original_text": body[:20], "issue_type": TYPES[len(user) % 7], "category": "normal", "confidence": "high", "suggestion": "x", "reason": "y"}
    reply = json.dumps([item, {"original_text": ""}])
    return f"```json\n{reply}\n```" if len(user) % 2 else reply


def reason_cleanup(spark, sf):
    f = findings(spark, sf).withColumn("reason", F.concat(F.lit("“"), F.substring("original_text", 1, 5), F.lit("”应为“"), F.substring("original_text", 1, 5), F.lit("”，另"), "reason"))
    return f.groupBy(lookalike.cleaned_reason("reason").alias("reason")).agg(F.count("*").alias("n"))


def finding_counts(spark, sf):
    return metrics.finding_counts(findings(spark, sf))


def text_source_rollup(spark, sf):
    """Pages by rule; documents without a block have none."""
    p = page_rows(spark, sf).groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n"))
    pages = p.select("doc_id", F.when(F.col("n") % 4 == 0, "ocr").otherwise("native").alias("route"))
    return metrics.text_source(pages, table(spark, sf, "documents"))


def result_summary(spark, sf):
    """Every document as a record, with a warning for every third."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("warnings"))
    return metrics.summaries(d.join(classify.stats(final(spark, sf)), "doc_id", "left"), "doc_id")


def issue_cards(spark, sf):
    shown = metrics.cards(issues(spark, sf).withColumn("suggestion", F.concat(F.lit("<b a='1'>&\""), "suggestion")))
    return shown.select("record_id", "issue_id", "page_location", "original_text", "suggestion", "note", F.size("layer_notes").alias("n_notes"))


def dangling_tasks(spark, sf):
    """Orders as records; the tasks are those customers whose key ends in another digit than 7."""
    tasks = table(spark, sf, "customer").filter("c_custkey % 10 <> 7").select(F.col("c_custkey").alias("task_id"))
    return W.dangling(records(spark, sf), tasks).select("record_id", "task_id")


def export_file_name(spark, sf):
    o = table(spark, sf, "orders")
    name = F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.lit("a:b/"), F.col("o_orderkey").cast("string")))
    return o.select(F.col("o_orderkey").alias("record_id"), export.file_name(name, F.col("o_orderdate").cast("timestamp_ntz")).alias("file_name"))


def zone_of_block(spark, sf):
    return boxes(spark, sf).withColumn("height", F.lit(800.0)).select("doc_id", "page", "ord", layout.zone().alias("zone"))


def text_dump(spark, sf):
    return metrics.text_dump(blocks(spark, sf))


def glyph_repair(spark, sf):
    """Blocks with every thirteenth character taken for another, and a reading that is right but for every fortieth."""
    n = F.length("text")
    bad = F.when(n > 5, F.sequence(F.lit(5), n - 1, F.lit(13))).otherwise(F.array().cast("array<int>"))
    wrong, read = T.sub("text", r"(?s)(.{5}).(.{0,7})", "$1侧$2"), T.sub("text", r"(?s)(.{7}).(.{0,32})", "$1#$2")
    return blocks(spark, sf).select("doc_id", "block_index", repair.repair(wrong, bad, read).alias("text"))


def native_blocks(spark, sf):
    """Blocks set as lines of 40 glyphs in columns 320 wide, and assembled again."""
    return pages.assembled(glyph_blocks(spark, sf)).select("doc_id", "block_index", "text", F.col("last_row_bbox.x1").alias("last_x1"))


def glyph_blocks(spark, sf) -> DataFrame:
    """Each block as lines of 40 characters, glyphs eight units wide, lines twelve high; every fifth line is split in two
    halves of one row, the right one first."""
    chars = F.split("text", "")
    row = lambda k: F.transform(F.slice(F.col("c"), k * 40 + 1, 40), lambda c, i: F.struct(i.alias("seq"), c.alias("c"), (i * 8.0).alias("x0"), (i * 8.0 + 8.0).alias("x1")))
    box = lambda g, k: F.struct(F.array_min(g.x0).alias("x0"), (k * 14.0).alias("y0"), F.array_max(g.x1).alias("x1"), (k * 14.0 + 12.0).alias("y1"))
    line = lambda g, k: F.struct(g.alias("glyphs"), box(g, k).alias("bbox"), F.lit(8.0).alias("size"))
    whole = lambda k: F.array(line(row(k), k))
    halves = lambda k: F.array(line(F.slice(row(k), 21, 20), k), line(F.slice(row(k), 1, 20), k))
    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size("c") - 1) / 40).cast("int")), lambda k: F.when((k % 5 == 4) & (F.size("c") > k * 40 + 20), halves(k)).otherwise(whole(k))))
    return blocks(spark, sf).select("doc_id", "block_index", chars.alias("c")).select("doc_id", "block_index", lines.alias("lines"))


def tasks(spark, sf) -> DataFrame:
    """Customers as tasks, with as many names as nations and blanks around some."""
    c = table(spark, sf, "customer")
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(""), F.lit("task "), F.col("c_nationkey").cast("string"))
    return c.select(F.col("c_custkey").alias("task_id"), name.alias("name"), pick(K.STATUSES_TASK, F.col("c_custkey")).alias("status"))


def open_tasks(spark, sf):
    return W.open_tasks(tasks(spark, sf)).select("task_id", "status")


def task_names_twice(spark, sf):
    return W.same_names(tasks(spark, sf))


def issue_filters(spark, sf):
    """Pending findings of one layer."""
    return issues(spark, sf).filter((F.col("layer") == K.LAYERS[1]) & (F.col("status") == K.PENDING)).select("record_id", "issue_id")


def fabricated_glyphs(spark, sf):
    """One glyph for each block; the trace has a mark for every sixth, a thousandth off."""
    b = boxes(spark, sf).select("doc_id", "page", "ord", F.col("ord").alias("i"), F.substring("text", 1, 1).alias("c"), (F.col("ord") * 8.25).alias("ox"), F.col("bbox.y0").alias("oy"))
    trace = b.filter("ord % 6 = 0").select("doc_id", "page", (F.col("ox") + 0.001).alias("ox"), "oy", F.lit("\ufffd").alias("c"))
    return repair.fabricated(b, trace, ["doc_id", "page"]).select("doc_id", "page", "ord")


def same_rows(spark, sf):
    """Whether each box stands in one row with the next of its page."""
    b = boxes(spark, sf)
    after = b.select("doc_id", "page", (F.col("ord") - 1).alias("ord"), F.col("bbox").alias("next"))
    return b.join(after, ["doc_id", "page", "ord"]).select("doc_id", "ord", layout.same_row("bbox", "next").alias("same"))


def block_location(spark, sf):
    b = boxes(spark, sf).withColumn("seams", F.array(F.lit(500.0)))
    r = layout.reading_order(b, ["doc_id", "page"])
    mode = F.when(F.col("page") % 2 == 0, "single").otherwise("double")
    return r.select("doc_id", "ord", layout.location(F.col("page"), F.col("column"), mode).alias("source_location"))


LABELS = ("doc_title", "text", "table", "image", "footnote", "header", "no such label", "abstract", "figure_title", "formula")


def label_types(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", pick(LABELS, F.coalesce("doc_id", F.lit(0))).alias("label"))
    return d.select("doc_id", layout.label_kind("label").alias("block_type"))


def unsure_scraps(spark, sf):
    """Blocks as recognised texts that are surer the later they stand."""
    b = blocks(spark, sf).withColumn("confidence", (F.col("block_index") % 10) / 10)
    return b.filter(layout.sure_enough()).select("doc_id", "block_index")


def repair_report(spark, sf):
    lines = blocks(spark, sf).select(((F.col("doc_id") + F.col("block_index")) % 11 / 10).alias("rate"))
    return metrics.repair_rates(lines)


QUERIES = {
    f.__name__: f
    for f in (
        blocks_from_documents, context_snippet, ws_strip_dedup_key, compare_normalize, sentence_split_offsets, stream_block_asof,
        unreadable_clause_drop, oversized_split, chunk_greedy_overlap, chunk_tail_blocks, chunk_owner, chunk_sizes, locate_snippet,
        overlap_routing, control_char_filter, linewrap_artifact, recency_filter, boundary_truncation, drop_reason_counts,
        classify_base, classify_modifiers, conservative_dedup, issue_sort, record_stats, records_by_task, accepted_rejected_counts,
        authors_union, feedback_left_join, feedback_eligible, rules_min_support, followup_last_turns, export_projection,
        retention_topk, latest_values, layer_groups, header_footer_strip, reading_order, block_kinds, majority_layout,
        region_assignment, noise_metrics, noise_delta, file_fingerprint_md5, format_dispatch, variant_fold, nfkc_noop, review_chain,
        doc_diff, column_boundaries, wrapped_merge, glyph_lines, llm_map_fake, reason_cleanup, finding_counts, text_source_rollup,
        result_summary, issue_cards, dangling_tasks, export_file_name, zone_of_block, text_dump, glyph_repair, native_blocks,
        open_tasks, task_names_twice, issue_filters, fabricated_glyphs, same_rows, block_location, label_types, unsure_scraps,
        repair_report, model_findings,
    )
}
