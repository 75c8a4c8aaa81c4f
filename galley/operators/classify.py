"""Findings of a review: noise taken out, layers and priorities given by an ordered rule chain, duplicates merged.

A findings table has doc_id, ord (the order in which findings were made), original_text, issue_type,
category, confidence, suggestion, reason, block_index (null: not located), chunk_index, located. Rules are
branches of one CASE, so the first that holds wins; modifiers are columns that follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley import constants as K
from galley.functions import lookalike
from galley.functions import text as T

REASONS = ("self_declared", "control_chars", "no_change", "layout")
# What is put before a suggestion, or takes its place, and the notes that rules leave.
AS_QUOTED, AS_QUOTED_WITH = "原文照录，不建议改动。", "原文照录，不建议改动。LLM提示的疑点供参考："
TO_VERIFY, VERIFY_START = "存疑,建议人工核实：", "存疑"
FROM_OCR = "该处文字来自OCR识别且置信度较低，可能为识别误差而非原文错误。"
NOTE = {
    "q1": "LLM自报quotation",
    "q2": "issue_type=引用与成语准确性",
    "q3": "original_text命中引文文本特征(长引号/文言虚词)",
    "f1": "LLM自报factual",
    "f2": "issue_type=常识与事实性错误",
    "f3": "original_text命中人名/职务/机构名/年份特征",
    "f_high": "事实类高置信,建议人工复核仍然适用",
    "grammar": "精简模式下语法结构问题统一按风格可选处理",
    "dash": "精简模式下'汉字冒充标点符号'类错别字问题按风格可选处理",
    "style": "风格可选",
    "high": "默认归层:高置信度→确定性错误",
    "unlocated": "原文未能定位回原稿",
}


def said() -> Column:
    return F.concat(F.coalesce("reason", F.lit("")), F.coalesce("suggestion", F.lit("")))


def original() -> Column:
    return F.coalesce("original_text", F.lit(""))


def self_declared() -> Column:
    return T.has_any(said(), K.NON_ISSUE_WORDS)


def drop_reason(unicode_rules: bool = True) -> Column:
    """Why a finding is noise, or null. Without unicode_rules only what the JVM can tell."""
    out = F.when(self_declared(), REASONS[0]).when(T.stray_controls(original()), REASONS[1])
    layout = T.has_any(said(), K.LAYOUT_WORDS)
    if not unicode_rules:
        return out.when(layout, REASONS[3])
    return out.when(lookalike.no_change("original_text", "suggestion"), REASONS[2]).when(layout | lookalike.space_change("original_text", "suggestion"), REASONS[3])


def recency_doubt() -> Column:
    """The year itself is doubted, and lies within the grace period after the cutoff year."""
    factual = (F.col("category") == "factual") | (F.col("issue_type") == K.TYPE_FACT)
    own = T.years(original())
    latest = F.array_max(F.when(F.size(own) > 0, own).otherwise(T.years(said())))
    return F.coalesce(factual & T.has_any(said(), K.RECENCY_WORDS) & (latest > K.CUTOFF_YEAR) & (latest <= K.CUTOFF_YEAR + K.GRACE_YEARS), F.lit(False))


def wrap_space(block: str = "block_text") -> Column:
    """The finding quotes a blank that the block has not: it comes from a line end."""
    t, b = original(), F.col(block)
    bare = F.contains(F.replace(b, F.lit("\n"), F.lit("")), F.replace(t, F.lit(" "), F.lit("")))
    return F.coalesce(F.contains(t, F.lit(" ")) & ~F.contains(b, t) & bare, F.lit(False))


def cut_off(block: str = "block_text", tail: str = "is_tail", ends: str = K.TERMINAL) -> Column:
    """The finding is the end of a chunk's last block that goes on in the next chunk."""
    b, t = T.rstrip(block), T.strip(original())
    return F.coalesce(F.col(tail) & ~F.substring(b, -1, 1).isin(*ends) & (t != "") & F.endswith(b, t), F.lit(False))


def with_blocks(findings: DataFrame, blocks: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """findings with block_text, ocr_confidence and is_tail; a null block_index meets nothing."""
    seen = blocks.select("doc_id", "block_index", F.col("text").alias("block_text"), F.col("ocr_confidence").cast("double"))
    out = findings.join(seen, ["doc_id", "block_index"], "left")
    if tails is None:
        return out.withColumn("is_tail", F.lit(False))
    return out.join(tails.select("doc_id", "block_index", F.lit(True).alias("is_tail")), ["doc_id", "block_index"], "left").withColumn("is_tail", F.coalesce("is_tail", F.lit(False)))


def factual_text() -> Column:
    t = original()
    changed = T.strip(F.coalesce("suggestion", F.lit(""))) != T.strip(t)
    return changed & (t.rlike(T.YEAR) | T.has_any(t, K.TITLE_WORDS) | T.has_any(t, K.ORG_WORDS))


def label(confidence: str = "confidence") -> Column:
    out = F
    for value, name in K.CONFIDENCE_LABELS.items():
        out = out.when(F.col(confidence) == value, name)
    return out.otherwise(F.col(confidence))


def notes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(NOTE[n])) for c, n in pairs)))


def classified(findings: DataFrame, mode: str = K.DEEP, clean_reason: bool = True) -> DataFrame:
    """findings with layer, priority, layer_notes, their suggestion rewritten; the original values are kept
    in original_suggestion, llm_category and llm_confidence."""
    quoting = [F.col("category") == "quotation", F.col("issue_type") == K.TYPE_QUOTATION, (T.longest_quote(original()) >= K.QUOTE_CHARS) | T.classical(original())]
    stating = [F.col("category") == "factual", F.col("issue_type") == K.TYPE_FACT, factual_text()]
    simple, high = F.lit(mode == K.SIMPLIFIED), F.col("confidence") == "high"
    rows = findings.withColumns({f"__q{i}": c for i, c in enumerate(quoting)} | {f"__f{i}": c for i, c in enumerate(stating)})
    q, f = [F.col(f"__q{i}") for i in range(3)], [F.col(f"__f{i}") for i in range(3)]
    rule = (
        F.when(q[0] | q[1] | q[2], "quotation")
        .when(f[0] | f[1] | f[2], "factual")
        .when(simple & (F.col("issue_type") == K.TYPE_GRAMMAR), "grammar")
        .when(simple & (F.col("issue_type") == K.TYPE_TYPO) & T.has_any(said(), K.DASH_WORDS), "dash")
        .when((F.col("category") == "style") | T.has_any(said(), K.STYLE_WORDS), "style")
        .otherwise("default")
    )
    rows = rows.withColumn("__rule", rule)
    r, s = F.col("__rule"), F.col("suggestion")
    reason = lookalike.cleaned_reason("reason") if clean_reason else T.strip(F.coalesce("reason", F.lit("")))
    rows = rows.withColumn("__reason", reason)
    layer = F.when(r == "quotation", K.QUOTATION).when(r.isin("grammar", "dash", "style"), K.OPTIONAL).when(high, K.CONFIRMED).otherwise(K.DOUBTFUL)
    priority = F.when(r == "quotation", K.LOW).when(r.isin("grammar", "dash", "style"), K.LEISURE).otherwise(K.MEDIUM)
    rewritten = (
        F.when((r == "quotation") & (F.col("__reason") != ""), F.concat(F.lit(AS_QUOTED_WITH), "__reason"))
        .when(r == "quotation", AS_QUOTED)
        .when((r == "factual") & ~high & ~F.startswith(T.strip(s), F.lit(VERIFY_START)), F.concat(F.lit(TO_VERIFY), s))
        .otherwise(s)
    )
    lowered = F.concat(F.lit("事实类"), label(), F.lit("置信,降级为存疑待核实"))
    other = F.when(r == "default", F.array(F.when(high, F.lit(NOTE["high"])).otherwise(F.concat(F.lit("默认归层:"), label(), F.lit("置信度→存疑待核实")))))
    for name in ("grammar", "dash", "style"):
        other = other.when(r == name, F.array(F.lit(NOTE[name])))
    left = (
        F.when(r == "quotation", notes((q[0], "q1"), (q[1], "q2"), (q[2], "q3")))
        .when(r == "factual", F.concat(notes((f[0], "f1"), (f[1], "f2"), (f[2], "f3")), F.array(F.when(high, F.lit(NOTE["f_high"])).otherwise(lowered))))
        .otherwise(other)
    )
    kept = {"original_suggestion": s, "llm_category": F.col("category"), "llm_confidence": F.col("confidence")}
    return rows.withColumns({"layer": layer, "priority": priority, "layer_notes": left} | kept).withColumn("suggestion", rewritten).drop("__rule", "__reason", *(f"__{a}{i}" for a in "qf" for i in range(3)))


def modified(rows: DataFrame) -> DataFrame:
    """Classified rows with the modifiers in order: unsure recognition, no place in the document, high priority."""
    ocr = F.coalesce((F.col("ocr_confidence") < K.OCR_DOWNGRADE) & F.col("issue_type").isin(K.TYPE_TYPO, K.TYPE_PUNCTUATION), F.lit(False))
    lost, urgent = ~F.col("located"), F.col("issue_type").isin(*K.HIGH_PRIORITY_TYPES)
    added = F.array_compact(
        F.array(
            F.when(ocr, F.concat(F.lit("低OCR置信度降级(conf="), F.col("ocr_confidence").cast("string"), F.lit(")"))),
            F.when(lost, F.lit(NOTE["unlocated"])),
            F.when(urgent, F.concat(F.lit("issue_type="), "issue_type", F.lit("命中高优先级强制覆盖"))),
        )
    )
    return rows.withColumns(
        {
            "layer": F.when((ocr | lost) & (F.col("layer") == K.CONFIRMED), K.DOUBTFUL).otherwise(F.col("layer")),
            "priority": F.when(urgent, K.HIGH).otherwise(F.col("priority")),
            "suggestion": F.when(ocr, F.concat(F.lit(FROM_OCR), "suggestion")).otherwise(F.col("suggestion")),
            "layer_notes": F.concat("layer_notes", added),
        }
    )


def rank(layer: str = "layer") -> Column:
    """How careful a layer is: quotations most, then doubts, style, errors."""
    return F.when(F.col(layer) == K.QUOTATION, 3).when(F.col(layer) == K.DOUBTFUL, 2).when(F.col(layer) == K.OPTIONAL, 1).otherwise(0)


def deduplicated(rows: DataFrame) -> DataFrame:
    """One finding for each block and text, white space aside: the most careful, then the first. position is
    where the first stood; findings without a block all stay."""
    placed = rows.filter("block_index IS NOT NULL").withColumn("__key", T.no_space("original_text"))
    w = Window.partitionBy("doc_id", "block_index", "__key")
    best = placed.withColumn("__n", F.row_number().over(w.orderBy(rank().desc(), "ord"))).withColumn("position", F.min("ord").over(w)).filter("__n = 1").drop("__n", "__key")
    return best.unionByName(rows.filter("block_index IS NULL").withColumn("position", F.col("ord")))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with seq, their place in reading order from 0: by block, those without one last."""
    w = Window.partitionBy("doc_id").orderBy(F.col("block_index").asc_nulls_last(), "position")
    return rows.withColumn("seq", F.row_number().over(w) - 1)


def stats(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    counts = [F.count_if(F.col("layer") == layer).alias(name) for layer, name in zip(K.LAYERS, ("count_confirmed", "count_doubtful", "count_quotation", "count_optional"), strict=True)]
    return rows.groupBy(key).agg(F.count("*").alias("total_issues"), *counts, F.count_if(F.col("priority") == K.HIGH).alias("high_priority_count"))


def reviewed(findings: DataFrame, blocks: DataFrame, tails: DataFrame | None = None, mode: str = K.DEEP) -> DataFrame:
    """The whole chain: noise and artefacts out, classified, modified, deduplicated, in reading order."""
    rows = with_blocks(findings.withColumn("__why", drop_reason()).filter("__why IS NULL").drop("__why"), blocks, tails)
    rows = rows.filter(~(recency_doubt() | wrap_space() | cut_off()))
    return numbered(deduplicated(modified(classified(rows, mode))))
