"""What editors rejected: which rejections count, and the rules that enough of them support."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley import constants as K
from galley.operators.review_map import CallError, ReplyError, json_array

RULE = "rule_text string, matched_feedback_ids array<bigint>"


def with_source(feedback: DataFrame, records: DataFrame) -> DataFrame:
    """feedback with source_task_type; a source that is gone leaves it null. Sort by created_at and feedback_id, both
    descending, to list it."""
    source = records.select(F.col("record_id").alias("source_record_id"), F.col("task_type").alias("source_task_type"))
    return feedback.join(source, "source_record_id", "left")


def eligible(rows: DataFrame) -> DataFrame:
    """Feedback that may become rules: no exempt types, none from comparisons; without a source it counts."""
    return rows.filter(~F.col("issue_type").isin(*K.EXEMPT_TYPES) & ~F.col("source_task_type").eqNullSafe(K.RECORD_COMPARE))


def supported(rules: DataFrame, valid_ids: DataFrame, least: int = K.REJECTION_THRESHOLD) -> DataFrame:
    """rules (rule_id, rule_text, matched_feedback_ids) with only ids that exist, and of those rules with at least so many.
    An id that a rule names twice counts twice."""
    each = rules.select("rule_id", "rule_text", F.posexplode("matched_feedback_ids").alias("at", "feedback_id"))
    kept = each.join(valid_ids.select("feedback_id").distinct(), "feedback_id", "left_semi")
    rows = kept.groupBy("rule_id", "rule_text").agg(F.array_sort(F.collect_list(F.struct("at", "feedback_id"))).alias("m"))
    return rows.filter(F.size("m") >= least).select("rule_id", "rule_text", F.col("m.feedback_id").alias("matched_feedback_ids"))


def regenerate(rows: DataFrame, complete: Callable[[str, str], str], least: int = K.REJECTION_THRESHOLD) -> DataFrame | None:
    """The new rules, or None where the old ones stay: too few rejections, or a failed call. rows: eligible feedback.
    This is one question to the service about all rejections, so they come together here."""
    found = rows.select(F.col("feedback_id").alias("id"), "issue_type", "original_text", "suggestion", "reason").collect()
    if len(found) < least:
        return None
    system = (Path(__file__).parent / "prompts" / "feedback.md").read_text(encoding="utf-8").replace("{threshold}", str(least))
    try:
        got = json_array(complete(system, json.dumps([r.asDict() for r in found], ensure_ascii=False)))
    except (CallError, ReplyError):
        return None
    ids, out = {r["id"] for r in found}, []
    for x in got:
        named = x.get("matched_feedback_ids") if isinstance(x, dict) else None
        text = x.get("rule_text") if isinstance(x, dict) else None
        known = [i for i in named if type(i) is int and i in ids] if isinstance(named, list) else []
        if isinstance(text, str) and text.strip() and len(known) >= least:
            out.append((text.strip(), known))
    return rows.sparkSession.createDataFrame(out, RULE)


def rules_text(rules: DataFrame) -> str:
    """The rules as lines for a prompt."""
    return "\n".join(f"- {r['rule_text']}" for r in rules.orderBy("rule_id").collect())


def last_turns(history: DataFrame, ident: str = "issue_id", order: str = "turn", n: int = K.HISTORY_TURNS) -> DataFrame:
    """ident, transcript: the last n questions and answers of each, in order, one text."""
    rows = history.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct(order, "question", "answer"))).alias("h"))
    last = F.slice("h", F.greatest(F.size("h") - n + 1, F.lit(1)), n)
    line = lambda t: F.concat(F.lit("Q: "), t.question, F.lit("\nA: "), t.answer)
    return rows.select(ident, F.array_join(F.transform(last, line), "\n").alias("transcript"), F.size("h").alias("turns"))


def followup_prompt(issue: dict, question: str, transcript: str = "") -> tuple[str, str]:
    system = (Path(__file__).parent / "prompts" / "followup.md").read_text(encoding="utf-8")
    about = "\n".join(f"{k}: {issue.get(k) or ''}" for k in ("original_text", "issue_type", "layer", "suggestion", "context_snippet"))
    return system, "\n\n".join(x for x in (about, transcript, f"Q: {question}") if x)
