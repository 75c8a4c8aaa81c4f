"""The model stage: an injectable completion function mapped over chunks.

The function takes (system, user) and returns text. What it returns must not be asked for twice, so callers
write the stage's output before using it. Concurrency is the number of partitions, MAX_CALLS by default.
"""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley import constants as K
from galley.operators.locate import located, routed

FIELDS = ("original_text", "issue_type", "category", "confidence", "suggestion", "reason")
FINDING = "doc_id long, chunk_index int, item int, " + ", ".join(f"{f} string" for f in FIELDS) + ", error string"
FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL)
RETRY_HINT = "\n\nThe last answer could not be read. Answer with the JSON array alone."
NO_RULES = "（无）"
log = logging.getLogger(__name__)


class CallError(RuntimeError):
    """The service could not be reached or refused."""


class ReplyError(ValueError):
    """The reply is not a JSON array."""


def numbered_rules(text: str) -> dict[int, str]:
    """The rules of a text by number; a rule begins with **N. at a line's start and ends where the next begins."""
    marks = [(int(m[1]), m.start()) for m in re.finditer(r"^\*\*(\d+)\.", text, re.MULTILINE)]
    ends = [at for _, at in marks[1:]] + [len(text)]
    return {n: text[at:end].strip() for (n, at), end in zip(marks, ends, strict=True)}


def system_prompt(rules: str, mode: str = K.DEEP, learned: str = "", template: str | None = None) -> str:
    """The instructions for one run: all rules, or those of the simplified mode, and what rejections taught."""
    template = template or (Path(__file__).parent / "prompts" / "review.md").read_text(encoding="utf-8")
    chosen = rules if mode == K.DEEP else "\n\n".join(r for n, r in numbered_rules(rules).items() if n in K.SIMPLIFIED_RULES)
    values = {"rules": chosen, "learned": learned or NO_RULES, "overlap_mark": K.OVERLAP_MARK, "body_mark": K.BODY_MARK}
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template


def json_array(reply: str) -> list:
    found = FENCE.search(reply)
    try:
        out = json.loads(found[1] if found else reply.strip(), strict=False)
    except ValueError as e:
        raise ReplyError(str(e)) from e
    if not isinstance(out, list):
        raise ReplyError("not an array")
    return out


def valid(item) -> bool:
    texts = isinstance(item, dict) and all(isinstance(item.get(f), str) and item[f].strip() for f in FIELDS)
    return texts and item["category"] in K.CATEGORIES and item["confidence"] in K.CONFIDENCES


def retrying(send: Callable[[], tuple[int, dict, str]], retries: int = 3, waits=(1, 4, 16), sleep=time.sleep) -> str:
    """The body of a request's answer. send gives status, headers and body, or raises OSError. Lost connections, 429 and
    server errors are tried again after a wait, for 429 as long as the service asks; other refusals are final."""
    for attempt in range(retries + 1):
        wait = waits[min(attempt, len(waits) - 1)]
        try:
            status, headers, body = send()
        except OSError as e:
            why = str(e)
        else:
            if status == 200:
                return body
            why = f"status {status}: {body[:200]}"
            if status != 429 and status < 500:
                raise CallError(why)
            asked = headers.get("Retry-After", "") if status == 429 else ""
            wait = float(asked) if asked.replace(".", "", 1).isdigit() else wait
        log.warning("call %d of %d failed: %s", attempt + 1, retries + 1, why)
        if attempt < retries:
            sleep(wait)
    raise CallError(why)


def ask(complete: Callable[[str, str], str], system: str, user: str) -> list[dict]:
    """The valid items of a reply; an unreadable reply is asked for once more with a hint."""
    try:
        got = json_array(complete(system, user))
    except ReplyError:
        got = json_array(complete(system, user + RETRY_HINT))
    return [x for x in got if valid(x)]


def asked(chunks: DataFrame, complete: Callable[[str, str], str], system: str, calls: int = K.MAX_CALLS, progress: Accumulator | None = None) -> DataFrame:
    """One row for each item of each chunk, in order, or one with the error of a chunk that failed. progress, an
    accumulator, grows by one with each chunk asked, failed ones too."""

    def run(frames):
        for pdf in frames:
            rows = []
            for doc, at, text in zip(pdf["doc_id"], pdf["chunk_index"], pdf["text"], strict=True):
                try:
                    items = ask(complete, system, text)
                except (CallError, ReplyError) as e:
                    rows.append((doc, at, -1, *[None] * len(FIELDS), f"{type(e).__name__}: {e}"))
                else:
                    rows += [(doc, at, i, *(x[f] for f in FIELDS), None) for i, x in enumerate(items)]
                if progress is not None:
                    progress.add(1)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FINDING.split(", ")])

    return chunks.select("doc_id", "chunk_index", "text").repartition(calls).mapInPandas(run, FINDING)


def findings(answers: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Written answers as a findings table: those of the overlap dropped, the others located in their chunk's blocks."""
    items = answers.filter("error IS NULL").withColumn("snippet", F.col("original_text"))
    kept = routed(items, chunks).filter("route <> 'drop'").withColumn("ord", F.col("chunk_index").cast("long") * 1_000_000 + F.col("item"))
    parts = chunks.select("doc_id", "chunk_index", F.posexplode("block_indices").alias("at", "block_index"))
    mine = parts.join(blocks.select("doc_id", "block_index", "text", "source_location"), ["doc_id", "block_index"])
    hits = located(kept.filter("route = 'body'"), mine, ["doc_id", "chunk_index"], "ord")
    place = blocks.select("doc_id", "block_index", F.col("source_location").alias("page_location"))
    out = kept.join(hits.select("doc_id", "chunk_index", "ord", "block_index"), ["doc_id", "chunk_index", "ord"], "left").join(place, ["doc_id", "block_index"], "left")
    return out.withColumn("located", F.col("block_index").isNotNull()).drop("snippet", "route", "item", "error")
