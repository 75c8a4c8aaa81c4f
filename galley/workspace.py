"""The review workspace: tasks, records, issues, feedback and learned rules as tables.

Rows are never changed in place: inserts and changes append, changes as events (key, seq, field, value), and a view
takes the last value of each field. Small tables that are replaced as a whole are overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from galley import constants as K
from galley.operators.classify import stats
from galley.operators.feedback import followup_prompt, with_source
from galley.operators.locate import context

TURN = "struct<question:string,answer:string,asked_at:timestamp_ntz>"
SCHEMAS = {
    "tasks": "task_id bigint, name string, description string, status string, created_at timestamp_ntz, created_by string",
    "records": "record_id bigint, task_id bigint, author string, created_at timestamp_ntz, doc_name string, doc_version string, task_type string, total_issues bigint, count_confirmed bigint, count_doubtful bigint, count_quotation bigint, count_optional bigint, high_priority_count bigint, accepted_count bigint, rejected_count bigint, result_path string, mode string",
    "issues": f"issue_id bigint, record_id bigint, page_location string, original_text string, formatted_text string, issue_type string, priority string, layer string, suggestion string, status string, note string, context_snippet string, followup_history array<{TURN}>, reason string, layer_notes array<string>, block_index int, chunk_index int",
    "feedback": "feedback_id bigint, created_at timestamp_ntz, issue_type string, original_text string, suggestion string, reason string, source_issue_id bigint, source_record_id bigint",
    "feedback_rules": "rule_id bigint, rule_text string, matched_feedback_ids array<bigint>, created_at timestamp_ntz",
    "events": "tbl string, id bigint, seq bigint, field string, value string",
}
KEYS = {"tasks": "task_id", "records": "record_id", "issues": "issue_id", "feedback": "feedback_id", "feedback_rules": "rule_id"}
CHANGEABLE = {
    "tasks": ("status",),
    "records": ("task_id", "total_issues", "count_confirmed", "count_doubtful", "count_quotation", "count_optional", "high_priority_count", "result_path", "mode"),
    "issues": ("status", "note"),
}


def latest(events: DataFrame, key: list[str], field: str = "field", order: str = "seq", value: str = "value") -> DataFrame:
    """The last value of each field of each key."""
    return events.groupBy(*key, field).agg(F.max_by(value, order).alias(value))


def authors(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """name of everyone who made a task or a record."""
    names = tasks.select(F.col("created_by").alias("name")).union(records.select("author"))
    return names.filter("name IS NOT NULL AND name <> ''").distinct().orderBy("name")


def decided(issues: DataFrame, key: str = "record_id") -> DataFrame:
    return issues.groupBy(key).agg(F.count_if(F.col("status") == K.ACCEPTED).alias("accepted_count"), F.count_if(F.col("status") == K.REJECTED).alias("rejected_count"))


def dangling(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Records that name a task that does not exist."""
    return records.filter("task_id IS NOT NULL").join(tasks.select("task_id"), "task_id", "left_anti")


def open_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that are not closed."""
    return tasks.filter(F.col("status") != K.STATUSES_TASK[2])


def same_names(tasks: DataFrame) -> DataFrame:
    """name, n: names, without white space around them, that several open tasks have."""
    return open_tasks(tasks).groupBy(F.trim("name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def upgraded(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of older shapes brought to the present ones: renamed notes, added columns, new layer names, a dropped page
    column, and records without a task put into one for old records. Running it again changes nothing."""
    out = dict(tables)
    issues = out["issues"]
    if "reject_reason" in issues.columns and "note" not in issues.columns:
        issues = issues.withColumnRenamed("reject_reason", "note")
    out["issues"] = issues.replace(K.OLD_LAYERS, subset=["layer"]).drop("doc_page")
    for table, names in (("records", ("mode", "task_id", "author")), ("tasks", ("created_by",))):
        for name in names:
            if name not in out[table].columns:
                out[table] = out[table].withColumn(name, F.lit(None).cast("bigint" if name.endswith("_id") else "string"))
    loose = out["records"].filter("task_id IS NULL")
    if not loose.isEmpty():
        spark = loose.sparkSession
        old = out["tasks"].filter(F.col("name") == K.LEGACY_TASK).agg(F.min("task_id")).first()[0]
        if old is None:
            old = (out["tasks"].agg(F.max("task_id")).first()[0] or 0) + 1
            row = spark.range(1).select(F.lit(old).cast("bigint").alias("task_id"), F.lit(K.LEGACY_TASK).alias("name"), F.lit(K.STATUSES_TASK[0]).alias("status"))
            out["tasks"] = out["tasks"].unionByName(row, allowMissingColumns=True)
        out["records"] = out["records"].withColumn("task_id", F.coalesce("task_id", F.lit(old).cast("bigint")))
    return out


class Workspace:
    """Tables under one folder. One writer at a time; each insert is one commit of whole rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in SCHEMAS.items():
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        """The table with all changes."""
        rows, key = self.base(name), KEYS[name]
        mine = self.base("events").filter(F.col("tbl") == name)
        last = latest(mine, ["id"])
        gone = last.filter("field = 'deleted'").select(F.col("id").alias(key))
        fields = CHANGEABLE.get(name, ())
        if fields:
            wide = last.groupBy(F.col("id").alias(key)).agg(*(F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"__{f}") for f in fields))
            rows = rows.join(wide, key, "left")
            types = dict(rows.dtypes)
            rows = rows.withColumns({f: F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.value").cast(types[f])).otherwise(F.col(f)) for f in fields}).drop(*(f"__{f}" for f in fields))
        return rows.join(gone, key, "left_anti")

    def next_id(self, name: str) -> int:
        return (self.base(name).agg(F.max(KEYS[name])).first()[0] or 0) + 1

    def insert(self, name: str, rows: DataFrame, order: str | None = None, ident: bool = False) -> range:
        """Append rows in one commit, with ids that follow each other in order; returns the ids. Rows are sorted and
        numbered by partition: each partition's first number comes from the counts of those before it. With ident, rows
        bring their ids."""
        first, columns = self.next_id(name), self.base(name).columns
        if ident:
            self.spark.createDataFrame([], SCHEMAS[name]).unionByName(rows, allowMissingColumns=True).select(*columns).write.mode("append").parquet(f"{self.path}/{name}")
            return range(0)
        place, part = "__place", "__part"
        laid = rows.orderBy(order) if order else rows
        path = f"{self.path}/_staged-{uuid.uuid4().hex}"
        laid.withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
        staged = self.spark.read.parquet(path).withColumn(part, F.shiftright(place, 33))
        counts, ids, before = staged.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect(), {}, first
        for r in counts:
            ids[r[part]], before = before, before + r["n"]
        at = F.element_at(F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)), F.col(part)) if ids else F.lit(first)
        number = (at + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")
        full = self.spark.createDataFrame([], SCHEMAS[name]).unionByName(staged.withColumn(KEYS[name], number).drop(place, part), allowMissingColumns=True).select(*columns)
        full.write.mode("append").parquet(f"{self.path}/{name}")
        self._remove(path)
        return range(first, before)

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def change(self, name: str, ident: int, **fields) -> None:
        """Set fields of one row; fields that may not change, and rows that do not exist, are errors."""
        if bad := [f for f in fields if f not in CHANGEABLE.get(name, ())]:
            raise ValueError(f"{name} has no changeable {', '.join(bad)}")
        if self.read(name).filter(F.col(KEYS[name]) == ident).isEmpty():
            raise ValueError(f"no row {ident} in {name}")
        self._event(name, ident, fields)

    def delete(self, name: str, ident: int) -> None:
        self._event(name, ident, {"deleted": "true"})

    def _event(self, name: str, ident: int, fields: dict) -> None:
        seq = (self.base("events").agg(F.max("seq")).first()[0] or 0) + 1
        rows = [(name, ident, seq, f, None if v is None else str(v)) for f, v in fields.items()]
        self.spark.createDataFrame(rows, SCHEMAS["events"]).write.mode("append").parquet(f"{self.path}/events")

    def create_task(self, name: str, created_at, description: str = "", created_by: str | None = None) -> int:
        row = self.spark.createDataFrame([(name, description, K.STATUSES_TASK[0], created_at, created_by)], "name string, description string, status string, created_at timestamp_ntz, created_by string")
        return self.insert("tasks", row)[0]

    def tasks(self, status: str | None = None, closed: bool = False) -> DataFrame:
        """Newest first; closed tasks only if asked for."""
        rows = self.read("tasks")
        rows = rows.filter(F.col("status") == status) if status else rows
        rows = rows if closed or status else open_tasks(rows)
        return rows.orderBy(F.col("created_at").desc(), F.col("task_id").desc())

    def _one(self, name: str, ident: int) -> Row | None:
        return self.read(name).filter(F.col(KEYS[name]) == ident).first()

    def task(self, task_id: int) -> Row | None:
        """The task, or None."""
        return self._one("tasks", task_id)

    def entered(self, task_id: int | None) -> Row | None:
        """The task that work goes on in: None without one, where it is gone, or where it is closed."""
        task = None if task_id is None else self.task(task_id)
        return task if task and task["status"] != K.STATUSES_TASK[2] else None

    def issue(self, issue_id: int) -> Row | None:
        """The issue with all changes, or None."""
        return self._one("issues", issue_id)

    def feedback(self) -> DataFrame:
        """Rejections, newest first, with the kind of the record that they come from."""
        rows = with_source(self.read("feedback"), self.base("records"))
        return rows.orderBy(F.col("created_at").desc(), F.col("feedback_id").desc())

    def duplicate_names(self, name: str) -> DataFrame:
        return open_tasks(self.read("tasks")).filter(F.trim("name") == name.strip())

    def issues(self, record_id: int, layer: str | None = None) -> DataFrame:
        rows = self.read("issues").filter(F.col("record_id") == record_id)
        return (rows.filter(F.col("layer") == layer) if layer else rows).orderBy("issue_id")

    def records(self, task_id: int | None = None) -> DataFrame:
        """Newest first, with counts of decisions taken from the issues."""
        rows = self.read("records").drop("accepted_count", "rejected_count")
        rows = rows.filter(F.col("task_id") == task_id) if task_id is not None else rows
        counts = decided(self.read("issues"))
        return rows.join(counts, "record_id", "left").fillna(0, ["accepted_count", "rejected_count"]).orderBy(F.col("created_at").desc(), F.col("record_id").desc())

    def records_by_task(self) -> DataFrame:
        return self.read("records").filter("task_id IS NOT NULL").groupBy("task_id").agg(F.count("*").alias("n_records"))

    def persist(self, record: DataFrame, issues: DataFrame, order: str = "seq", blocks: DataFrame | None = None) -> tuple[int, range]:
        """One record with its figures and its issues, pending; issue ids follow the order. With blocks (block_index, text)
        of the document each issue that has a place gets the text around it. The record is written last, so that readers
        never see one without its issues: issues of an id without a record are those of a run that broke off, and the
        next record takes another id."""
        record_id = max(self.next_id("records"), (self.base("issues").agg(F.max("record_id")).first()[0] or 0) + 1)
        rows = issues.withColumn("record_id", F.lit(record_id).cast("bigint")).withColumn("status", F.lit(K.PENDING))
        if blocks is not None:
            around = context(blocks.withColumn("doc_id", F.lit(0))).select("block_index", F.col("snippet").alias("context_snippet"))
            rows = rows.drop("context_snippet").join(around, "block_index", "left")
        ids = self.insert("issues", rows, order)
        mine = self.base("issues").filter(F.col("record_id") == record_id)
        figures = stats(mine, "record_id").collect()
        names = CHANGEABLE["records"][1:7]
        found = figures[0].asDict() if figures else dict.fromkeys(names, 0)
        self.insert("records", record.withColumns({n: F.lit(found[n]).cast("bigint") for n in names}).withColumn("record_id", F.lit(record_id).cast("bigint")), ident=True)
        return record_id, ids

    def persist_comparison(self, record: DataFrame, diffs: DataFrame, blocks: DataFrame | None = None) -> tuple[int, range]:
        """The differences of a pair (as `compare.diffs` gives them) as the issues of a record of a comparison: all in one
        layer and of one priority."""
        rows = diffs.withColumn("issue_type", F.col("diff_type")).withColumn("priority", F.lit(K.MEDIUM))
        return self.persist(record.withColumn("task_type", F.lit(K.RECORD_COMPARE)), rows, "seq", blocks)

    def decide(self, issue_id: int, status: str, at, reason: str = "") -> None:
        """Set an issue's status; a rejection is remembered as feedback with a copy of the issue."""
        self.change("issues", issue_id, status=status)
        if status == K.REJECTED:
            issue = self.read("issues").filter(F.col("issue_id") == issue_id)
            copy = issue.select(F.lit(at).cast("timestamp_ntz").alias("created_at"), "issue_type", "original_text", "suggestion", F.coalesce(F.nullif(F.lit(reason), F.lit("")), "reason", F.lit("")).alias("reason"), F.col("issue_id").alias("source_issue_id"), F.col("record_id").alias("source_record_id"))
            self.insert("feedback", copy)

    def forget(self, feedback_id: int) -> None:
        """Take a rejection back."""
        self.delete("feedback", feedback_id)

    def move(self, record_id: int, task_id: int) -> None:
        """Put a record into another task, which must exist and not be closed."""
        if self.read("tasks").filter((F.col("task_id") == task_id) & (F.col("status") != K.STATUSES_TASK[2])).isEmpty():
            raise ValueError(f"no open task {task_id}")
        self.change("records", record_id, task_id=task_id)

    def history(self, issue_id: int) -> list[dict]:
        """Questions and answers about an issue, oldest first; an unknown issue is an error."""
        if self.read("issues").filter(F.col("issue_id") == issue_id).isEmpty():
            raise ValueError(f"no row {issue_id} in issues")
        turns = self.base("events").filter((F.col("tbl") == "turns") & (F.col("id") == issue_id)).orderBy("seq").collect()
        return [json.loads(r["value"]) for r in turns]

    def ask(self, issue_id: int, question: str, complete, at) -> str:
        """Answer a question about an issue with its text, what stands around it and the last turns; question and answer
        are stored once there is an answer. Nothing else about the issue changes."""
        before = self.history(issue_id)
        issue = self.read("issues").filter(F.col("issue_id") == issue_id).first().asDict()
        told = "\n".join(f"Q: {t['question']}\nA: {t['answer']}" for t in before[-K.HISTORY_TURNS :])
        answer = complete(*followup_prompt(issue, question, told))
        self._event("turns", issue_id, {"turn": json.dumps({"question": question, "answer": answer, "asked_at": str(at)}, ensure_ascii=False)})
        return answer

    def rules(self) -> DataFrame:
        """The learned rules of the last replacement."""
        rows = self.base("feedback_rules")
        last = self.base("events").filter("tbl = 'feedback_rules' AND field = 'from'").agg(F.max_by("value", "seq")).first()[0]
        return rows.filter(F.col("rule_id") >= int(last or 0))

    def replace_rules(self, rules: DataFrame, created_at) -> None:
        """Put new rules in the place of the old ones: they are appended, then one event says from which id on rules count,
        so that readers see the old or the new ones, never none."""
        first = self.next_id("feedback_rules")
        self.insert("feedback_rules", rules.drop("created_at").withColumn("created_at", F.lit(created_at).cast("timestamp_ntz")))
        self._event("feedback_rules", 0, {"from": str(first)})

    def orphans(self) -> DataFrame:
        """Issues whose record does not exist."""
        return self.base("issues").join(self.base("records").select("record_id"), "record_id", "left_anti")


def layer_place(c: Column) -> Column:
    """The place of a layer in lists of findings."""
    out = F
    for i, name in enumerate(K.LAYERS):
        out = out.when(c == name, i)
    return out.otherwise(len(K.LAYERS))
