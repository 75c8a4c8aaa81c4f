"""Accepted findings of a record as rows, and as a workbook written with the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley import constants as K
from galley.functions import text as T

COLUMNS = ("page_location", "original_text", "issue_type", "priority", "layer", "suggestion", "status", "note")
# Headings and fills of the sheet, and the end of its name.
HEADINGS = ("页码/位置", "原文", "问题类型", "优先级", "分层标注", "修改建议", "处理状态", "批注")
RED, YELLOW, SUFFIX, UNNAMED = "FFFFC7CE", "FFFFF2CC", "_校对清单.xlsx", "未命名文档"


def accepted(issues: DataFrame) -> DataFrame:
    """record_id, the sheet's columns and fill of accepted issues; order by issue_id for one record's sheet."""
    fill = F.when(F.col("priority") == K.HIGH, RED).when(F.col("layer") == K.QUOTATION, YELLOW)
    filled = {"page_location": F.coalesce("page_location", F.lit(K.UNLOCATED)), "note": F.coalesce("note", F.lit(""))}
    return issues.filter(F.col("status") == K.ACCEPTED).withColumns(filled).select("record_id", "issue_id", *COLUMNS, fill.alias("fill"))


def workbook(rows: list, headings=HEADINGS, columns=COLUMNS) -> bytes:
    """An .xlsx file with one sheet; rows have the columns and fill."""
    styles = [None, RED, YELLOW]
    cell = lambda v: f"<v>{v}</v>" if isinstance(v, int) else f'<is><t xml:space="preserve">{escape(clean(v))}</t></is>'
    kind = lambda v: "" if isinstance(v, int) else ' t="inlineStr"'
    clean = lambda v: "".join(c for c in str(v if v is not None else "") if c >= " " or c in "\t\n\r")
    name = lambda i: chr(65 + i)
    lines = [(headings, 0), *(([r[c] for c in columns], styles.index(r["fill"])) for r in rows)]
    body = "".join(f'<row r="{n}">' + "".join(f'<c r="{name(i)}{n}" s="{s}"{kind(v)}>{cell(v)}</c>' for i, v in enumerate(values)) + "</row>" for n, (values, s) in enumerate(lines, 1))
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in (RED, YELLOW))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, content = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{content}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{content}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{content}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="issues" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fillId="2" applyFill="1"/><xf fillId="3" applyFill="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def export_record(issues: DataFrame, records: DataFrame, record_id: int) -> bytes:
    """The workbook of one record: one sheet, so its rows come to the driver. An unknown record is an error."""
    if records.filter(F.col("record_id") == record_id).isEmpty():
        raise ValueError(f"no record {record_id}")
    return workbook(accepted(issues.filter(F.col("record_id") == record_id)).orderBy("issue_id").collect())


def file_name(doc_name: str | Column, at: str | Column) -> Column:
    """The name of a record's sheet: time of writing, document, suffix."""
    name = T.file_name(F.coalesce(F.when(T.col(doc_name) != "", T.col(doc_name)), F.lit(UNNAMED)))
    return F.concat(F.date_format(T.col(at), "yyyyMMddHHmmss"), F.lit("_"), name, F.lit(SUFFIX))


def export_to(workspace, record_id: int, folder: str, at) -> str:
    """Write the workbook of one record into a folder that Spark can write to, note its path in the record, and remove
    what retention no longer keeps there. Returns the path."""
    spark = workspace.spark
    data = export_record(workspace.read("issues"), workspace.read("records"), record_id)
    row = workspace.read("records").filter(F.col("record_id") == record_id).select(file_name("doc_name", F.lit(at).cast("timestamp_ntz")).alias("n")).first()
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder.rstrip('/')}/{row['n']}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(data)
    out.close()
    files = [(f.getModificationTime(), f.getPath().getName(), f.getPath()) for f in fs.listStatus(path.getParent()) if f.isFile()]
    for _, name, old in sorted(files, key=lambda x: x[:2], reverse=True)[K.KEEP_FILES :]:
        if name != row["n"]:
            fs.delete(old, False)
    workspace.change("records", record_id, result_path=str(path))
    return str(path)


def surplus(files: DataFrame, group: list[str], keep: int = K.KEEP_FILES) -> DataFrame:
    """Files that retention removes: all but the newest of each group. files: path, modified."""
    w = Window.partitionBy(*group).orderBy(F.col("modified").desc(), F.col("path").desc())
    return files.withColumn("n", F.row_number().over(w)).filter(F.col("n") > keep).drop("n")
