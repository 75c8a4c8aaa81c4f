"""Expressions on literals: full-width marks, variants, look-alikes."""

import pytest
from pyspark.sql import functions as F

from galley.functions import lookalike as L
from galley.functions import text as T


def value(spark, column, **given):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("1997 年通车的广深高速", "1997年通车的广深高速"), ("AI Agent 与 BOM", "AI Agent与BOM"), ("depart-\nment", "department"), ("a  b  c", "a b c"), ("  字　符 ", "字符"), ("", ""), (None, None)],
)
def test_normalised(spark, text, want):
    assert value(spark, T.normalised(F.lit(text).cast("string"))) == want


def test_unreadable_clause(spark):
    text = "第一句完全正常。第二句有个□读不出的字。第三句也完全正常。"
    assert value(spark, T.without_unreadable("t"), t=text) == "第一句完全正常。第三句也完全正常。"
    assert value(spark, T.without_unreadable("t"), t="只有□") == ""


def test_quotes_are_pairs_from_the_left(spark):
    assert value(spark, T.longest_quote("t"), t='"ab" between the pairs "cd"') == 2
    assert value(spark, T.longest_quote("t"), t="他说“一二三四五六七八九十”了") == 10
    assert value(spark, T.longest_quote("t"), t="") == 0


def test_classical(spark):
    assert value(spark, T.classical("t"), t="学而时习之不亦说乎")
    assert not value(spark, T.classical("t"), t="总之如此")


def test_folded(spark):
    assert value(spark, T.folded("t"), t="⽉⻔⼾a") == "月门户a"


@pytest.mark.parametrize(
    ("original", "suggestion", "want"),
    [
        ("能⼒很强", "应改为“能力很强”", True),
        ("数⼦化", "应改为“数字化”", False),
        ("归⺟扣⾮净利润", "“⺟”应改为“母”", True),
        ("能⼒，直接决定", "应改为“能力”", True),
        ("ＡＢ", "应改为“AB”", True),
        ("面对们", "应改为“面对面”", False),
        ("", "应改为“x”", False),
        ("abc", None, False),
    ],
)
def test_changes_nothing(original, suggestion, want):
    assert L.changes_nothing(original, suggestion) is want


def test_changes_space():
    assert L.changes_space("2 0 2 5年9⽉", "2025年9月")
    assert not L.changes_space("2025年", "2026年")


def test_empty_changes_leave_a_reason():
    assert L.without_empty_changes("标点不统一，应为“4.”，且“⼊表”应为“入表”") == "标点不统一，应为“4.”"


def test_years_and_controls(spark):
    assert value(spark, T.years("t"), t="1998年到２０２７,2027") == [1998, 2027]
    assert value(spark, T.stray_controls("t"), t="a\x01b") and not value(spark, T.stray_controls("t"), t="a\tb\nc")


def test_blocks_are_those_of_difflib(monkeypatch):
    import difflib
    import random

    from galley.functions import alignment

    draw = random.Random(7)
    # all ways of search on texts for which difflib is quick enough
    for small, long, short in ((512, 1500, 64), (0, 1500, 0), (0, 0, 0), (0, 0, 64), (20, 10, 3)):
        monkeypatch.setattr(alignment, "SMALL", small)
        monkeypatch.setattr(alignment, "LONG", long)
        monkeypatch.setattr(alignment, "SHORT", short)
        for k in range(120):
            letters = "abcdefghijklmnop"[: draw.choice((1, 2, 4, 16))]
            a = "".join(draw.choices(letters, k=draw.randrange(90))) * draw.choice((1, 1, 3))
            b = list(a) if k % 2 else draw.choices(letters + "#", k=draw.randrange(90))
            for _ in range(draw.randrange(12)):
                at = draw.randrange(len(b) + 1)
                b[at : at + draw.randrange(3)] = draw.choices(letters + "#字", k=draw.randrange(3))
            b = "".join(b)
            merged = []
            for i, j, n in alignment.blocks(a, b):
                if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                    i, j, n = merged[-1][0], merged[-1][1], merged.pop()[2] + n
                merged.append((i, j, n))
            want = [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
            assert merged == want, (a, b, small, long, short)
