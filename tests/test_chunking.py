import random

import pytest

from fernlode.operators import chunking
from pyspark.sql import functions as F


def test_hard_cut():
    got = chunking.chunk_text("长" * 900, "txt", most=400)
    assert [c[3] for c in got] == [0, 350, 700] and got[0][4] == 400


def test_paragraphs_pack():
    text = "\n\n".join(("甲" * 180, "乙" * 180, "丙" * 80))
    got = chunking.chunk_text(text, "txt", most=400)
    assert len(got) == 2 and all(text[a:b] in c for _, c, _, a, b in got)


def test_structure_path():
    text = "# 一级\n\n## 二级\n\n这一段写明借阅记录的保管方法，并且足够长，可以成为一块。\n\n```\n# no heading\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    got = chunking.chunk_text(text)
    assert len(got) == 1 and got[0][2] == "一级 > 二级" and got[0][1].startswith("一级 > 二级 > ")


def test_structureless_text_comes_once():
    text = "One paragraph that is long enough to be a chunk of its own, without any heading."
    assert [c[1] for c in chunking.chunk_text(text)] == [text]


def test_text_after_a_cut_sentence_keeps_its_offsets():
    text = "a" * 100 + "。" + "b" * 700 + "。" + "c" * 100 + "。"
    got = chunking.chunk_text(text, "txt", most=400)
    covered = set()
    for _, _, _, a, b in got:
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))


def test_table_repeats_its_head():
    text = "| 项目 | 收入 |\n| --- | --- |\n" + "".join(f"| 项目{i} | {i * 100} |\n" for i in range(60))
    got = chunking.chunk_text(text, target=200, hard_step=150, least=10)
    assert len(got) > 3 and all("| 项目 | 收入 |\n| --- | --- |" in c[1] and text[c[3] : c[4]].startswith("|") for c in got)


def test_offsets_and_cover_on_random_texts():
    rnd = random.Random(2)
    parts = ["# H\n", "## 二\n", "一、总则\n", "1.2 甲\n", "1.5倍以上\n", "词" * 50 + "。", "\n\n", "word " * 60 + "\n", "x" * 700, "| a | b |\n| - | - |\n", "```\ncode\n```\n"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        got = chunking.chunk_text(text)
        assert [c[0] for c in got] == list(range(len(got)))
        for _, body, _, a, b in got:
            assert 0 <= a < b <= len(text) and text[a:b] in body and b - a <= 700


def test_defined_results_for_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "md"), (2, "", "md"), (3, "  \n", None), (4, "short", "txt"), (None, "some text", "md")], "doc_id long, normalized_text string, fmt string")
    got = sorted((r.document_id or 0, r.text) for r in chunking.chunk_documents(docs).collect())
    assert got == [(0, "some text"), (4, "short")]


def test_line_level_equals_the_function(spark):
    lines = ["# a", "### b", "**第一章 总则**", "**bold**", "第一条 甲", "（一）乙", "5.5.1 丙", "1. 丁", "（1）戊", "①己", "1.5倍", "25岁", "plain", "", "一、庚"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in df.select(chunking.line_level(F.col("line"))).collect()]
    assert got == [(f := chunking.level_of(x)) and f[0] for x in lines]


@pytest.mark.parametrize(
    ("line", "level"),
    [("第一章 总则", 2), ("第千章", 2), ("一、总则", 3), ("第3条 范围", 4), ("（一）甲", 5), ("1.2 甲", 3), ("5.5.1.1 甲", 5), ("1．2 甲", 3), ("2024.1.1 x", None),
     ("1.5倍杠杆", None), ("2.0版", None), ("5.1 年后复查", 3), ("3. 甲", 6), ("3.14159265", None), ("（2）乙", 7), ("③丙", 8), ("第3条元", None), ("  ## 标题  ", 2), ("#标题", None),
     ("**第一章 总则**", 2), ("**1.5倍**", 2), ("**总则**", None), ("plain", None), ("", None), (None, None)],
)
def test_levels(spark, line, level):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(chunking.line_level(F.col("line"))).first()[0] == level
    if line is not None:
        found = chunking.level_of(line)
        assert (found[0] if found else None) == level


def test_a_quantity_is_no_clause_and_a_heading_no_preface():
    text = "\n".join(["前言段落，介绍文档背景信息，长度凑够三十个字符以上以便成块。", "", "# 第一章 总则", "", "1.5倍杠杆属于风险提示，不是条款编号，这句话也需要足够长度。", "", "## 第一节 范围", "", "本节内容正文，需要超过三十个字符才会被保留下来，继续补充一点内容。"])
    got = chunking.chunk_text(text)
    assert "第一章" not in got[0][1] and not any(c[2].split(" > ")[-1] == "1.5" for c in got)


def test_bold_lines_and_pdf_text(spark):
    lines = ["**一、 总则**", "**范围**", "** 3. 附录 **  ", "**是。**", "**x**", "a **b** c", "**第二章 甲乙**"]
    df = spark.createDataFrame([("\n".join(lines),), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(chunking.promote_bold(F.col("t"))).collect()]
    assert got == ["## 一、总则\n## 范围\n## 3.附录\n**是。**\n**x**\na **b** c\n## 第二章甲乙", None, ""]
    rows = [("以保 障\t和 a 中 文",), ("\n".join(["# 创 |"] * 4 + ["long enough line"] * 8),), ("创\n" * 10,)]
    df = spark.createDataFrame(rows, "t string")
    assert df.select(chunking.tidy_pdf(F.col("t"))).first()[0] == "以保障\t和 a 中文"
    assert [r[0] for r in df.select(chunking.broken_layout(F.col("t"))).collect()] == [False, True, False]
