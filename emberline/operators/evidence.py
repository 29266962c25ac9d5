"""Evidence blocks and reference lists from ranked hits.

Every group here is one question with at most ten hits, so windows per question are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.numbers import fixed

# Lengths and formats of the evidence block.
EVIDENCE_ROWS = 10
SNIPPET_CHARS = 600
AUTHOR_CHARS_LIST = 50
AUTHOR_CHARS_ENTRY = 60
REFERENCES_HEAD = "\n\n---\n\n**参考文献：**"
QUESTION_LINE = "**用户问题：** %s\n"
EVIDENCE_LINE = "**相关文献证据：**\n%s\n"
GRAPH_LINE = "**知识图谱信息：**\n%s\n"
REASONING_LINE = "**推理分析：**\n%s\n"
NO_EVIDENCE_LINE = "（未检索到直接相关的文献证据，请基于你的专业知识回答，并说明需要进一步查阅文献。）"
TYPE_LABELS = {
    "factual": "事实查询",
    "process": "工艺流程",
    "comparison": "对比分析",
    "causal": "因果推理",
    "recommendation": "方案推荐",
}


def first_per_section(hits: DataFrame) -> DataFrame:
    """The first hit per (question, paper, section) by rank, then at most ten, in ``evidence_pos``."""
    section = Window.partitionBy("question_id", "paper_id", "section").orderBy("rank")
    order = Window.partitionBy("question_id").orderBy("rank")
    return (
        hits.withColumn("_n", F.row_number().over(section))
        .where("_n = 1")
        .withColumn("evidence_pos", F.row_number().over(order))
        .where(F.col("evidence_pos") <= EVIDENCE_ROWS)
        .drop("_n")
    )


def number_references(evidence: DataFrame) -> DataFrame:
    """Reference numbers by first appearance of the paper, 1..n without gaps."""
    paper = Window.partitionBy("question_id", "paper_id")
    order = Window.partitionBy("question_id").orderBy("_first")
    return (
        evidence.withColumn("_first", F.min("evidence_pos").over(paper))
        .withColumn("ref_num", F.dense_rank().over(order))
        .drop("_first")
    )


def reference_list(numbered: DataFrame) -> DataFrame:
    """One row per question and reference number, with the metadata of the first hit."""
    return numbered.groupBy("question_id", "ref_num").agg(
        *[F.min_by(c, "evidence_pos").alias(c) for c in ("paper_id", "title", "year", "authors", "category")]
    )


def shorten(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(" et al."))).otherwise(text)


def _year(year: Column) -> Column:
    known = year.isNotNull() & (year != 0)
    return F.when(known, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(F.lit(""))


def reference_line(num: Column, authors: Column, title: Column, year: Column) -> Column:
    return F.concat(
        F.lit("["), num.cast("string"), F.lit("] "), shorten(authors, AUTHOR_CHARS_LIST),
        F.lit('. "'), title, F.lit('"'), _year(year),
    )


def reference_entry(num: Column, authors: Column, title: Column, year: Column, category: Column) -> Column:
    """The longer entry: 60 characters of authors, and the category when there is one."""
    tail = F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit(" ["), category, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("["), num.cast("string"), F.lit("] "), shorten(authors, AUTHOR_CHARS_ENTRY),
        F.lit('. "'), title, F.lit('"'), _year(year), tail,
    )


def _joined(order: str, text: Column, separator: str) -> Column:
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("_text"))))
    return F.array_join(F.transform(pieces, lambda p: p["_text"]), separator)


def evidence_text(numbered: DataFrame) -> DataFrame:
    """One evidence block per question: ``[n] (section) first 600 characters``."""
    line = F.concat(
        F.lit("["), F.col("ref_num").cast("string"), F.lit("] ("), F.col("section"), F.lit(") "),
        F.left(F.col("text"), F.lit(SNIPPET_CHARS)),
    )
    return numbered.groupBy("question_id").agg(_joined("evidence_pos", line, "\n\n").alias("evidence_text"))


def references_text(references: DataFrame) -> DataFrame:
    line = reference_line(F.col("ref_num"), F.col("authors"), F.col("title"), F.col("year"))
    body = references.groupBy("question_id").agg(_joined("ref_num", line, "\n").alias("_body"))
    return body.select("question_id", F.concat_ws("\n", F.lit(REFERENCES_HEAD), F.col("_body")).alias("references_text"))


def answer_prompt(question: Column, evidence: Column, graph: Column, reasoning: Column) -> Column:
    """The user part of an answer prompt; blocks without content are left out."""

    def block(template: str, value: Column) -> Column:
        head, tail = template.split("%s")
        text = F.coalesce(value, F.lit(""))
        return F.when(text != "", F.concat(F.lit(head), text, F.lit(tail)))

    head, tail = QUESTION_LINE.split("%s")
    nothing = (F.coalesce(evidence, F.lit("")) == "") & (F.coalesce(graph, F.lit("")) == "")
    return F.concat_ws(
        "\n",
        F.concat(F.lit(head), question, F.lit(tail)),
        block(EVIDENCE_LINE, evidence),
        block(GRAPH_LINE, graph),
        block(REASONING_LINE, reasoning),
        F.when(nothing, F.lit(NO_EVIDENCE_LINE)),
    )


def score_display(score: Column) -> Column:
    """A percentage up to 1, two decimals above."""
    return F.when(score <= 1, F.concat(fixed(score * 100, 0), F.lit("%"))).otherwise(fixed(score, 2))


def hit_summary(hits: DataFrame, shown: int = 5) -> DataFrame:
    """Summary lines per question: the first five hits, then how many more there are."""
    line = F.concat(
        F.lit("> - ["), F.col("rank").cast("string"), F.lit("] "), F.left(F.col("title"), F.lit(60)), F.lit(" ("),
        F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise(F.lit("?")),
        F.lit(") -- 相关度 "), score_display(F.col("score")),
    )
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", line.alias("_text")))))
    return hits.groupBy("question_id").agg(
        F.count("*").alias("n"), F.array_join(F.transform(first, lambda p: p["_text"]), "\n").alias("_lines")
    ).select(
        "question_id",
        F.concat_ws(
            "\n",
            "_lines",
            F.when(F.col("n") > shown, F.concat(F.lit("> - ... 及其他 "), (F.col("n") - shown).cast("string"), F.lit(" 条"))),
        ).alias("summary"),
    )
