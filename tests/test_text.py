"""Goldens for text rules whose content the tables lack, and chunks against a plain restatement."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import jsontext as js
from emberline.functions import text as tx
from emberline.functions import transcript as tr
from emberline.functions.numbers import fixed
from emberline.operators import sections as sc
from emberline.sources.glossary import Confusion, Glossary


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def sections_of(spark, *pages):
    rows = spark.createDataFrame([(1, list(pages))], "paper_id long, pages array<string>")
    return sc.with_sections(rows).first()["sections"]


def test_text_before_the_first_heading(spark):
    short = sections_of(spark, "x" * 149 + "\nAbstract\nbody")
    assert [s["title"] for s in short] == ["Abstract"]
    long = sections_of(spark, "x" * 200 + "\nAbstract\nbody")
    assert [s["title"] for s in long] == ["Preamble", "Abstract"]


def test_heading_is_a_prefix_match(spark):
    got = sections_of(spark, "Results show a trend\n1. introduction\n2 Methods and more")
    assert [s["title"] for s in got] == ["Results", "1. introduction", "2 Methods"]


def test_no_heading_gives_full_text(spark):
    got = sections_of(spark, " plain ", "second")
    assert [(s["title"], s["text"], s["page_start"], s["page_end"]) for s in got] == [("Full Text", "plain \nsecond", 0, 1)]


def test_pages_of_sections(spark):
    got = sections_of(spark, "Abstract\naaa", "bbb\nMethods\nccc", "ddd")
    assert [(s["title"], s["page_start"], s["page_end"]) for s in got] == [("Abstract", 0, 1), ("Methods", 1, 2)]


def test_sections_cover_the_text_after_the_first_heading(spark):
    pages = ["Abstract\naaa\nResults and Discussion\nb", "c\nREFERENCES\n1", "x"]
    got = sections_of(spark, *pages)
    whole = "\n".join(pages)
    assert "".join(whole[s["start"] : s["stop"]] for s in got) == whole


def plain_chunks(text, size=2000, overlap=200):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for mark, keep in (("\n\n", 0), (". ", 1)):
                at = text.rfind(mark, start + size // 2, end)
                if at > start:
                    end = at + keep
                    break
        if text[start:end].strip():
            out.append(text[start:end].strip())
        start = end - overlap
    return out


def test_chunk_goldens(spark):
    unbroken = "a" * 3700
    parted = "b" * 1500 + "\n\n" + "c" * 1500
    got = values(spark, [unbroken, parted, " short ", ""], sc.chunk_text)
    assert [len(c) for c in got[0]] == [2000, 1900, 100]
    assert got[1][0] == "b" * 1500
    assert got[2] == [" short "] and got[3] == [""]


def test_chunks_equal_the_restatement(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        words = ["焦炭", "coke", "é", "\n\n", ". ", "😀", " ", "x" * 40, "a.b"]
        texts.append("".join(rng.choice(words) for _ in range(rng.randint(1, 2500))))
    assert values(spark, texts, sc.chunk_text) == [plain_chunks(t) for t in texts]


def test_year_and_title(spark):
    assert values(spark, ["Report 1920 and 2015", "in 2015", "12015x", "none"], tx.guess_year) == [None, 2015, 2015, None]
    title = lambda c: tx.guess_title(c, F.lit("/a/b/file.v2.pdf"))
    assert values(spark, ["Vol. 12 of the journal here\n\n  A title that is long enough \n", "short\n"], title) == [
        "A title that is long enough", "file.v2",
    ]


def test_category(spark):
    paths = ["/x/Coal blend paper/CSR/a.pdf", "/x/Coal blend paper/a.pdf", "/y/a.pdf", "/Coal blend papper/Q/r/a.pdf"]
    assert values(spark, paths, tx.path_category) == ["CSR", "uncategorized", "uncategorized", "Q"]


@pytest.mark.parametrize(
    "said, written",
    [("二零二四", "4"), ("十五", "15"), ("两百五", "205"), ("三万五千", "35000"), ("一", "一"), ("十", "10"), ("零", "零"),
     ("一二三四五六七", "一二三四五六七"), ("共二十吨和三百零五", "共20吨和305"), ("２０年", "20年"), ("一亿二千万", "1020000000000"), ("亿亿亿", "亿亿亿")],
)
def test_numerals(spark, said, written):
    got = values(spark, [said], tr.normal_numbers)[0]
    if said == "一亿二千万":  # units multiply what came before: (1 * 10^8 + 2000) * 10^4
        assert got == str((10**8 + 2000) * 10**4)
    else:
        assert got == written


def test_marks_and_spaces(spark):
    assert values(spark, ["3.5", "你好 , 世界", "好!!?", "今天天气不错"], tr.normal_marks) == ["3。5", "你好，世界", "好？", "今天天气不错。"]
    assert values(spark, ["今天天气不错"], lambda c: tr.normal_marks(c, True)) == ["今天天气不错"]
    assert values(spark, [" 焦 炭　质量  good  one "], tr.normal_spaces) == ["焦炭质量 good one"]


def test_ascii_names_and_literal_rule(spark):
    glossary = Glossary(rules=((r"\\b%\\b", "百分之"), ("(a)(b)", r"\2\1$")), ascii_names=(("hot coke", "HotCoke"),))
    got = values(spark, ["HOT-coke hotcoke xhot coke 5% ab", "hot . coke"], lambda c: tr.replace_terms(c, glossary))
    assert got == ["HotCoke HotCoke xhot coke 5% ba$", "HotCoke"]


def test_confusions_need_context(spark):
    glossary = Glossary(confusions=(Confusion(("焦碳", "焦炭"), "焦炭", ("高炉",)),))
    fix = lambda c: tr.resolve_confusions(c, F.lit(""), glossary)
    assert values(spark, ["焦碳好", "高炉焦碳", "焦炭和焦碳"], fix) == ["焦碳好", "高炉焦炭", "焦炭和焦炭"]
    assert values(spark, ["焦碳好"], lambda c: tr.resolve_confusions(c, F.lit("高炉"), glossary)) == ["焦炭好"]


def test_sentences_and_clauses(spark):
    got = values(spark, ["A b. C d! tail", "One. Two. ", "no end", "X.Y"], tx.sentences)
    assert [(g["complete"], g["rest"]) for g in got] == [(["A b.", "C d!"], "tail"), (["One.", "Two."], ""), ([], "no end"), ([], "X.Y")]
    got = values(spark, ["好，今天天气，不错", "ab,cd,ef,gh", "none"], tx.clauses)
    assert [(g["complete"], g["rest"]) for g in got] == [(["好，今天天气，"], "不错"), (["ab,cd,"], "ef,gh"), ([], "none")]


def test_json_replies(spark):
    got = values(spark, ['```json\n{"title": "T", "year": 2001}\n```', "oops"], lambda c: js.metadata(c, F.lit("First\nSecond")))
    assert [(g["title"], g["authors"], g["year"]) for g in got] == [("T", [], 2001), ("First", [], None)]
    assert values(spark, ['["a","b","c","d"]', "{}", "x"], js.follow_ups) == [["a", "b", "c"], [], []]


def test_fixed_follows_the_binary_value(spark):
    numbers = [929.25, 2.675, 0.5, 1234.5, 928.35]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i")
    assert [r[0] for r in rows.select(fixed(F.col("x"), 1)).collect()] == [f"{x:.1f}" for x in numbers]
    assert [r[0] for r in rows.select(fixed(F.col("x"), 2)).collect()] == [f"{x:.2f}" for x in numbers]


def test_harvest_at_any_depth():
    from emberline.functions.jsontext import harvest

    assert harvest('{"data": {"payload": [[{"items": [{"Utterance": " a "}, {"alternatives": [{"TRANSCRIPT": "b"}, "c", 3]}]}]], "text": 5}, "src": "a", "other": {"text": "no"}}') == "ab"
    assert harvest('[{"segments": {"sentence": "x y"}}, {"text": ["no"], "results": null}, {"text": "z"}]') == "x yz"
    assert harvest('{"text": "b", "result": {"text": "a"}, "nbest": [{"sentence": "c"}]}') == "bac"
    assert [harvest(x) for x in (None, "", "{", "3", '"text"', "[" * 100_000)] == [""] * 6
    deep = '{"data": ' * 400 + '{"text": "deep"}' + "}" * 400
    assert harvest(deep) == "deep"


def test_tasks_of_short_rows_are_set_by_their_number(spark, tmp_path):
    from emberline.session import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(rows).rdd.getNumPartitions() == cores == spread(rows, 10_000).rdd.getNumPartitions()
    assert spread(rows, 50).rdd.getNumPartitions() == 20 and spread(rows, 50).count() == 1000
    assert spread(spark.range(0, 100, 1, 30), 50).rdd.getNumPartitions() == 30
    assert spread(rows.where("id < 0"), 50).count() == 0


def test_strip_knows_all_unicode_space(spark):
    """As the pattern did that it replaces: every Basic Multilingual Plane character that Unicode calls space, and four controls."""
    odd = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rows = [(c + "a" + c + "b" + c,) for c in chars] + [(t,) for t in ("", " ", " \n", "a \n", "a\r\n ", "　\x85 a b  \n\n", None)]
    df = spark.createDataFrame(rows, "t string").select(tx.strip(F.col("t")).alias("got"), F.regexp_replace("t", odd, "").alias("want"))
    assert df.where("NOT got <=> want").count() == 0
    assert "regexp" not in df.select("got")._jdf.queryExecution().optimizedPlan().toString().split("want")[0]


def test_terms_are_looked_for_in_one_call_per_text(spark):
    from emberline.operators import tagging as tg

    rows = spark.createDataFrame([(1, "Über the CSR, csr; the zz"), (2, None), (3, ""), (4, "THE the über")], "doc_id long, text string")
    terms = ["the", "CSR", "über", "zz", "no"]
    found = tg.dictionary_entities(rows, "text", {"concepts": terms, "methods": ["the"]}).orderBy("doc_id")
    got = found.collect()
    assert [r["concepts"] for r in got] == [["über", "the", "CSR", "zz"], [], [], ["the", "über"]]
    assert got[0]["concept_relations"] == [["über", "the"], ["the", "CSR"], ["CSR", "zz"]] and got[1]["methods"] == []
    assert [r["t"] for r in rows.select("doc_id", tg.tags(F.col("text"), terms, 2).alias("t")).orderBy("doc_id").collect()] == [["CSR", "the"], [], [], ["the", "über"]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "locate" not in plan and "ArrowEvalPython" in plan
