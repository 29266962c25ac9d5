"""Glossary files, aliases by turns, and corrections by sound."""

import json

from pyspark.sql import functions as F

from emberline.functions import transcript as tr
from emberline.sources import glossary as gl


def test_wrong_entries_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"replacement_rules": [{"pattern": "x", "replace": "y"}, {"pattern": "("  , "replace": "z"}, {"pattern": "q"}], "hotwords": ["焦炭", " ", "coke"]}))
    (tmp_path / "b.json").write_text(json.dumps({"proper_nouns": {"a b": "AB", "焦": "煤", "": "n"}, "asr_confusions": [{"variants": ["甲"], "preferred": "乙"}, {"variants": [], "preferred": "丙"}, {"variants": ["丁"]}]}))
    (tmp_path / "c.json").write_text("not json")
    got = gl.load_glossary(gl.read_glossary_rows(spark, str(tmp_path)))
    assert got.rules == (("x", "y"),)
    assert got.names == (("焦", "煤"),) and got.ascii_names == (("a b", "AB"),)
    assert got.hotwords == ("焦炭", "coke")
    assert got.confusions == (gl.Confusion(("乙", "甲"), "乙", ()),)


def aliases_by_turns(words):
    peers = {}
    for group in gl.HOMOPHONE_GROUPS:
        for c in group:
            peers.setdefault(c, set()).update(set(group) - {c})
    peers = {c: sorted(p) for c, p in peers.items()}
    owner, shared = {}, set()
    for term in sorted(set(words), key=lambda w: (-len(w), w)):
        if not 2 <= len(term) <= 4:
            continue
        made = {term[:i] + p + term[i + 1 :] for i, c in enumerate(term) for p in peers.get(c, [])[:6]}
        if len(term) == 2:
            made |= {a + b for a in peers.get(term[0], [])[:4] for b in peers.get(term[1], [])[:4]}
        kept = 0
        for alias in sorted(made - set(words)):
            if kept == 12:
                break
            if alias not in owner:
                owner[alias] = term
                kept += 1
            else:
                shared.add(alias)
    out = {a: t for a, t in owner.items() if a not in shared}
    out.update({a: t for a, t in gl.KNOWN_ALIASES.items() if t in words})
    return out


def test_aliases_by_turns(spark):
    chars = "焦炭炼煤化油"
    words = [a + b for a in chars for b in chars if a != b] + ["煤焦油", "干熄焦", "捣固焦炉", "一二三四五", "焦碳"]
    rows = gl.hotword_aliases(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {r["alias"]: r["term"] for r in rows} == aliases_by_turns(words)


def test_corrections_by_sound(spark):
    syllables = dict(zip("焦交炭谈煤梅油由炉路高搞捣固", "jiao jiao tan tan mei mei you you lu lu gao gao dao gu".split()))
    hotwords = ("焦炭", "煤焦油", "高炉", "捣固焦炉", "梅油")
    index = tr.PhoneticIndex(hotwords, syllables)
    texts = ["交炭", "交谈", "梅焦油好", "捣固交路", "捣固交炉", "焦炭x交炭", "煤油"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    fix = lambda context: [
        r[0] for r in rows.select(tr.replace_by_sound(F.col("t"), F.lit(context), index, hotwords, ("领域",))).collect()
    ]
    # out of the domain only seed cues are corrected; two of four characters differ in 交路
    assert fix("") == ["焦炭", "交谈", "煤焦油好", "捣固交路", "捣固交炉", "焦炭x焦炭", "煤油"]
    assert fix("领域") == ["焦炭", "交谈", "煤焦油好", "捣固交路", "捣固焦炉", "焦炭x焦炭", "梅油"]


def test_mined_terms(spark):
    text = """a = [{ zh: "焦\\"炭", en: 'coke' }, {zh:'x' , en:"y\\nz"}, {zh: 3}]"""
    rows = gl.mine_terms(spark.createDataFrame([(1, text)], "id int, js string"), "js", "id").collect()
    assert [(r["zh"], r["en"]) for r in rows] == [('焦"炭', "coke"), ("x", "y\nz")]


def test_escapes_are_read_once(spark):
    text = r"""[{zh: "\u7126\u70ad", en: 'a\\n\tb\x41'}, {zh: "\ud83d\ude00 \u0022", en: "漢\q\'"}, {zh: "", en: "plain é"}]"""
    rows = gl.mine_terms(spark.createDataFrame([(1, text)], "id int, js string"), "js", "id").collect()
    assert [(r["zh"], r["en"]) for r in rows] == [("焦炭", "a\\n\tbA"), ('😀 "', "漢\\q'"), ("", "plain é")]
