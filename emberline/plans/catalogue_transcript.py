"""Named transcript queries and their SQL twins.

The tables hold no Chinese speech, so spoken texts are made from events: a sentence by event type, with
the event's numbers written as Chinese numerals.  The SQL twins state what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import transcript as tr
from emberline.functions.jsontext import harvested_text, transcript_text
from emberline.session import fresh_path, spread
from emberline.sources import glossary as gl
from emberline.sources.tables import documents, table

GLOSSARY = gl.Glossary(
    rules=(("NaCl", "氯化钠"), ("CO2", "二氧化碳")),
    names=(("焦媒", "焦煤"),),
    ascii_names=(("carbon steel", "CarbonSteel"), ("coke oven", "CokeOven")),
    hotwords=("焦炭", "焦化", "煤焦油", "炼焦", "配煤", "高炉", "干熄焦", "捣固焦炉"),
    confusions=(
        gl.Confusion(("焦碳", "焦炭"), "焦炭", ("焦化", "炼焦", "高炉", "配煤")),
        gl.Confusion(("干吸焦", "干熄焦"), "干熄焦", ("焦炉", "余热", "焦化")),
        gl.Confusion(("交化", "焦化", "胶化"), "焦化", ()),
    ),
)
ALIASES = {"配媒": "配煤", "高路": "高炉", "恋焦": "炼焦"}
SYLLABLES = dict(zip("焦交胶炭碳谈煤梅油由炼恋配高搞炉路捣固顾", "jiao jiao jiao tan tan tan mei mei you you lian lian pei gao gao lu lu dao gu gu".split()))
#: event type -> (spoken before the number, after it)
SPOKEN = {
    "click": ("焦碳 与高炉,产量", "吨."),
    "view": ("交化工艺  是什么 ?第", "次"),
    "purchase": ("配媒 比例 NaCl 与CO2 共", "份"),
    "signup": ("什么是交换 , 编号", "!?"),
    "error": ("carbon-steel 与 Carbon  Steel 干吸焦在焦炉 ", "台"),
}
SOUNDED = {"click": "焦谈质量", "view": "炼交过程", "purchase": "捣固交炉谈谈", "signup": "搞炉 and 梅焦由", "error": "交谈"}


def _case(values: dict[str, str]):
    out = F.lit(None).cast("string")
    for kind, text in values.items():
        out = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(out)
    return out


def chinese_numeral(number):
    """Digits with units, zeros left out; up to eight digits."""
    digits = F.array(*[F.lit(c) for c in "零一二三四五六七八九"])

    def group(value):
        pieces = []
        for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
            digit = F.floor(value / unit) % 10
            pieces.append(F.when(digit > 0, F.concat(F.get(digits, digit.cast("int")), F.lit(name))).otherwise(F.lit("")))
        return F.concat(*pieces)

    high, low = F.floor(number / 10000), number % 10000
    return F.concat(F.when(high > 0, F.concat(group(high), F.lit("万"))).otherwise(F.lit("")), group(low))


#: Short rows, whose cleaning takes long for their size.
ROWS_PER_TASK = 20_000


def _events(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return spread(table(spark, d, "events"), ROWS_PER_TASK).select("event_id", "event_type", "user_id", "value", k.alias("k"))


def _spoken(spark, d):
    text = F.concat(_case({t: a for t, (a, _) in SPOKEN.items()}), chinese_numeral(F.col("k")), _case({t: b for t, (_, b) in SPOKEN.items()}))
    context = F.when(F.col("k") % 2 == 0, F.lit("炼焦")).otherwise(F.lit(""))
    return _events(spark, d).withColumns({"text": text, "context": context})


def cleaned_transcripts(spark, d):
    rows = _spoken(spark, d)
    out = tr.clean_transcript(F.col("text"), F.col("context"), GLOSSARY, ALIASES)
    return rows.select("event_id", out.alias("text"))


def cleaned_partials(spark, d):
    rows = _spoken(spark, d)
    out = tr.clean_transcript(F.col("text"), F.col("context"), GLOSSARY, ALIASES, is_partial=F.col("value") > 20)
    return rows.select("event_id", F.col("value") > 20, out.alias("text")).toDF("event_id", "partial", "text")


def sound_corrections(spark, d):
    rows = _events(spark, d).withColumn("text", _case(SOUNDED))
    index = tr.PhoneticIndex(GLOSSARY.hotwords, SYLLABLES)
    context = F.when(F.col("k") % 2 == 0, F.lit("炼焦")).otherwise(F.lit(""))
    out = tr.replace_by_sound(F.col("text"), context, index, GLOSSARY.hotwords, tr.domain_cues(GLOSSARY.hotwords))
    return rows.select("event_id", out.alias("text"))


def spoken_numbers(spark, d):
    """Order numbers and totals written as numerals and read back."""
    total = F.floor("o_totalprice").cast("long")
    text = F.concat(F.lit("第"), chinese_numeral(F.col("o_orderkey")), F.lit("单,共"), chinese_numeral(total), F.lit("元零五"), F.lit("１二"))
    return table(spark, d, "orders").select("o_orderkey", tr.normal_numbers(text).alias("text"))


def spaced_documents(spark, d):
    return documents(spark, d).select("doc_id", tr.normal_spaces(F.col("text")).alias("text"))


def punctuated_documents(spark, d):
    return documents(spark, d).select("doc_id", tr.normal_marks(F.col("text")).alias("text"))


def replaced_terms(spark, d):
    """Terms of the data as a glossary: a rule, a name with separators, a literal name."""
    glossary = gl.Glossary(rules=(("(th)(e)", r"\1a"), ("&+", "$")), names=(("é", "e"),), ascii_names=(("of the", "OF-THE"), ("and", "&")))
    return documents(spark, d).select("doc_id", tr.replace_terms(F.col("text"), glossary).alias("text"))


def glossary_entries(spark, d):
    """A glossary written from the part table and read back."""
    names = table(spark, d, "part").select("p_brand").distinct().select(
        F.map_from_arrays(F.array(F.lower("p_brand"), F.lit(" ")), F.array("p_brand", F.lit("x"))).alias("proper_nouns"),
        F.array("p_brand", F.lit("")).alias("hotwords"),
        F.array(F.struct("p_brand", F.lit("r").alias("replace"))).cast("array<struct<pattern:string,replace:string>>").alias("replacement_rules"),
        F.array(F.struct(F.array(F.lit("v"), "p_brand").alias("variants"), F.col("p_brand").alias("preferred"), F.array(F.lit("c"), F.lit("")).alias("contexts"))).alias("asr_confusions"),
    )
    path = fresh_path(spark, "glossary")
    names.repartition(64, "hotwords").write.option("maxRecordsPerFile", 1).json(path)
    rows = gl.read_glossary_rows(spark, path)
    return rows.select("kind", "key", "value", F.array_join("variants", "|").alias("variants"), F.array_join("contexts", "|").alias("contexts"))


def mined_terms(spark, d):
    """Bilingual records placed into page text and mined from it."""
    text = F.concat(
        F.lit('x = [{ zh: "焦'), F.col("page_id").cast("string"), F.lit("\", en: 'coke \\\"oven\\\" "), F.col("page_id").cast("string"),
        F.lit("' },\n {zh:'煤', en: \"coal"), F.lit('"}, {zh: "no en"}]; '), "html",
    )
    return gl.mine_terms(table(spark, d, "pages").select("page_id", text.alias("js")), "js", "page_id")


def english_alias_rows(spark, d):
    names = table(spark, d, "part").select(
        F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("CDQ-x (")).otherwise(F.lit("Part (")), "p_name", F.lit(")  ("), F.upper("p_type"), F.lit(") "), "p_brand").alias("name")
    )
    return gl.english_aliases(names, "name")


def misheard_hotwords(spark, d):
    """Aliases of two-character words made from part names, one character per word."""
    words = "small red blue hot cold new old large ring widget bolt gear gizmo plate anvil rod"
    chars = "焦炭煤炉温油化炼化炭焦炉油温层孔"
    table_map = F.create_map(*[F.lit(x) for pair in zip(words.split(), chars) for x in pair])
    parts = F.split("p_name", " ")
    word = F.concat(F.element_at(table_map, F.get(parts, F.lit(0))), F.element_at(table_map, F.get(parts, F.lit(1))))
    return gl.hotword_aliases(table(spark, d, "part").select(word.alias("word")).distinct())


def recogniser_texts(spark, d):
    """Nested recogniser results made from events; without words the source text counts."""
    words = F.when(
        F.col("k") % 3 > 0,
        F.concat(
            F.lit('{"seg_id": 1, "cn": {"st": {"rt": [{"ws": [{"cw": [{"w": "'), F.col("event_type"), F.lit('"}, {"w": "other"}]}, {"cw": []}, {"cw": [{"w": " '),
            F.col("k").cast("string"), F.lit(' "}]}]}]}}, "src": "unused"}'),
        ),
    ).otherwise(F.concat(F.lit('{"cn": {}, "src": " '), F.col("event_type"), F.lit(' "}')))
    return _events(spark, d).select("event_id", transcript_text(words).alias("text"))


def harvested_texts(spark, d):
    body = F.concat(
        F.lit('{"code": 0, "text": "'), F.col("event_type"), F.lit('", "result": {"text": "'), F.col("event_type"),
        F.lit('", "utterances": [{"text": " a'), F.col("k").cast("string"), F.lit(' "}, {"text": "b"}, {"text": ""}]}, "nbest": [{"sentence": "b"}, {"text": "c"}]}'),
    )
    return _events(spark, d).select("event_id", harvested_text(body).alias("text"))


def harvested_messages(spark, d):
    """Conversation texts in recogniser payloads of three nested shapes, harvested again."""
    said, by = F.col("text"), F.col("role")
    field = lambda name, value: F.struct(value.alias(name))
    items = F.to_json(F.struct(
        F.lit(0).alias("code"), field("text", F.lit("no")).alias("other"),
        field("payload", F.array(field("items", F.array(F.struct(said.alias("utterance"), F.array(field("transcript", said)).alias("alternatives")))))).alias("data"),
    ))
    segments = F.to_json(F.struct(F.array(F.struct(said.alias("sentence"), by.alias("Text"))).alias("segments"), F.lit(7).alias("text")))
    listed = F.to_json(F.array(field("result", F.array(F.struct(F.array(field("SRC", by)).alias("nbest"), field("text", said).alias("utterances"))))))
    payload = F.when(F.col("turn") % 3 == 0, items).when(F.col("turn") % 3 == 1, segments).otherwise(listed)
    return table(spark, d, "conversations").select("conv_id", "turn", harvested_text(payload).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        cleaned_transcripts, cleaned_partials, sound_corrections, spoken_numbers, spaced_documents, punctuated_documents,
        replaced_terms, glossary_entries, mined_terms, english_alias_rows, misheard_hotwords, recogniser_texts, harvested_texts, harvested_messages,
    )
}

_EVENTS = "ev AS (SELECT *, (props->>'$.k')::BIGINT AS k FROM events), n AS (SELECT *, CASE WHEN k = 0 THEN '' WHEN k < 10 THEN ['一','二','三','四','五','六','七','八','九'][k] ELSE k::VARCHAR END AS num FROM ev)"
_CLEAN = """CASE event_type WHEN 'click' THEN '焦炭与高炉，产量' || num || '吨。' WHEN 'view' THEN '焦化工艺是什么？第' || num || '次'
  WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN '配煤' ELSE '配媒' END || '比例氯化钠与二氧化碳共' || num || '份'
  WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN '什么是焦化，编号' ELSE '什么是交换，编号' END || num || '？'
  ELSE 'CarbonSteel 与 CarbonSteel 干熄焦在焦炉' || num || '台' END"""
_MARKED = "regexp_replace(regexp_replace(translate(text, ',.?!:;', '，。？！：；'), '[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}]*([，。！？；：])[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}]*', '\\1', 'g'), '[，。！？；：]*([，。！？；：])', '\\1', 'g')"

ORACLES = {
    "cleaned_transcripts": f"""WITH {_EVENTS}, c AS (SELECT event_id, {_CLEAN} AS t FROM n)
SELECT event_id, CASE WHEN regexp_matches(t, '[。！？]$') THEN t ELSE t || '。' END AS text FROM c""",
    "cleaned_partials": f"""WITH {_EVENTS}, c AS (SELECT event_id, value > 20 AS partial, {_CLEAN} AS t FROM n)
SELECT event_id, partial, CASE WHEN partial OR regexp_matches(t, '[。！？]$') THEN t ELSE t || '。' END AS text FROM c""",
    "sound_corrections": f"""WITH {_EVENTS}
SELECT event_id, CASE event_type WHEN 'click' THEN '焦炭质量' WHEN 'view' THEN '炼焦过程' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN '捣固焦炉谈谈' ELSE '捣固交炉谈谈' END
  WHEN 'signup' THEN '高炉 and 梅焦由' ELSE '交谈' END AS text FROM n""",
    "spoken_numbers": """
WITH o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS total FROM orders),
f AS (SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '' WHEN o_orderkey < 10 THEN ['一','二','三','四','五','六','七','八','九'][o_orderkey] ELSE o_orderkey::VARCHAR END AS a,
  CASE WHEN total = 0 THEN '' WHEN total < 10 THEN ['一','二','三','四','五','六','七','八','九'][total] ELSE total::VARCHAR END AS b FROM o)
SELECT o_orderkey, '第' || a || '单,共' || b || '元5' || '1二' AS text FROM f""",
    "spaced_documents": """
SELECT doc_id, trim(regexp_replace(translate(text, chr(12288) || chr(9) || chr(10), '   '), '[\\s\\x0b\\x85\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}]{2,}', ' ', 'g')) AS text FROM documents""",
    "punctuated_documents": f"""WITH m AS (SELECT doc_id, {_MARKED} AS t FROM documents)
SELECT doc_id, CASE WHEN t <> '' AND NOT regexp_matches(t, '[。！？!?]$') AND length(t) >= 6 THEN t || '。' ELSE t END AS text FROM m""",
    "replaced_terms": """
WITH r AS (SELECT doc_id, replace(regexp_replace(regexp_replace(text, '(th)(e)', '\\1a', 'g'), '&+', '$', 'g'), 'é', 'e') AS t FROM documents),
-- no lookaround here: a boundary is a kept neighbour, so neighbours are doubled first
s AS (SELECT doc_id, regexp_replace(t, '([^A-Za-z0-9])', '\\1' || chr(1) || chr(1) || '\\1', 'g') AS t FROM r),
o AS (SELECT doc_id, regexp_replace(t, '(?i)(^|\\x01[^A-Za-z0-9])of(?:[\\s_./-]\\x01\\x01[\\s_./-])*the([^A-Za-z0-9]\\x01|$)', '\\1OF-THE\\2', 'g') AS t FROM s),
b AS (SELECT doc_id, regexp_replace(t, '(?i)(^|\\x01[^A-Za-z0-9])and([^A-Za-z0-9]\\x01|$)', '\\1&\\2', 'g') AS t FROM o)
SELECT doc_id, regexp_replace(t, '(?s)(.)\\x01\\x01.', '\\1', 'g') AS text FROM b""",
    "glossary_entries": """
WITH b AS (SELECT DISTINCT p_brand AS b FROM part)
SELECT 'rule' AS kind, b AS key, 'r' AS value, '' AS variants, '' AS contexts FROM b
UNION ALL SELECT 'name', lower(b), b, '', '' FROM b UNION ALL SELECT 'hotword', b, b, '', '' FROM b
UNION ALL SELECT 'confusion', b, b, 'v|' || b, 'c' FROM b""",
    "mined_terms": """
SELECT page_id, '焦' || page_id AS zh, 'coke "oven" ' || page_id AS en FROM pages UNION ALL SELECT page_id, '煤', 'coal' FROM pages""",
    "english_alias_rows": """
WITH n AS (SELECT p_name, p_type, p_brand, p_size, CASE WHEN p_size % 2 = 0 THEN 'CDQ-x (' ELSE 'Part (' END || p_name || ') (' || upper(p_type) || ') ' || p_brand AS name FROM part),
a AS (
  SELECT lower(name) AS alias, name FROM n UNION SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'), name FROM n
  UNION SELECT regexp_replace(lower(name), '[\\s_./-]+', ' ', 'g'), name FROM n
  UNION SELECT 'cdq-x', 'CDQ-X' FROM n WHERE p_size % 2 = 0 UNION SELECT 'cdq x', 'CDQ-X' FROM n WHERE p_size % 2 = 0 UNION SELECT 'part', 'PART' FROM n WHERE p_size % 2 = 1
  UNION SELECT lower(p_type), upper(p_type) FROM n
)
SELECT alias, name FROM a""",
    "recogniser_texts": f"""WITH {_EVENTS}
SELECT event_id, CASE WHEN k % 3 > 0 THEN event_type || ' ' || k ELSE event_type END AS text FROM n""",
    "harvested_messages": """WITH m AS (SELECT conv_id, turn, trim(role) AS r, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR r = t THEN t WHEN turn % 3 = 1 THEN t || r ELSE r || t END AS text FROM m""",
    "harvested_texts": f"WITH {_EVENTS} SELECT event_id, event_type || 'a' || k || 'bc' AS text FROM n",
}
