"""Glossary files, mined bilingual terms, and the aliases made from them."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.session import rows_within, written

GLOSSARY_SCHEMA = (
    "replacement_rules array<struct<pattern: string, replace: string>>, proper_nouns map<string, string>, "
    "hotwords array<string>, asr_confusions array<struct<variants: array<string>, preferred: string, contexts: array<string>>>"
)
#: A glossary goes into the plan, so the number of its entries is checked.
ENTRY_LIMIT = 5000
# A bilingual record in source text, homophone groups, aliases known beforehand, limits.
TERM_RECORD = (
    r"""(?s)\{\s*zh\s*:\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')\s*,\s*en\s*:\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')\s*\}"""
)
HOMOPHONE_GROUPS = (
    "焦交胶教较礁椒", "炭碳谈探叹", "炼练恋链敛", "煤霉梅媒枚", "化话划华", "油由邮尤", "配佩赔培",
    "炉卢庐", "熄息析吸", "高搞稿", "温稳问文", "塑诉素速", "层曾城成", "孔恐控空", "隙系细戏",
    "压呀押鸦", "反返", "应映硬", "强墙", "气器汽弃",
)
KNOWN_ALIASES = {
    "交炭": "焦炭", "焦碳": "焦炭", "练焦": "炼焦", "恋焦": "炼焦", "链焦": "炼焦", "交化": "焦化",
    "胶化": "焦化", "煤交油": "煤焦油", "煤胶油": "煤焦油", "干吸焦": "干熄焦", "配媒": "配煤", "高路": "高炉",
}
PEERS_ONE, PEERS_TWO, KEPT_PER_TERM, MOST_ALIASES = 6, 4, 12, 1500
ALIAS_TERM_LENGTHS = (2, 4)


class Confusion(NamedTuple):
    variants: tuple[str, ...]
    preferred: str
    contexts: tuple[str, ...]


class Glossary(NamedTuple):
    rules: tuple[tuple[str, str], ...] = ()
    names: tuple[tuple[str, str], ...] = ()
    ascii_names: tuple[tuple[str, str], ...] = ()
    hotwords: tuple[str, ...] = ()
    confusions: tuple[Confusion, ...] = ()


def read_glossary_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all JSON files of a folder, one row each; entries of a wrong type are left out."""
    files = (
        spark.read.schema(GLOSSARY_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
        .withColumn("file", F.substring_index("_metadata.file_path", "/", -1))
    )
    none = F.array().cast("array<string>")
    rules = files.select("file", F.posexplode("replacement_rules").alias("pos", "r")).select(
        "file", "pos", F.lit("rule").alias("kind"), F.col("r.pattern").alias("key"), F.col("r.replace").alias("value"), none.alias("variants"), none.alias("contexts")
    )
    nouns = files.select("file", F.posexplode(F.map_entries("proper_nouns")).alias("pos", "r")).select(
        "file", "pos", F.lit("name").alias("kind"), F.trim("r.key").alias("key"), F.trim("r.value").alias("value"), none.alias("variants"), none.alias("contexts")
    )
    words = files.select("file", F.posexplode("hotwords").alias("pos", "w")).select(
        "file", "pos", F.lit("hotword").alias("kind"), F.trim("w").alias("key"), F.trim("w").alias("value"), none.alias("variants"), none.alias("contexts")
    )
    confusions = files.select("file", F.posexplode("asr_confusions").alias("pos", "c")).select(
        "file", "pos", F.lit("confusion").alias("kind"), F.col("c.preferred").alias("key"), F.col("c.preferred").alias("value"),
        F.array_distinct(F.concat(F.filter(F.coalesce("c.variants", none), lambda v: v != ""), F.array("c.preferred"))).alias("variants"),
        F.filter(F.coalesce("c.contexts", none), lambda v: v != "").alias("contexts"),
    )
    every = rules.unionByName(nouns).unionByName(words).unionByName(confusions)
    whole = F.col("key").isNotNull() & F.col("value").isNotNull() & ((F.col("kind") == "rule") | ((F.col("key") != "") & (F.col("value") != "")))
    return every.where(whole & ((F.col("kind") != "confusion") | (F.size("variants") > 1)))


def load_glossary(rows: DataFrame) -> Glossary:
    """Glossary rows as rules for column expressions; refuses more than the limit."""
    entries = rows_within(rows.orderBy("file", "pos"), ENTRY_LIMIT)
    if entries is None:
        raise ValueError(f"more than {ENTRY_LIMIT} glossary entries")
    rules, names, ascii_names, words, confusions = [], {}, [], {}, []
    for e in entries:
        if e["kind"] == "rule":
            try:
                re.compile(e["key"])
            except re.error:
                continue
            rules.append((e["key"], e["value"]))
        elif e["kind"] == "name":
            if e["key"].isascii() and re.search("[A-Za-z0-9]", e["key"]):
                ascii_names.append((e["key"], e["value"]))
            else:
                names[e["key"]] = e["value"]
        elif e["kind"] == "hotword":
            words[e["key"]] = None
        else:
            ordered = tuple(sorted(e["variants"], key=lambda v: (-len(v), v)))
            confusions.append(Confusion(ordered, e["value"], tuple(e["contexts"])))
    return Glossary(tuple(rules), tuple(names.items()), tuple(ascii_names), tuple(words), tuple(confusions))


# What a character after a backslash stands for; before others the backslash stays.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
ESCAPE_PARTS = r"(?s)\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|[^\\]+|\\$"


def _unquoted(token: Column) -> Column:
    """The text of a quoted string: its escapes are read from left to right, once each.

    Code points are put together from UTF-16 units, so that two escapes can make one character.
    """

    def units(part: Column, digits: int) -> Column:
        return F.lpad(F.substring(part, F.lit(3), F.lit(digits)), 4, "0")

    def told(part: Column) -> Column:
        second = F.substring(part, 2, 1)
        plain = F.element_at(F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair]), second)
        code = F.when(part.rlike(r"^\\u[0-9a-fA-F]{4}$"), units(part, 4)).when(part.rlike(r"^\\x[0-9a-fA-F]{2}$"), units(part, 2))
        # whatever is no escape is turned into UTF-16 as well, so that the whole is decoded at once
        rest = F.when(~F.startswith(part, F.lit("\\")), part).otherwise(F.coalesce(plain, part))
        return F.coalesce(code, F.hex(F.encode(rest, "UTF-16BE")))

    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    whole = F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(ESCAPE_PARTS), F.lit(0)), told), "")
    return F.trim(F.when(F.contains(inner, F.lit("\\")), F.decode(F.unhex(whole), "UTF-16BE")).otherwise(inner))


def mine_terms(sources: DataFrame, text: str, *keep: str) -> DataFrame:
    """Bilingual terms ``{zh: "...", en: "..."}`` in source text, one row each."""
    found = sources.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(TERM_RECORD), F.lit(0))).alias("_m"))
    zh, en = (_unquoted(F.regexp_extract("_m", TERM_RECORD, i)) for i in (1, 2))
    return found.select(*keep, zh.alias("zh"), en.alias("en"))


def english_aliases(names: DataFrame, column: str) -> DataFrame:
    """Spellings under which an English name may be spoken: (alias, name), distinct.

    Lower case, without separators, with single spaces; a leading code before a bracket and codes in
    brackets stand for themselves in upper case.
    """
    name = F.trim(F.regexp_replace(column, r"\s+", " "))
    lower = F.lower(name)
    pair = lambda alias, value: F.struct(alias.alias("alias"), value.alias("name"))
    code = F.upper(F.regexp_extract(name, r"^\s*([A-Za-z0-9+_-]{2,})\s*\(", 1))
    spelled = F.array(
        pair(lower, name),
        pair(F.regexp_replace(lower, "[^a-z0-9]+", ""), name),
        pair(F.trim(F.regexp_replace(lower, r"[\s_./-]+", " ")), name),
    )
    coded = F.array(pair(F.lower(code), code), pair(F.lower(F.replace(code, F.lit("-"), F.lit(" "))), code))
    brackets = F.transform(
        F.regexp_extract_all(name, F.lit(r"\(([A-Za-z0-9+_-]{2,})\)"), F.lit(1)), lambda a: pair(F.lower(a), F.upper(a))
    )
    every = F.concat(spelled, F.when(code != "", coded).otherwise(F.slice(coded, 1, 0)), brackets)
    return names.select(F.explode(every).alias("p")).select("p.*").where(F.length("alias") >= 2).distinct()


def confusable_characters(spark: SparkSession) -> DataFrame:
    """Each character of the homophone groups with its sorted peers."""
    peers: dict[str, set[str]] = {}
    for group in HOMOPHONE_GROUPS:
        for char in group:
            peers.setdefault(char, set()).update(set(group) - {char})
    rows = [(char, sorted(others)) for char, others in sorted(peers.items())]
    return spark.createDataFrame(rows, "ch string, peers array<string>")


def hotword_aliases(hotwords: DataFrame) -> DataFrame:
    """Misheard spellings of hotwords: (alias, term).

    Terms take turns, longer ones first; each claims up to twelve spellings that no earlier term has
    claimed, and a spelling met by a second term is given up.  What a term may claim depends on the
    terms before it, so claims are computed for all terms at once and repeated until they stay the
    same; the first n terms are right after n rounds, in practice two or three rounds do.
    """
    spark = hotwords.sparkSession
    low, high = ALIAS_TERM_LENGTHS
    words = hotwords.select(F.trim("word").alias("term")).where(F.col("term").rlike("[\\x{4e00}-\\x{9fff}]")).distinct()
    peers = confusable_characters(spark)
    terms = words.where(F.length("term").between(low, high))
    chars = terms.select("term", F.posexplode(F.split("term", "")).alias("at", "ch")).join(peers, "ch")
    single = chars.select(
        "term", F.explode(F.slice("peers", 1, PEERS_ONE)).alias("p"), "at"
    ).select("term", F.expr("overlay(term PLACING p FROM at + 1 FOR 1)").alias("alias"))
    sides = chars.where(F.length("term") == 2).groupBy("term").agg(
        F.max(F.when(F.col("at") == 0, F.slice("peers", 1, PEERS_TWO))).alias("a"),
        F.max(F.when(F.col("at") == 1, F.slice("peers", 1, PEERS_TWO))).alias("b"),
    )
    double = sides.select("term", F.explode("a").alias("a"), "b").select("term", "a", F.explode("b").alias("b")).select(
        "term", F.concat("a", "b").alias("alias")
    )
    variants = single.unionByName(double).distinct().join(words.select(F.col("term").alias("alias")), "alias", "left_anti")
    turn = F.struct((-F.length("term")).alias("len"), F.col("term").alias("t"))
    variants = written(variants.select("alias", "term", turn.alias("turn")), "alias-variants")
    within = Window.partitionBy("term").orderBy("alias").rowsBetween(Window.unboundedPreceding, -1)
    owners = variants.select("alias", F.lit(None).cast("struct<len:int,t:string>").alias("owner")).limit(0)
    before = None
    while True:
        joined = variants.join(owners, "alias", "left")
        taken = F.coalesce(F.col("owner") < F.col("turn"), F.lit(False))
        scanned = joined.withColumn("taken", taken).withColumn(
            "reached", F.coalesce(F.sum((~F.col("taken")).cast("int")).over(within), F.lit(0)) < KEPT_PER_TERM
        ).where("reached")
        claims = scanned.groupBy("alias").agg(
            F.min(F.when(~F.col("taken"), F.col("turn"))).alias("owner"), F.max(F.col("taken").cast("int")).alias("shared")
        ).where("owner IS NOT NULL")
        claims = written(claims, "alias-claims")
        state = claims.agg(F.count("*"), F.sum(F.xxhash64("alias", "owner", "shared").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, owners = state, claims.select("alias", "owner")
    found = claims.where("shared = 0").select("alias", F.col("owner.t").alias("term"))
    known = spark.createDataFrame(sorted(KNOWN_ALIASES.items()), "alias string, term string").join(words, "term", "left_semi")
    every = found.join(known.select("alias"), "alias", "left_anti").unionByName(known.select("alias", "term"))
    return every.orderBy(F.desc(F.length("alias")), "alias").limit(MOST_ALIASES)
