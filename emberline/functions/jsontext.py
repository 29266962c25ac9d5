"""Text that should be JSON: fences, defaults, lists, and nested recogniser results."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.text import strip

# Fences, and keys that hold text or lead to it.
OPEN_FENCE = r"^```(?:json)?\s*"
CLOSE_FENCE = r"\s*```$"
METADATA_SCHEMA = "title string, authors array<string>, abstract string, keywords array<string>, year int"
QUERY_SCHEMA = "english_queries array<string>, key_concepts array<string>, key_methods array<string>, key_materials array<string>"
TRANSCRIPT_SCHEMA = "cn struct<st: struct<rt: array<struct<ws: array<struct<cw: array<struct<w: string>>>>>>>>, src string"
FOLLOW_UPS = 3
FOLLOW_UP_HEAD = "\n\n---\n\n**您可能还想了解：**"


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(reply), OPEN_FENCE, ""), CLOSE_FENCE, "")


def metadata(reply: Column, fallback_text: Column) -> Column:
    """Paper metadata with defaults; a broken reply gives the first line as title."""
    parsed = F.from_json(unfenced(reply), METADATA_SCHEMA)
    valid = F.try_parse_json(unfenced(reply)).isNotNull()
    first_line = strip(F.get(F.split(strip(fallback_text), "\n", -1), F.lit(0)))
    empty = F.array().cast("array<string>")
    return F.struct(
        F.when(valid, F.coalesce(parsed["title"], F.lit(""))).otherwise(first_line).alias("title"),
        F.coalesce(F.when(valid, parsed["authors"]), empty).alias("authors"),
        F.coalesce(F.when(valid, parsed["abstract"]), F.lit("")).alias("abstract"),
        F.coalesce(F.when(valid, parsed["keywords"]), empty).alias("keywords"),
        F.when(valid, parsed["year"]).alias("year"),
    )


def search_queries(reply: Column, question: Column) -> Column:
    """Search queries and key terms; the question itself when the reply has no queries."""
    parsed = F.from_json(unfenced(reply), QUERY_SCHEMA)
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(parsed["english_queries"], F.array(question)).alias("english_queries"),
        *[F.coalesce(parsed[c], empty).alias(c) for c in ("key_concepts", "key_methods", "key_materials")],
    )


def follow_ups(reply: Column) -> Column:
    """The first three questions of a JSON list, or none."""
    parsed = F.from_json(unfenced(reply), "array<string>")
    return F.coalesce(F.slice(parsed, 1, FOLLOW_UPS), F.array().cast("array<string>"))


def follow_up_block(questions: Column) -> Column:
    numbered = F.transform(questions, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q))
    return F.when(
        F.size(questions) > 0, F.concat_ws("\n", F.lit(FOLLOW_UP_HEAD), F.array_join(numbered, "\n"))
    ).otherwise(F.lit(""))


def transcript_text(payload: Column) -> Column:
    """First candidate of every word in a nested recogniser result, else its ``src`` text."""
    parsed = F.from_json(payload, TRANSCRIPT_SCHEMA)
    words = F.flatten(
        F.transform(
            parsed["cn"]["st"]["rt"], lambda rt: F.transform(rt["ws"], lambda ws: F.get(ws["cw"], F.lit(0))["w"])
        )
    )
    kept = F.filter(words, lambda w: w.isNotNull())
    return F.when(F.size(kept) > 0, strip(F.array_join(kept, ""))).otherwise(strip(F.coalesce(parsed["src"], F.lit(""))))


# Keys whose strings are texts, and keys whose values are searched further; in any case of letters.
TEXT_KEYS = frozenset("text transcript sentence utterance src".split())
HOLDING_KEYS = frozenset("result results data payload segments utterances items nbest alternatives".split())


class _Found(list):
    """Texts of one JSON object, in the order of the document."""


def _texts_below(value: object) -> list[str]:
    """Texts of an object, or of the objects in a list of any depth; objects within have become their texts already."""
    if isinstance(value, _Found):
        return value
    return [text for item in value for text in _texts_below(item)] if isinstance(value, list) else []


def _object_texts(pairs: list[tuple[str, object]]) -> _Found:
    """What the parser puts in the place of an object: inner objects come first, so that nothing is walked twice."""
    found = _Found()
    for key, value in dict(pairs).items():
        if key.lower() in TEXT_KEYS:
            found += [value.strip()] if isinstance(value, str) else []
        elif key.lower() in HOLDING_KEYS:
            found += _texts_below(value)
    return found


def harvest(payload: str | None) -> str:
    """Unique texts of a JSON payload of any shape and depth, in document order; empty where it cannot be read."""
    try:
        found = _texts_below(json.loads(payload or "null", object_pairs_hook=_object_texts))
    except (ValueError, RecursionError):
        return ""
    return "".join(dict.fromkeys(filter(None, found))).strip()


def harvested_text(payload: Column) -> Column:
    """Texts of a recogniser result, see ``harvest``.

    A VARIANT keeps the fields of an object by name and not in their order, so that the walk is a batched Python function.
    """
    return F.pandas_udf(lambda texts: texts.map(harvest, na_action=None), "string")(payload)
