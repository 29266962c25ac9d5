"""Controlled-vocabulary tags and dictionary entities, computed in the row of each paper."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import strip
from emberline.session import rows_within

# The controlled vocabulary and how many tags are kept.
COKING_TOPICS = (
    "CSR", "CRI", "coal fluidity", "vitrinite reflectance",
    "maceral analysis", "porosity", "coal rank", "coal blending",
    "coke strength", "thermoplasticity", "pyrolysis", "carbonization",
    "volatile matter", "ash content", "sulfur content",
    "FTIR spectroscopy", "NMR spectroscopy", "TG analysis",
    "XPS analysis", "micro CT", "GC-MS",
    "molecular structure", "bond energy", "functional groups",
    "inertinite", "vitrinite", "exinite",
    "plastic layer", "coking pressure", "contraction",
    "blast furnace", "coke quality prediction",
    "coal petrography", "macromolecular structure",
    "thermal decomposition", "gas evolution",
    "dilatation", "free swelling index",
)
MOST_TAGS = 5
#: Vocabularies go into the plan as an array, so their size is checked.
VOCABULARY_LIMIT = 2000


def vocabulary(terms: DataFrame) -> list[str]:
    """Distinct terms of the single column of ``terms``; refuses more than the limit."""
    rows = rows_within(terms.distinct(), VOCABULARY_LIMIT)
    if rows is None:
        raise ValueError(f"more than {VOCABULARY_LIMIT} terms")
    return sorted(r[0] for r in rows if r[0])


def _found(text: Column, terms: list[str] | tuple[str, ...], rank: Callable[[str, str], int], most: int | None = None) -> Column:
    """The terms in the text in lower case, by the number that ``rank`` gives each and then in alphabetical order.

    Every term is looked for in every text, which Python's strings do much faster than Spark's.
    """
    given = [(t.lower(), t) for t in terms]

    @F.pandas_udf("array<string>")
    def found(lows: pd.Series) -> pd.Series:
        held = ([(low, term) for low, term in given if low in text] if isinstance(text, str) else [] for text in lows)
        return pd.Series([[term for _, term in sorted((rank(text, low), term) for low, term in some)[:most]] for text, some in zip(lows, held)], dtype=object)

    return found(F.lower(text))


def tags(text: Column, terms: list[str] | tuple[str, ...], most: int = MOST_TAGS) -> Column:
    """The terms found most often (occurrences do not overlap), ties in alphabetical order."""
    return _found(text, terms, lambda low, term: -low.count(term), most)


def merge_tags(chosen: Column, new: Column) -> Column:
    """Chosen and new tags, stripped and in lower case, blanks dropped, duplicates kept."""
    every = F.transform(F.concat(chosen, new), lambda t: F.lower(strip(t)))
    return F.filter(every, lambda t: t != "")


def mentioned(text: Column, terms: list[str]) -> Column:
    """Terms in the text by first position."""
    return _found(text, terms, lambda low, term: low.find(term))


def dictionary_entities(papers: DataFrame, text: str, families: dict[str, list[str]]) -> DataFrame:
    """Entities of each family that a text mentions, and pairs of neighbouring concepts.

    Concepts are related to the one mentioned next, not each to all: the pairs grow with the
    mentions, and paths over them still connect all concepts of a paper.
    """
    rows = papers
    for name, terms in families.items():
        rows = rows.withColumn(name, mentioned(F.col(text), terms))
    count = F.size("concepts")
    pairs = F.transform(
        F.sequence(F.lit(1), count - 1),
        lambda i: F.array(F.element_at("concepts", i), F.element_at("concepts", i + 1)),
    )
    return rows.withColumn(
        "concept_relations", F.when(count > 1, pairs).otherwise(F.array().cast("array<array<string>>"))
    )
