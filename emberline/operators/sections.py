"""Sections and chunks of papers, all inside the paper's own row.

A paper stays one row until its chunks are exploded, so that section ends, page numbers and the
running chunk index need neither a shuffle nor a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.binding import let
from emberline.functions.text import strip

# Headings, shortest usable text and preamble, and chunk sizes.
HEADING = (
    r"(?:\d+\.?\s+)?"
    r"(?:Abstract|Introduction|Background|Literature\s+Review|"
    r"Experiment(?:al)?|Materials?\s+and\s+Methods?|Methods?|"
    r"Results?\s+and\s+Discussion|Results?|Discussion|"
    r"Conclusions?|Summary|Acknowledg[e]?ments?|References|"
    r"Appendix|Supplementary)"
)
MIN_TEXT_CHARS = 100
PREAMBLE_MORE_THAN = 200
PREAMBLE, FULL_TEXT = "Preamble", "Full Text"
CHARS_PER_TOKEN, MAX_TOKENS, OVERLAP_TOKENS = 4, 500, 50
PARAGRAPH_BREAK, SENTENCE_BREAK = "\n\n", ". "
#: d: only \n ends a line; U: Unicode classes and case, as the headings were defined with.
FLAGS = "(?imdU)"
#: Marks a heading while the text is cut; private-use characters that text does not hold.
CUT = "\ue000\ue001"


def full_text(pages: Column) -> Column:
    return F.array_join(pages, "\n")


def usable(text: Column) -> Column:
    return F.length(strip(text)) >= MIN_TEXT_CHARS


def page_offsets(pages: Column) -> Column:
    """Where each page starts in the joined text."""
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("next"))
    state = F.aggregate(
        pages,
        start,
        lambda s, p: F.struct(
            F.concat(s["at"], F.array(s["next"])).alias("at"), (s["next"] + F.length(p) + 1).alias("next")
        ),
    )
    return state["at"]


def page_of(offset: Column, offsets: Column) -> Column:
    """The last page that starts at or before the offset."""
    return F.greatest(F.size(F.filter(offsets, lambda o: o <= offset)) - 1, F.lit(0))


def _spans(parts: Column) -> Column:
    """Pieces of the text with their start and end."""
    start = F.struct(
        F.array().cast("array<struct<start:int,stop:int,text:string>>").alias("out"), F.lit(0).alias("at")
    )

    def add(state: Column, part: Column) -> Column:
        stop = state["at"] + F.length(part)
        piece = F.struct(state["at"].alias("start"), stop.alias("stop"), part.alias("text"))
        return F.struct(F.concat(state["out"], F.array(piece)).alias("out"), stop.alias("at"))

    return F.aggregate(parts, start, add)["out"]


def with_sections(papers: DataFrame) -> DataFrame:
    """Add ``sections``: array of (title, text, page_start, page_end, start, stop).

    Text before the first heading is kept only when it is long enough.
    """
    text = full_text(F.col("pages"))
    cut = F.split(F.regexp_replace(text, f"{FLAGS}^({HEADING})", CUT + "$1"), CUT, -1)
    rows = papers.withColumns({"_spans": _spans(cut), "_offsets": page_offsets(F.col("pages"))})
    offsets = F.col("_offsets")

    def section(piece: Column) -> Column:
        return F.struct(
            strip(F.regexp_extract(piece["text"], f"{FLAGS}^{HEADING}", 0)).alias("title"),
            strip(piece["text"]).alias("text"),
            page_of(piece["start"], offsets).alias("page_start"),
            page_of(piece["stop"] - 1, offsets).alias("page_end"),
            piece["start"].alias("start"),
            piece["stop"].alias("stop"),
        )

    def whole(title: str, piece: Column, last_page: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(title).alias("title"), strip(piece["text"]).alias("text"), F.lit(0).alias("page_start"),
                last_page.alias("page_end"), piece["start"].alias("start"), piece["stop"].alias("stop"),
            )
        )

    first = F.get("_spans", F.lit(0))
    found = F.transform(F.slice("_spans", 2, F.greatest(F.size("_spans") - 1, F.lit(0))), section)
    keep_preamble = (first["stop"] > PREAMBLE_MORE_THAN) & (strip(first["text"]) != "")
    sections = (
        F.when(F.size("_spans") == 1, whole(FULL_TEXT, first, F.size("pages") - 1))
        .when(keep_preamble, F.concat(whole(PREAMBLE, first, page_of(first["stop"], offsets)), found))
        .otherwise(found)
    )
    return rows.withColumn("sections", sections).drop("_spans", "_offsets")


def chunk_text(text: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """Overlapping chunks of a text.

    A text that fits is returned as it is.  Otherwise each window ends at the last blank line in its
    second half, else after the last full stop there, else at its full size; the next one starts the
    overlap earlier.  The state carries only the text that is left, so that each step works at its
    beginning instead of counting through the whole text again.
    """
    size = max_tokens * CHARS_PER_TOKEN
    overlap = overlap_tokens * CHARS_PER_TOKEN
    half = size // 2
    length = F.length(text)

    def last_in(pattern: str, zone: Column) -> Column:
        return F.locate(pattern[::-1], F.reverse(zone))

    def step(state: Column, _: Column) -> Column:
        def end_in(zone: Column) -> Column:
            blank, stop = last_in(PARAGRAPH_BREAK, zone), last_in(SENTENCE_BREAK, zone)
            return (
                F.when(state["left"] <= size, F.lit(size))
                .when(blank > 0, size + 1 - blank - len(PARAGRAPH_BREAK))
                .when(stop > 0, size - stop)
                .otherwise(F.lit(size))
            )

        def move(end: Column) -> Column:
            def keep(piece: Column) -> Column:
                return F.when(piece != "", F.concat(state["out"], F.array(piece))).otherwise(state["out"])

            return F.struct(
                F.substring(state["rest"], end - overlap + 1, state["left"]).alias("rest"),
                (state["left"] - end + overlap).alias("left"),
                let(strip(F.substring(state["rest"], F.lit(1), end)), keep).alias("out"),
            )

        zone = F.substring(state["rest"], half + 1, size - half)
        return F.when(state["left"] > 0, let(let(zone, end_in), move)).otherwise(state)

    start = F.struct(text.alias("rest"), length.alias("left"), F.array().cast("array<string>").alias("out"))
    steps = F.sequence(F.lit(1), F.floor(length / (half - overlap)).cast("int") + 2)
    return F.when(length <= size, F.array(text)).otherwise(F.aggregate(steps, start, step)["out"])


def with_chunks(papers: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """Add ``chunks``: array of (section, text) over all sections in order."""
    per_section = F.transform(
        "sections",
        lambda s: F.transform(
            chunk_text(s["text"], max_tokens, overlap_tokens),
            lambda c: F.struct(s["title"].alias("section"), c.alias("text")),
        ),
    )
    return papers.withColumn("chunks", F.flatten(per_section))


def chunk_rows(papers: DataFrame, *keep: str) -> DataFrame:
    """One row per chunk with its index within the paper.

    The outer form keeps the optimizer from computing the chunks a second time in a filter on their
    number, which it would push below the sections.
    """
    rows = papers.select(*keep, F.posexplode_outer("chunks").alias("chunk_index", "c")).where("chunk_index IS NOT NULL")
    return rows.select(
        *keep, F.col("chunk_index").cast("long").alias("chunk_index"), "c.section", "c.text"
    )
