"""Text expressions over a corpus: paths, titles, years, sentences, script predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker directories, title and year rules, sentence marks.
MARKER_DIRECTORIES = ("Coal blend papper", "Coal blend paper")
UNCATEGORIZED = "uncategorized"
NOT_A_TITLE = r"(?i)^(page|vol|issue|doi|http|www)"
TITLE_LINES, TITLE_MORE_THAN, TITLE_CHARS = 10, 15, 200
YEAR_PATTERN, YEAR_WITHIN, YEAR_FIRST, YEAR_LAST = r"(19|20)\d{2}", 3000, 1950, 2030
SENTENCE_BREAK = r"(?<=[。！？.!?])\s+"
SENTENCE_END = r"[。！？.!?]\s*$"
CLAUSE_BREAK = r"(?<=[。！？.!?；;，,])"
CLAUSE_CHARS = 6
#: Whitespace as Unicode sees it.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without whitespace at both ends; a pattern would try every run of it inside, too."""
    return F.btrim(text, F.lit(SPACE))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def normalise_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def path_category(path: Column) -> Column:
    """The directory right after the first marker directory, unless that is the file itself."""
    parts = F.filter(F.split(path, "/", -1), lambda p: p != "")
    count = F.size(parts)
    places = F.filter(F.sequence(F.lit(1), count), lambda i: F.element_at(parts, i).isin(*MARKER_DIRECTORIES))
    following = F.transform(places, lambda i: F.get(parts, i))
    named = F.filter(following, lambda p: p.isNotNull() & (p != F.element_at(parts, -1)))
    return F.when(count > 0, F.coalesce(F.get(named, F.lit(0)), F.lit(UNCATEGORIZED))).otherwise(F.lit(UNCATEGORIZED))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/", -1), -1), r"(?<=.)\.[^.]*$", "")


def guess_title(text: Column, path: Column) -> Column:
    """The first long line among the first ten that are not blank, else the file name."""
    lines = F.filter(F.transform(F.split(strip(text), "\n", -1), strip), lambda x: x != "")
    fit = F.filter(
        F.slice(lines, 1, TITLE_LINES), lambda x: (F.length(x) > TITLE_MORE_THAN) & ~x.rlike(NOT_A_TITLE)
    )
    return F.coalesce(F.left(F.get(fit, F.lit(0)), F.lit(TITLE_CHARS)), file_stem(path))


def guess_year(text: Column) -> Column:
    """The first year-like number of the opening; only that one is tried."""
    found = F.regexp_extract(F.left(text, F.lit(YEAR_WITHIN)), YEAR_PATTERN, 0)
    year = F.when(found != "", found.cast("int"))
    return F.when(year.between(YEAR_FIRST, YEAR_LAST), year)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[\x{4e00}-\x{9fff}]")


def is_ascii(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^(?s)[\x00-\x7f]+$")


def sentences(buffer: Column) -> Column:
    """Struct of complete sentences and the tail that is still open.

    Text counts as split only where a terminal mark is followed by whitespace.
    """
    parts = F.split(buffer, SENTENCE_BREAK, -1)
    count = F.size(parts)
    closed = buffer.rlike(SENTENCE_END)
    full = F.when(count <= 1, F.array().cast("array<string>")).when(closed, parts).otherwise(F.slice(parts, 1, F.greatest(count - 1, F.lit(0))))
    rest = F.when(count <= 1, buffer).when(closed, F.lit("")).otherwise(F.element_at(parts, -1))
    return F.struct(F.filter(full, lambda p: p != "").alias("complete"), rest.alias("rest"))


def clauses(buffer: Column, min_len: int = CLAUSE_CHARS) -> Column:
    """Struct of clauses of at least ``min_len`` characters and the remainder.

    Short pieces join the next one; whatever follows the last mark stays in the remainder.
    """
    parts = F.split(buffer, CLAUSE_BREAK, -1)
    done = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        text = F.concat(state["open"], piece)
        full = F.length(text) >= min_len
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(text))).otherwise(state["out"]).alias("out"),
            F.when(full, F.lit("")).otherwise(text).alias("open"),
        )

    state = F.aggregate(done, start, add)
    return F.struct(state["out"].alias("complete"), F.concat(state["open"], F.element_at(parts, -1)).alias("rest"))
