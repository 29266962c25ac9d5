"""Collocations of two and three words, grown from their prefixes best first.

One pass counts words and pairs.  A phrase of three words is counted only where a bound from its prefix and
one from its suffix let it reach a language's threshold, or where its count decides whether a pair above the
threshold falls away:

* of ``w1 w2 w3``, the cut after ``w1`` scores a*a / (f(w1) * f(w2 w3)); as a is at most f(w2 w3) and at most
  f(w1 w2), no extension of ``w1 w2`` scores more than f(w1 w2) / f(w1);
* in the same way no phrase that ends in ``w2 w3`` scores more than f(w2 w3) / f(w3).

Thresholds begin at the score of a rank well beyond the number wanted and fall until each language has that
many survivors above its threshold; nothing below it can then be among them, ties included.  Languages that
are settled leave the frontier.  The frontier goes to the tasks as bits of a hash, of fixed size: pairs that
hit a bit by chance are only counted needlessly.

A task sums what it has read before anything is shuffled, so that a frequent word or phrase is one row per
task, and languages are ranked in parts first.  Scores are whole numbers from decimals of 38 digits.

Null and empty texts have no words; a null language is ``und``.  Repeated rows count each time.  Other columns
are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import text_of
from emberline.session import written

LEAST = 10  # occurrences of a candidate
TOP = 2000
SHARE = 50  # a phrase falls away if a longer one holds it in so many of a hundred of its occurrences
SCALE = 1_000_000
STEPS = (2, 16)  # ranks, in multiples of the number wanted, at which thresholds begin and go on; then there is none
BITS = 1 << 24  # of each of the frontier's three sets; a multiple of 64
CHUNK = 1_500_000  # words a task sums at a time
PARTS = 32  # in which a language is ranked first
# Pieces end at a full stop and what else is mapped to it; words end at blanks and tabs.  A-Z become small.
STOP = b"."
TABLE = bytes(ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Numbers(dict):
    """Numbers of words as they come; the end of a piece is -1."""

    def __init__(self):
        super().__init__({STOP: -1})
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def words_of(text: str) -> list[bytes]:
    """Words, with a full stop after each piece."""
    return text.encode().translate(TABLE).replace(STOP, b" . ").split() + [STOP]


def chunks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Language, its words and the text as numbers of words, in parts of bounded size; a part ends with a row."""
    held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            numbers, rows = held.setdefault(lang, (Numbers(), []))
            words = words_of(text)
            rows.append(np.fromiter(map(numbers.__getitem__, words), "i8", len(words)))
            size += len(words)
            if size > most:
                for name, (numbers, rows) in held.items():
                    yield name, numbers.words, np.concatenate(rows)
                held, size = {}, 0
    for name, (numbers, rows) in held.items():
        yield name, numbers.words, np.concatenate(rows)


def _rows(lang: str, size: int, phrases: list[bytes], counts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "size": size, "phrase": [p.decode() for p in phrases], "a": counts.astype("i8")})


def _pairs(text: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a pair begins, and the pairs there as one number each."""
    at = np.flatnonzero((text[:-1] >= 0) & (text[1:] >= 0))
    return at, text[at] * len(words) + text[at + 1]


def _spelt(pairs: np.ndarray, words: list[bytes]) -> list[bytes]:
    first, second = np.divmod(pairs, max(1, len(words)))
    return [words[i] + b" " + words[j] for i, j in zip(first.tolist(), second.tolist())]


def counted(docs: DataFrame, least: int, chunk: int = CHUNK) -> DataFrame:
    """lang, size (words), phrase and a, its occurrences: words and pairs of at least ``least``, and size 0 for all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words, text in chunks(batches, chunk):
            if not words:
                continue
            single = np.bincount(text[text >= 0], minlength=len(words))
            yield _rows(lang, 0, [b""], single.sum(keepdims=True))
            yield _rows(lang, 1, words, single)
            pairs, counts = np.unique(_pairs(text, words)[1], return_counts=True)
            for start in range(0, len(pairs), 200_000):
                some = slice(start, start + 200_000)
                yield _rows(lang, 2, _spelt(pairs[some], words), counts[some])

    found = _texts(docs).mapInPandas(run, "lang string, size int, phrase string, a long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).filter((F.col("size") == 0) | (F.col("a") >= least))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) of columns, exact up to 38 digits; at most SCALE, as a is at most left and right."""
    return F.expr(f"(CAST({SCALE} AS DECIMAL(38,0)) * {a} * {a}) div (CAST({left} AS DECIMAL(38,0)) * {right})")


def _with_count(rows: DataFrame, counts: DataFrame, part: Column, name: str) -> DataFrame:
    """Each row with the count of a part of its phrase, which is a word or a pair as frequent as the row at least."""
    of = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias(name))
    return rows.join(of, (F.col("lang") == F.col("_lang")) & (part == F.col("_part"))).drop("_lang", "_part")


def scored_pairs(counts: DataFrame) -> DataFrame:
    """Pairs with both counts, the score, and the bounds of what begins or ends with them."""
    words, pairs = counts.filter("size = 1"), counts.filter("size = 2").drop("size")
    rows = _with_count(pairs, words, F.substring_index("phrase", " ", 1), "l")
    rows = _with_count(rows, words, F.substring_index("phrase", " ", -1), "r")
    return rows.select("*", score("a", "l", "r").alias("score"), F.expr(f"({SCALE} * a) div l").alias("begins"), F.expr(f"({SCALE} * a) div r").alias("ends"))


def scored_triples(triples: DataFrame, counts: DataFrame) -> DataFrame:
    """Triples with the counts of their lowest cut, the first of equal ones."""
    words, pairs = counts.filter("size = 1"), counts.filter("size = 2")
    rows = _with_count(triples, words, F.substring_index("phrase", " ", 1), "l1")
    rows = _with_count(rows, pairs, F.expr("substr(phrase, instr(phrase, ' ') + 1)"), "r1")
    rows = _with_count(rows, pairs, F.substring_index("phrase", " ", 2), "l2")
    rows = _with_count(rows, words, F.substring_index("phrase", " ", -1), "r2")
    rows = rows.select("*", score("a", "l1", "r1").alias("s1"), score("a", "l2", "r2").alias("s2"))
    first = F.col("s1") <= F.col("s2")
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return rows.select("lang", "phrase", "a", either("l1", "l2").alias("l"), either("r1", "r2").alias("r"), either("s1", "s2").alias("score"))


def thresholds(pairs: DataFrame, rank: int | None) -> DataFrame:
    """lang and tau: a score that at least ``rank`` pairs reach, 0 where there are not as many.

    Scores are counted in steps of a hundred, so that a language has ten thousand rows at most here.
    """
    if rank is None:
        return pairs.groupBy("lang").agg(F.lit(0).cast("long").alias("tau"))
    steps = pairs.groupBy("lang", F.expr("score div 100").alias("step")).count()
    above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    reached = F.max(F.when(F.col("above") >= rank, F.col("step") * 100))
    return steps.withColumn("above", above).groupBy("lang").agg(F.coalesce(reached, F.lit(0)).alias("tau"))


def _bit(lang: str, phrases: list[bytes], bits: int) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(p, seed) % bits for p in phrases), "i8", len(phrases))


def frontier(live: DataFrame, bits: int = BITS) -> np.ndarray:
    """Three sets of pairs, for the columns wanted, grows and closes: ``bits`` bits each, whatever the number of pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, some in batch.groupby("lang"):
                bit = _bit(lang, [p.encode() for p in some["phrase"]], bits)
                for kind, name in enumerate(("wanted", "grows", "closes")):
                    own = bit[some[name].to_numpy(bool)] + kind * bits
                    yield pd.DataFrame({"place": own // 64, "bit": own % 64})

    rows = live.select("lang", "phrase", "wanted", "grows", "closes").mapInPandas(run, "place long, bit int")
    words = rows.groupBy("place").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word")).toPandas()
    out = np.zeros(3 * bits // 64, "<i8")
    out[words["place"].to_numpy("i8")] = words["word"].to_numpy("i8")
    return out.view("u1").reshape(3, -1)


def triples_of(docs: DataFrame, sets: np.ndarray, least: int, chunk: int = CHUNK) -> DataFrame:
    """Phrases of three words of the frontier with their occurrences: those that hold a wanted pair, or grow from one pair and close with another."""
    bits = sets.shape[1] * 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words, text in chunks(batches, chunk):
            at, key = _pairs(text, words)
            if len(at) < 2:
                continue
            pairs, which = np.unique(key, return_inverse=True)
            spelt = _spelt(pairs, words)
            bit = _bit(lang, spelt, bits)
            wanted, grows, closes = (((sets[kind][bit >> 3] >> (bit & 7)) & 1).astype(bool) for kind in range(3))
            first, second = which[:-1], which[1:]
            live = (np.diff(at) == 1) & (wanted[first] | wanted[second] | grows[first] & closes[second])
            found, counts = np.unique(first[live] * len(words) + text[at[:-1][live] + 2], return_counts=True)
            pair, last = np.divmod(found, len(words))
            phrases = [spelt[i] + b" " + words[j] for i, j in zip(pair.tolist(), last.tolist())]
            for start in range(0, len(phrases), 200_000):
                some = slice(start, start + 200_000)
                yield _rows(lang, 3, phrases[some], counts[some])

    found = _texts(docs).mapInPandas(run, "lang string, size int, phrase string, a long")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def surviving(pairs: DataFrame, triples: DataFrame, share: int) -> DataFrame:
    """Pairs that no triple stands for, and all triples."""
    inside = triples.select("lang", F.substring_index("phrase", " ", 2).alias("phrase"), "a").unionByName(
        triples.select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a")
    )
    greatest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = pairs.join(greatest, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    return kept.select(columns).unionByName(triples.select(columns))


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, steps: tuple[int, ...] = STEPS, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    counts = written(counted(docs, least, chunk), "counts", "size")
    open_ = written(scored_pairs(counts), "pairs")
    settled: list[DataFrame] = []
    for rank in [*(top * step for step in steps), None]:
        reach = written(thresholds(open_, rank), "thresholds")
        over = lambda name: F.col(name) >= F.col("tau")
        with_tau = open_.join(reach, "lang")
        live = with_tau.filter(over("begins") | over("ends")).select("lang", "phrase", over("score").alias("wanted"), over("begins").alias("grows"), over("ends").alias("closes"))
        triples = written(triples_of(docs, frontier(live, bits), least, chunk), "triples")
        scored = written(scored_triples(triples, counts), "scored")
        rows = surviving(with_tau.filter(over("score")).drop("tau"), scored, share).join(reach, "lang").filter(over("score"))
        rows = written(rows, "survivors")
        enough = written(rows.groupBy("lang", "tau").count().join(reach, ["lang", "tau"], "right").filter((F.col("tau") == 0) | (F.col("count") >= top)).select("lang"), "settled")
        settled.append(_ranked(rows.join(enough, "lang", "left_semi"), top))
        open_ = open_.join(enough, "lang", "left_anti")
        if open_.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    total = counts.filter("size = 0").select("lang", F.col("a").alias("n"))
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS piece FROM texts),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(words) AS phrase FROM lists
  UNION ALL
  SELECT lang, k AS size, array_to_string(words[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM lists, (VALUES (2), (3)) AS ks(k) WHERE len(words) >= k)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY ALL),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM candidates c, (VALUES (1), (2)) AS ks(k), counts x, counts y
  WHERE k < c.size AND x.lang = c.lang AND y.lang = c.lang
    AND x.phrase = array_to_string(c.words[1 : k], ' ') AND y.phrase = array_to_string(c.words[k + 1 : c.size], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
inside AS (
  SELECT lang, part AS phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(words[1 : 2], ' '), array_to_string(words[2 : 3], ' ')]) AS part FROM candidates WHERE size = 3)
  GROUP BY ALL),
kept AS (
  SELECT lang, phrase, a, l, r, score FROM lowest LEFT JOIN inside USING (lang, phrase)
  WHERE place = 1 AND (size = 3 OR longer IS NULL OR 100 * longer < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
