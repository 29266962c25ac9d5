"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms within a band of inverse document frequency: common words say little, and rare
ones are no evidence that texts agree.  Both ends are shares of the number of documents, so that the
lexicon cannot hold more than (mean distinct terms of a document) / ``LEAST`` terms, whatever the corpus.
A fingerprint has one part for the whole lexicon and ``SUBSETS`` parts for random subsets at each of some
rates; a part is a hash of the document's sorted distinct terms in that subset, and marked empty if there
are none.  Sparse subsets survive edits in long texts, dense ones tell short texts apart.

A document without lexicon terms takes all its words as terms, and one without words has empty parts and
the hash of its text.  Equal texts have equal fingerprints.  Terms are counted by a shuffle of their
hashes with sums before it; the lexicon goes to the tasks after its size was checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import text_of
from emberline.session import written

LEAST, MOST = 0.0005, 0.05  # shares of the documents: inverse document frequencies of 20 to 2,000
LEXICON_LIMIT = 4_000_000
SUBSETS, RATES = 16, (4, 16, 64, 256)  # one of so many terms is in a subset
DIGITS = 4
EMPTY = "-" * DIGITS
MEMO = 400_000


def terms(text: str) -> list[bytes]:
    return text.lower().encode().split()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (hash) and n_docs.  A task sums over many documents before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, waiting, rows = {}, [], 0

        def totals() -> pd.DataFrame:
            term, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pd.DataFrame({"term": term.view("i8"), "n": n.astype("i8")})

        for batch in batches:
            for text in batch["text"]:
                hashes = _hashes(terms(text), memo)
                waiting.append(np.unique(hashes))
                rows += len(waiting[-1])
            if rows > 4_000_000:
                yield totals()
                waiting, rows = [], 0
        if waiting:
            yield totals()

    counted = docs.select(text_of().alias("text")).mapInPandas(count, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_docs"))


def _hashes(words: list[bytes], memo: dict[bytes, bytes]) -> np.ndarray:
    if len(memo) > MEMO:
        memo.clear()
    for word in words:
        if word not in memo:
            memo[word] = xxhash.xxh3_64_digest(word)
    return np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u8")


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted hashes of the terms in the band, at least two documents each."""
    n = docs.count()
    band = written(document_frequencies(docs).filter(F.col("n_docs").between(max(2, least * n), max(2, most * n))).select("term"), "lexicon")
    if band.count() > LEXICON_LIMIT:
        raise ValueError("the band holds too many terms; raise its lower end")
    return np.sort(band.toPandas()["term"].to_numpy("i8").view("u8"))


def masks(hashes: np.ndarray) -> np.ndarray:
    """A bit for each subset: whether the term is in it.  Subsets of the rate 4 ** k need k pairs of random bits."""
    wide = np.uint64(0xFFFF)
    chunks = []
    for k in range(sum(2 * n for n in range(1, len(RATES) + 1)) // 4):
        x = (hashes + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        chunks += [(x >> np.uint64(16 * i)) & wide for i in range(4)]
    out, chunks = np.zeros(len(hashes), "u8"), iter(chunks)
    for level in range(len(RATES)):
        bits = next(chunks)
        for _ in range(2 * (level + 1) - 1):
            bits = bits & next(chunks)
        out |= bits << np.uint64(SUBSETS * level)
    return out


class Fingerprinter:
    """Fingerprints as parts of ``DIGITS`` characters: the whole lexicon, then the subsets, dense ones first."""

    def __init__(self, words: np.ndarray):
        self.lexicon, self.masks, self.memo = words, masks(words), {}
        self.shifts = np.arange(SUBSETS * len(RATES), dtype="u8")

    def __call__(self, text: str) -> str:
        found = np.unique(_hashes(terms(text), self.memo))
        if not len(found):
            return xxhash.xxh3_64_hexdigest(text.encode())[:DIGITS] + EMPTY * len(self.shifts)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, found), len(self.lexicon) - 1)
            at = at[self.lexicon[at] == found]
        else:
            at = []
        kept, bits = (self.lexicon[at], self.masks[at]) if len(at) else (found, masks(found))
        inside = (bits[:, None] >> self.shifts) & np.uint64(1) == 1
        parts = [xxhash.xxh3_64_hexdigest(kept.tobytes())[:DIGITS], *[EMPTY] * len(self.shifts)]
        for k in np.flatnonzero(inside.any(axis=0)):
            parts[k + 1] = xxhash.xxh3_64_hexdigest(kept[inside[:, k]].tobytes())[:DIGITS]
        return "".join(parts)


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, otherwise the best share of agreeing parts of any rate at which enough parts hold terms."""
    if a == b:
        return 1.0
    best, step = 0.0, DIGITS * SUBSETS
    for start in range(DIGITS, len(a), step):
        pairs = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(start, start + step, DIGITS)]
        pairs = [(x, y) for x, y in pairs if x != EMPTY or y != EMPTY]
        if len(pairs) >= SUBSETS // 4:
            best = max(best, sum(x == y for x, y in pairs) / len(pairs))
    return best


def fingerprints(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id and fingerprint of every row; the rows do not move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Fingerprinter(words)
        for batch in batches:
            yield batch[["doc_id"]].assign(fingerprint=list(map(one, batch["text"])))

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInPandas(run, "doc_id long, fingerprint string")


NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
LOWEST = -(1 << 63)  # stands for a null id, which comes last


def with_neighbours(docs: DataFrame, words: np.ndarray, bucket_chars: int = 8_000_000, most_bounds: int = 1024) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document by descending id.

    The edited text ends with the start of the next document instead of its last third.  Documents are
    dealt once to buckets of id ranges, at quantiles of the ids, and sorted; the first document of each
    bucket also goes to the bucket before it, and that of the first bucket to the last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // bucket_chars))
    shares = [i / min(n, most_bounds) for i in range(1, min(n, most_bounds))]
    bounds = sorted(set(rows.agg(F.percentile_approx("key", shares, 20_000)).first()[0] or [])) if shares else []
    split = -(-n // (len(bounds) + 1))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("key"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("long") * split)
    if split > 1 and bounds:  # more buckets than bounds: ids are dealt evenly inside
        low = F.coalesce(F.get(F.array(*map(F.lit, bounds)), (F.col("bucket") / split).cast("int") - 1), F.lit(bounds[0] - 1))
        high = F.coalesce(F.get(F.array(*map(F.lit, bounds)), (F.col("bucket") / split).cast("int")), F.lit(bounds[-1] + 1))
        part = F.floor((F.col("key").cast("double") - low) / F.greatest(high - low, F.lit(1)) * split)
        rows = rows.withColumn("bucket", F.col("bucket") + F.least(F.greatest(part, F.lit(0)), F.lit(split - 1)))
    tops = rows.groupBy("bucket").agg(F.max("key").alias("top"))
    tops = written(tops, "bucket-tops")
    first = tops.agg(F.min("bucket")).first()[0]
    before = F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.lit(first))
    borders = tops.select("top", before.alias("to"))
    borders = F.broadcast(borders) if n <= 100_000 else borders
    rows = rows.join(borders, rows["key"] == borders["top"], "left")
    goes = F.when(F.col("to").isNull(), F.array(F.struct("bucket", F.lit(0).alias("border"))))
    goes = goes.otherwise(F.array(F.struct("bucket", F.lit(0).alias("border")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("border"))))
    rows = rows.select("doc_id", "key", "text", F.explode(goes).alias("at")).select("doc_id", "key", "text", "at.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, last = Fingerprinter(words), None
        for batch in batches:
            out = []
            for doc_id, text, bucket, border in zip(batch["doc_id"], batch["text"], batch["bucket"], batch["border"]):
                here = (doc_id, text, bucket, border, one(text))
                if last is not None and last[2] == bucket and not last[3]:
                    n_chars = len(last[1])
                    edited = last[1][: n_chars - n_chars // 3] + text[: n_chars // 3]
                    mark = one(edited)
                    key = None if pd.isna(last[0]) else int(last[0])
                    out.append((key, n_chars, hashlib.sha256(edited.encode()).hexdigest(), last[4], mark, likeness(last[4], mark), likeness(last[4], here[4])))
                last = here
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in NEIGHBOURS.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    dealt = rows.repartition(int(n), "bucket").sortWithinPartitions("bucket", "border", F.desc("key"), "text")
    return dealt.select("doc_id", "text", "bucket", "border").mapInPandas(run, NEIGHBOURS)
