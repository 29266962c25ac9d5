"""Toxicity by how well windows compress with dictionaries of toxic and of ordinary text.

Two zstandard dictionaries are trained, one on what toxic documents say and ordinary ones hardly ever do,
one on ordinary windows.  Every distinct word of a document stands for 16 bytes of its hash, in order of
first use, and windows are eight such words: bytes that no compressor can shorten by itself, so that a
window gets shorter only by words that a dictionary holds.  A window that the toxic dictionary makes
shorter than storing it counts with what it saved, and with what the ordinary dictionary saves on it.  A
logistic curve over these lengths, fitted on other labelled documents than the dictionaries, gives the score.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled documents of each class, those with
the least hash of their id.  In the fit of the curve each class weighs as much as all its labelled documents
that are not held out, so that the threshold does not move with the size of the input.  Everything is scored, each row by itself.  Null and empty texts save nothing
and get the score of a document without toxic words; rows with equal texts get equal scores.  Without
labels of both classes the curve has fixed weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_of

SAMPLE = 5000
UNIT, WINDOW = 16, 8 * 16
TOXIC_WORDS, ORDINARY_BYTES = 512, 16_384
CONTRAST = 20  # times as frequent in toxic documents
LEAST_DOCS, LEAST_SHARE = 3, 0.01  # of the toxic documents
STORED = 5  # bytes that a window gets longer by if nothing matches
LEVEL = 3
MEMO = 400_000
OTHER = bytes(i for i in range(128) if not chr(i).isalnum())
SPACES = bytes.maketrans(OTHER, b" " * len(OTHER))


class Units:
    """Windows of a text: its distinct words as hashes."""

    def __init__(self):
        self.memo: dict[bytes, bytes] = {}

    def __call__(self, text: str) -> list[bytes]:
        words = text.lower().encode().translate(SPACES).split()
        if len(self.memo) > MEMO:
            self.memo.clear()
        try:
            units = map(self.memo.__getitem__, words)
            return list(dict.fromkeys(units))
        except KeyError:
            for word in words:
                if word not in self.memo:
                    self.memo[word] = xxhash.xxh3_128_digest(word)
            return list(dict.fromkeys(map(self.memo.__getitem__, words)))


def windows(units: list[bytes]) -> list[bytes]:
    data = b"".join(units)
    return [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]


def trained(samples: list[bytes], size: int, step: int) -> bytes:
    """A dictionary's content; few samples are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=step, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray  # of the features, the constant last

    def lengths(self, which: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        held = zstandard.ZstdCompressionDict(which) if which else None
        return zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress

    def features(self, texts: list[str]) -> np.ndarray:
        units, toxic, ordinary = Units(), self.lengths(self.toxic), self.lengths(self.ordinary)
        rows = np.zeros((len(texts), 4))
        for i, text in enumerate(texts):
            found = units(text)
            saved, beside = [], 0
            for window in windows(found):
                plain = len(window) + STORED
                length = len(toxic(window))
                if length < plain:
                    saved.append(plain - length)
                    beside += plain - len(ordinary(window))
            if saved:
                rows[i] = np.log1p(sum(saved)), np.log1p(max(saved)), sum(saved) / (len(found) + 8), beside / len(saved) / WINDOW
        return rows

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, weigh: np.ndarray | None = None) -> np.ndarray:
    """Weights and constant by Newton steps; ``weigh`` says how much each row counts."""
    x = np.column_stack([x, np.ones(len(x))])
    weigh = np.ones(len(x)) if weigh is None else weigh
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weigh * p * (1 - p))) @ x + penalty, x.T @ (weigh * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: list[tuple[object, str, int]], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """From (id, text, label) rows: a fifth of them calibrates, the others train the dictionaries.

    ``stands_for`` is how many labelled documents a sampled one stands for, by label.
    """
    calibrates = [zlib.crc32(str(key).encode()) % 5 == 4 for key, _, _ in sample]
    units = Units()
    said = {label: [units(text) for (_, text, y), out in zip(sample, calibrates) if y == label and not out] for label in (0, 1)}
    counts = {label: Counter(u for words in said[label] for u in words) for label in (0, 1)}
    share = {label: lambda u, c=counts[label], n=len(said[label]) + 1: (c[u] + 0.5) / n for label in (0, 1)}
    least = max(LEAST_DOCS, LEAST_SHARE * len(said[1]))
    telling = {u for u, n in counts[1].items() if n >= least and share[1](u) >= CONTRAST * share[0](u)}
    toxic = [b"".join(u for u in words if u in telling) for words in said[1]]
    ordinary = [w for words in said[0] for w in windows([u for u in words if u not in telling])]
    held_toxic = trained([t for t in toxic if t], TOXIC_WORDS * UNIT // 2, UNIT)
    # the trainer works by stretches of its samples and may pass over a word; the most frequent come last, where matches are cheapest
    passed = sorted((u for u in telling if u not in held_toxic), key=lambda u: (counts[1][u], u))[-TOXIC_WORDS:]
    model = Model(held_toxic + b"".join(passed), trained(ordinary[:: len(ordinary) // 60_000 + 1], ORDINARY_BYTES, 2 * UNIT), np.array([2.0, 0.0, 0.0, 0.0, -4.0]))
    held = [(text, y) for (_, text, y), out in zip(sample, calibrates) if out]
    if {y for _, y in held} == {0, 1}:
        y = np.array([y for _, y in held])
        model.weights = logistic(model.features([t for t, _ in held]), y, weigh=np.array(stands_for)[y])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents that are not held out.  Their ids are at most twice ``sample``, which bounds the broadcast."""
    known = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    each = known.dropDuplicates(["doc_id", "toxic"])
    ids = [each.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)]
    counts = {r["toxic"]: r["count"] for r in each.filter(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    stands_for = tuple(max(counts.get(y, 0) / sample, 1.0) for y in (0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [row for batch in batches for row in zip(*(batch[name].tolist() for name in ("doc_id", "text", "toxic")))]
        if found:
            model = fit(sorted(found), stands_for)
            yield pd.DataFrame({"toxic": [model.toxic], "ordinary": [model.ordinary], "weights": [model.weights]})

    # a task holds the sample and its words, not the driver
    one = rows.repartition(1).mapInPandas(run, "toxic binary, ordinary binary, weights array<double>").first()
    return Model(bytes(one["toxic"]), bytes(one["ordinary"]), np.array(one["weights"])) if one else fit([], stands_for)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = model.scores(batch["text"].tolist())
            yield batch[["doc_id", "held_out"]].assign(score=scores, predicted=(scores >= 0.5).astype("i4"))

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not toxic; the rows do not move."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist()))

    return docs.filter(scores(text_of()) < 0.5)
