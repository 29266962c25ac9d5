"""Quality by co-training two views of a document.

One view sees what a text says: shares of words by hash, of kinds of characters, and of lines and words
that repeat.  The other sees its page: source, language, length and shape of lines.  Each view has a
logistic classifier.  Over some rounds each classifier scores all documents, and its most confident
pseudo-labels of either class go to the other view, whose classifier is fitted again.  In the end both
are calibrated on labelled documents that neither was fitted on, and their calibrated log-odds are
combined by a third curve.

Classifiers are fitted on at most ``SAMPLE`` labelled documents and at most ``EXCHANGE`` pseudo-labels per
class, view and round; the features are made once, written, and all documents are scored from them in every
round.  Pseudo-labels are chosen by order of confidence over all documents without a label, which Spark
keeps to the top rows.  Null and empty texts are documents without words; null languages and sources are a value of
their own.  Without labels of both classes all scores are the share of good labels, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_of
from emberline.llm.toxicity import held_out, logistic
from emberline.session import written

SAMPLE, EXCHANGE, ROUNDS = 20_000, 500, 3
HASHED, PLACES = 64, 32
CONFIDENT = 0.9
MEMO = 400_000


def content(text: str, memo: dict[bytes, int]) -> np.ndarray:
    """Shares of hashed words, of characters by kind, and of what repeats."""
    words = text.encode().split()
    if len(memo) > MEMO:
        memo.clear()
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w.lower().strip(b".,;:!?")) % HASHED
    n = max(1, len(words))
    bag = np.bincount(np.fromiter(map(memo.__getitem__, words), "i8", len(words)), minlength=HASHED) / n
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    low = np.bincount(np.minimum(codes, 127), minlength=128)
    m = max(1, len(codes))
    upper, digit, space = low[65:91].sum(), low[48:58].sum(), low[[9, 10, 13, 32]].sum()
    letters = upper + low[97:123].sum() + low[127]
    kinds = np.array([upper, digit, space, letters, m - letters - digit - space, low[33], low[124], low[46], low[44]]) / m
    lines = text.split("\n")
    repeats = [1 - len(set(words)) / n, 1 - len(set(lines)) / len(lines), len(max(words, key=len, default=b"")) / (20 + len(text)) ** 0.5, len(text) / n / 10]
    return np.concatenate([np.sqrt(bag), np.sqrt(np.maximum(kinds, 0)), repeats])


def page(source, lang, text: str) -> np.ndarray:
    """Source and language by hash, length, and the shape of the lines."""
    row = np.zeros(PLACES + 8)
    row[xxhash.xxh3_64_intdigest(f"s{source}") % PLACES] = row[xxhash.xxh3_64_intdigest(f"l{lang}") % PLACES] = 1
    lines = text.count("\n") + 1
    head = text[: text.find("\n")] if "\n" in text else text
    row[PLACES:] = [
        np.log1p(len(text)) / 5, np.log1p(lines) / 3, np.log1p(len(text) / lines) / 5, np.log1p(len(head)) / 5,
        float(text.endswith((".", "!", "?"))), float(not text), len(text) < 200, len(text) > 20_000,
    ]
    return row


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Written once: doc_id, key (unique per row), held_out, quality, and both views as arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            said = [content(t, memo).astype("f4") for t in batch["text"]]
            seen = [page(s, g, t).astype("f4") for s, g, t in zip(batch["source"], batch["lang"], batch["text"])]
            yield batch[["doc_id", "held_out", "chance"]].assign(said=said, seen=seen)

    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.xxhash64(F.col("doc_id"), text).alias("chance"),
        F.col("source").cast("string"), F.col("lang").cast("string"), text.alias("text"),
    )
    made = written(rows.mapInPandas(run, "doc_id long, held_out boolean, chance long, said array<float>, seen array<float>"), "views")
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    return written(made.join(marks, "doc_id", "left").withColumn("quality", F.when(~F.col("held_out"), F.col("quality"))), "labelled-views")


def _matrix(rows, view: str) -> np.ndarray:
    return np.array([r[view] for r in rows], "f8").reshape(len(rows), -1)


def _odds(views: dict[str, np.ndarray]):
    """A column function for each view: log-odds of its classifier."""

    def of(view: str):
        w = views[view]

        @F.pandas_udf("double")
        def odds(x: pd.Series) -> pd.Series:
            return pd.Series(np.stack(x.to_numpy()).astype("f8") @ w[:-1] + w[-1] if len(x) else [], dtype="f8")

        return odds(view)

    return {view: of(view) for view in views}


def score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, content_score, page_score, score (0 to 1, higher is better) and predicted, for every row."""
    made = features(docs, labels)
    known = made.filter("quality is not null").orderBy("chance", "doc_id").limit(SAMPLE).collect()
    y = np.array([r["quality"] for r in known], "f8")
    calibrates = np.array([r["chance"] % 4 == 0 for r in known], bool)
    if len(set(y[calibrates])) < 2 or len(set(y[~calibrates])) < 2:
        flat = F.lit(float(y.mean()) if len(y) else 0.5)
        return made.select("doc_id", "held_out", flat.alias("content_score"), flat.alias("page_score"), flat.alias("score"), (flat >= 0.5).cast("int").alias("predicted"))
    given = {view: (_matrix(known, view)[~calibrates], y[~calibrates]) for view in ("said", "seen")}
    views = {view: logistic(x, t, 1.0) for view, (x, t) in given.items()}
    other = {"said": "seen", "seen": "said"}
    free = made.filter("quality is null and not held_out")
    for _ in range(rounds):
        odds, taken = _odds(views), {}
        sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
        for view in views:  # what one view is sure of is a label for the other
            scored = free.select(odds[view].alias("odds"), "chance", other[view]).filter(F.abs("odds") > sure)
            best = [scored.filter(side).orderBy(F.desc(F.abs("odds")), "chance").limit(EXCHANGE).collect() for side in ("odds > 0", "odds < 0")]
            # as many of each class as the scarcer has, in the shares of the labels
            share = min(len(best[0]) / max(y.mean(), 1e-9), len(best[1]) / max(1 - y.mean(), 1e-9))
            rows = best[0][: int(share * y.mean())] + best[1][: int(share * (1 - y.mean()))]
            taken[other[view]] = (_matrix(rows, other[view]), np.array([float(r["odds"] > 0) for r in rows])) if rows else None
        for view, more in taken.items():
            x, t = given[view]
            if more is not None:
                x, t = np.vstack([x, more[0]]), np.concatenate([t, more[1]])
            views[view] = logistic(x, t, 1.0)
    held = [r for r, out in zip(known, calibrates) if out]
    truth = y[calibrates]
    raw = {view: _matrix(held, view) @ w[:-1] + w[-1] for view, w in views.items()}
    curves = {view: logistic(raw[view][:, None], truth) for view in views}
    both = logistic(np.column_stack([raw[v] * curves[v][0] + curves[v][1] for v in views]), truth)
    odds = _odds(views)
    calibrated = {v: odds[v] * float(curves[v][0]) + float(curves[v][1]) for v in views}
    rows = made.select("doc_id", "held_out", calibrated["said"].alias("a"), calibrated["seen"].alias("b"))
    final = 1 / (1 + F.exp(-(F.col("a") * float(both[0]) + F.col("b") * float(both[1]) + float(both[2]))))
    rows = rows.select("doc_id", "held_out", (1 / (1 + F.exp(-F.col("a")))).alias("content_score"), (1 / (1 + F.exp(-F.col("b")))).alias("page_score"), final.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
