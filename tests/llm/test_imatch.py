import hashlib
import random

import numpy as np
from conftest import AWKWARD
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from emberline.llm import imatch as im


def edited(rows):
    """(id, text) to the edited text by hand, and the id of the next."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)]
        yield key, len(text), hashlib.sha256((text[: len(text) - len(text) // 3] + (after[1] or "")[: len(text) // 3]).encode()).hexdigest()


def test_neighbours_over_many_buckets(spark, documents):
    rng = random.Random(6)
    texts = [*AWKWARD, *(" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "é漢🙂"], k=rng.randint(0, 40))) for _ in range(120))]
    ids = [rng.choice([None, 7, 8]) if i % 40 == 0 else rng.randint(-(10**6), 10**15) for i in range(len(texts))]
    docs = documents(texts, ids=ids)
    want = sorted(edited(list(zip(ids, texts))), key=str)
    words = im.lexicon(docs, 0.01, 0.5)
    for size, bounds in ((10**9, 1024), (2_000, 1024), (500, 4)):
        rows = im.with_neighbours(docs, words, size, bounds).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == want
    by = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    marks = im.fingerprints(docs, words).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in marks:
        if ids.count(r["doc_id"]) == 1:
            by.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    alone = im.with_neighbours(documents(["only one text"]), words).collect()
    assert [(r["near_next"], r["n_chars"]) for r in alone] == [(1.0, 13)]
    assert im.with_neighbours(docs.filter("false"), words).count() == 0 and len(im.lexicon(docs.filter("false"))) == 0


def test_lexicon_counts_all_documents(spark, documents):
    docs = documents(["a b b", "a c", "a b d", None, "B e"])
    got = {r["term"]: r["n_docs"] for r in im.document_frequencies(docs).collect()}
    assert sorted(got.values()) == [1, 1, 1, 3, 3]


def test_masks_have_their_rates():
    bits = im.masks(np.random.default_rng(1).integers(0, 2**63, 200_000).astype("u8"))
    for level, rate in enumerate(im.RATES):
        for k in range(im.SUBSETS):
            share = ((bits >> np.uint64(level * im.SUBSETS + k)) & np.uint64(1)).mean()
            assert abs(share * rate - 1) < 0.2


def test_edits_are_nearer_than_strangers(spark):
    rows = entry_module.queries()["op8_fingerprints"](spark, "/root/testdata/sf0.01").filter("n_chars > 200")
    near, far, ahead = rows.agg(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()
    print(near, far, ahead)
    assert near > 0.3 and far < 0.1 and ahead > 0.9
