import math
import random
import re
from collections import Counter

import pytest
from conftest import AWKWARD

from emberline.llm import normsearch as s


def split(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(s.TERMS, small)


def by_hand(docs, items, top):
    """Every item against every document."""
    counts = [(i, Counter(split(t)), len(split(t))) for i, t in docs if split(t)]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    out = []
    for item, text in items:
        found = []
        for doc_id, tf, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = 0
            for term in split(text):
                df = sum(term in c for _, c, _ in counts)
                if term in tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf[term]) // (1000 * tf[term] + 12 * m))
            if score > 0:
                found.append((-score, math.inf if doc_id is None else doc_id, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(found, key=lambda x: x[:2])[:top], 1)]
    return out


def rows(spark, kind, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], f"{kind}_id long, text string, rank string, score long")


def key(row):
    return tuple(repr(x) for x in row)


@pytest.mark.parametrize("seed,block,longest", [(1, 500_000, 5), (2, 60, 40)])
def test_equals_every_pair(spark, seed, block, longest):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    text = lambda most: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, most)))
    docs = [(i, text(60)) for i in range(150)] + [(500 + i, "w1 w2 W3, w7") for i in range(40)] + [(None, "w1 w39 w38"), (7, "w5 w5"), (7, "w5 w5")]
    docs += [(1000 + i, t) for i, t in enumerate(AWKWARD)]
    items = [(i, text(12)) for i in range(12)] + [(100, None), (101, "!"), (102, "nowhere"), (103, "w1 w1 w1 w2"), (103, "w9"), (104, "漢字 é ONE one")]
    got = s.rank(rows(spark, "doc", docs), rows(spark, "item", items), top=6, block_terms=block, longest=longest).collect()
    assert sorted(map(tuple, got), key=key) == sorted(by_hand(docs, items, 6), key=key)


def test_buckets_leave_out_most_vectors(spark):
    """A bucket of short vectors is not read once the thresholds are high."""
    block = [(0, {b"a": 1, b"b": 1}), (1, {b"c": 3})]
    queries = s.Queries(block)
    queries.weigh(s.np.array([100, 50, 10]))
    table = s.pd.DataFrame({"doc_id": [1, 2, 3], "terms": [s.np.array([0, 1]), s.np.array([0]), s.np.array([2])], "values": [s.np.array([9, 9]), s.np.array([8]), s.np.array([5])], "norm": [162**0.5, 8.0, 5.0]})
    best = s.Best(2, 1, [0, 0])
    assert s.search_bucket(s.Bucket(table), queries, best, s.np.zeros(3, "i8")) == 4  # the first query cannot rule out the third vector yet
    assert [x.tolist() for x in best.rows[0]] == [[1], [1350]] and [x.tolist() for x in best.rows[1]] == [[3], [150]]
    assert s.search_bucket(s.Bucket(table.iloc[1:]), queries, best, s.np.zeros(3, "i8")) == 1  # the row that holds the second query's best again


def test_nothing_to_search(spark):
    docs, items = rows(spark, "doc", [(1, "a b")]), rows(spark, "item", [(1, "a")])
    assert s.rank(docs.filter("false"), items).count() == s.rank(docs, items.filter("false")).count() == 0
    assert s.rank(docs, items).collect()[0]["doc_id"] == 1
    assert s.rank(rows(spark, "doc", [(1, None), (2, " ")]), items).count() == 0
