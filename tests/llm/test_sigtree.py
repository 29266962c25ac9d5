import random
from itertools import combinations

import numpy as np
import pytest
from conftest import AWKWARD

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from emberline.llm import sigtree as st


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id, size and least id of the component, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = {}
    for i, s in enumerate(sets):
        for w in s:
            at.setdefault(w, []).append(i)
    pairs = {p for found in at.values() for p in combinations(found, 2)}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("block", [st.BLOCK_BYTES, 2_000])
def test_components_equal_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(st, "BLOCK_BYTES", block)
    monkeypatch.setattr(st, "LONG_RUN", 50 if block < 10_000 else st.LONG_RUN)
    rng = random.Random(9)
    line = " ".join(f"common{i}" for i in range(30))
    texts = [*AWKWARD, *near_copies(rng, 70, 60, 3), *near_copies(rng, 40, 200, 12), *near_copies(rng, 30, 24, 2), "one two three four", "One two three four", "a b c d e", "A b c d e"]
    texts += [line + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 90))) for _ in range(60)]
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 40, 4)]
    ids = [None if rng.random() < 0.03 else rng.randrange(10**6) for _ in texts]
    ids[30] = ids[20]
    docs = documents(texts, ids=ids).repartition(5)
    got = sorted((tuple(r) for r in st.similar(docs).collect()), key=str)
    assert got == brute(list(zip(ids, texts)))
    assert st.similar(docs.filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_trees_lose_no_pair(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = np.unique(st.mixed(rng.integers(0, 2**63, rng.integers(3, 300)).astype("u8")))
        for _ in range(rng.integers(1, 30)):
            new = st.mixed(rng.integers(0, 2**63, rng.integers(0, len(base) // 4 + 1)).astype("u8"))
            sets.append(np.unique(np.concatenate([rng.permutation(base)[len(new) // 2 :], new])))
    sizes = np.array([len(s) for s in sets])
    bits = [st.bitmap(s).tobytes() for s in sets]
    names = np.arange(len(sets))
    links = {(i, j) for i, j in combinations(range(len(sets)), 2) if st.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j])}
    pairs, trees = set(), st.octaves(names, sizes, bits)
    for length, (rows, tree, _) in trees.items():
        for other, b in ((rows, tree), *((trees[2 * length][::2],) if 2 * length in trees else ())):
            pairs |= {tuple(sorted((rows[x], other[y]))) for found in st.plausible(tree, b) for x, y in found}
    assert links <= pairs and len(pairs) < len(sets) * (len(sets) - 1) / 4
    forest = st.bucket_pairs(names, sizes, bits, None, None)
    assert len(forest) < len(sets) and set(forest) <= pairs
    exact = st.bucket_pairs(names, sizes, bits, names // 2, None, sets)
    assert set(exact) <= links

    def groups(edges):
        label = list(range(len(sets)))
        for i, j in edges:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}

    halves = {(2 * k, 2 * k + 1) for k in range(len(sets) // 2)}
    assert groups(halves | links) == groups(halves | set(exact))


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in entry_module.queries()["op7_similar"](spark, folder).collect()), key=str) == brute(rows)


def test_texts_that_stay_are_not_moved(spark, documents):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(300)]
    docs = documents([*texts, *texts[:9], texts[0]], ids=[*range(309), 0])
    kept = st.deduplicated(docs)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == list(enumerate(texts))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join") and plan.count("perhaps(xxhash64") == plan.count("ArrowEvalPython") > 1
    hashes = docs.select(F.xxhash64("text").alias("text_hash"))
    every = np.array([r["text_hash"] for r in hashes.collect()])
    wanted = st.bloom(hashes.limit(20))
    assert st.in_bloom(wanted, every[:20]).all() and st.in_bloom(wanted, every).sum() < 100
    assert not st.in_bloom(st.bloom(hashes.filter("false")), every).any()


def test_only_texts_of_wanted_classes_are_cut(spark, documents, monkeypatch):
    calls, real = spark.sparkContext.accumulator(0), st.shingles

    def counted(text):
        calls.add(1)
        return real(text)

    docs = documents([f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(400)])
    found = st.marks(docs)
    monkeypatch.setattr(st, "shingles", counted)
    wanted = found.filter("doc_id in (3, 5)").select("class", "text_hash")
    got = {r["class"]: r["shingles"] for r in st.sets_of(docs, wanted).collect()}
    assert set(got) == {r["class"] for r in wanted.collect()} and all(len(x) == 2 for x in got.values())
    assert 2 <= calls.value < 100
