from collections import Counter

import pytest
import test_sigtree
from test_placement import filled, number

import corpus_pipeline as p
from emberline.llm import decontaminate as d
from emberline.llm import placement, toxicity
from emberline.session import written

FOLDER = "/root/testdata/sf0.001"


def keep_one(rows):
    least = {doc_id: c for doc_id, n, c in test_sigtree.brute([(r["doc_id"], r["text"]) for r in rows])}
    return [r for r in rows if least[r["doc_id"]] == r["doc_id"]]


def without_runs(rows, items):
    def words(text):
        return "".join(c if c.isalnum() else " " for c in text.lower()).split()

    runs = {tuple(w[i : i + d.RUN]) for w in map(words, items) for i in range(len(w) - d.RUN + 1)}
    return [r for r in rows if not any(tuple(w[i : i + d.RUN]) in runs for w in [words(r["text"])] for i in range(len(w)))]


def copies(rows):
    """How often each document is in the mix, by plain loops."""
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in rows}
    sources = sorted({r["source"] for r in rows})
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, rest, free = {}, 1.5 * sum(total.values()), set(sources)
    while True:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        if not full:
            break
        target |= {s: 2.0 * total[s] for s in full}
        rest, free = rest - sum(2 * total[s] for s in full), free - full
    target |= {s: level * weight[s] for s in free}
    found = Counter()
    for s in sources:
        at = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (number(f"{r['doc_id']}|{size[r['doc_id']]}"), r["doc_id"])):
            found[r["doc_id"]] = sum(at + e * total[s] < int(target[s]) for e in (0, 1))
            at += size[r["doc_id"]]
    return {k: v for k, v in found.items() if v}


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit_labels(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = docs.collect()
    want = [r for r, s in zip(rows, model.scores([r["text"] for r in rows])) if s < 0.5]
    kept = written(p.without_toxic(spark, docs, FOLDER), "t1")
    assert sorted(kept.collect()) == sorted(want) and kept.columns == docs.columns
    want = keep_one(want)
    kept = written(p.one_of_each_group(spark, kept, FOLDER), "t2")
    assert sorted(kept.collect()) == sorted(want) and kept.columns == docs.columns
    want = without_runs(want, [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    kept = written(p.without_benchmark(spark, kept, FOLDER), "t3")
    assert sorted(kept.collect()) == sorted(want) and kept.columns == docs.columns
    kept = written(p.mixed(spark, kept, FOLDER), "t4")
    assert Counter(r["doc_id"] for r in kept.collect()) == copies(want) and kept.columns == docs.columns
    final = p.sharded(spark, kept, FOLDER)
    table = filled(placement.SHARDS, placement.SLOTS)
    assert all(r["shard"] == placement.SHARDS[table[number(str(r["doc_id"])) % placement.SLOTS]] for r in final.collect())
    assert sorted(tuple(r) for r in p.run(spark, FOLDER).collect()) == sorted(tuple(r) for r in final.collect())


def test_stages_stand_awkward_rows(spark, documents, tmp_path):
    from conftest import AWKWARD

    texts = [*AWKWARD, *AWKWARD, "a b c d e f g", "a b c d e f g"]
    ids = [None if i % 5 == 0 else i // 2 for i in range(len(texts) - 2)] + [99, 99]
    docs = documents(texts, [None if i % 3 else "é" for i in range(len(texts))], ids)
    spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.filter("false")):
        for name, stage in p.STAGES:
            before, some = some, written(stage(spark, some, str(tmp_path)), name)
            assert name == "sharding" or some.columns == docs.columns
            if name == "ngram_jaccard":
                got = Counter((r["text"] or "").lower() for r in some.collect() if (r["text"] or "").split())
                assert all(n == 1 for n in got.values()) and set(got) == {(r["text"] or "").lower() for r in before.collect() if (r["text"] or "").split()}
        some.collect()


@pytest.mark.parametrize("name", [name for name, _ in p.STAGES])
def test_order_of_stages(name):
    assert [n for n, _ in p.STAGES].index(name) == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"].index(name)
