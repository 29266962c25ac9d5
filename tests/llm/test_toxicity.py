import os

import numpy as np
from conftest import AWKWARD

import __spark_entry__ as entry_module
from emberline.llm import toxicity as t


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = entry_module.queries()["op4_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = np.mean([(s >= 0.5) == y for s, y in held])
    caught = np.mean([s >= 0.5 for s, y in held if y == 1])
    alone = np.mean([s < 0.5 for s, y in held if y == 0])
    print(right, caught, alone)
    assert right > 0.95 and caught > 0.75 and alone > 0.97


def test_awkward_rows(spark, documents):
    docs = documents([*AWKWARD, *[f"word{i} other{i % 7} nasty awful" for i in range(40)], *[f"kind words{i} here" for i in range(60)]])
    n = len(AWKWARD)
    labels = spark.createDataFrame([(n + i, 1) for i in range(40)] + [(n + 40 + i, 0) for i in range(60)], "doc_id long, toxic int")
    model = t.fit_labels(docs, labels)
    got = {r["doc_id"]: r for r in t.score(docs, model).collect()}
    assert len(got) == n + 100 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(got[i]["predicted"] == (n <= i < n + 40) for i in got)
    kept = t.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == n + 60
    for some in (labels.filter("false"), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert t.score(docs, t.fit_labels(docs, some)).count() == n + 100
    assert t.score(docs.filter("false"), model).count() == 0


def test_decisions_do_not_move_with_the_sample(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    texts = [r["text"] for r in docs.collect()]
    whole, *parts = (int((t.fit_labels(docs, labels, sample).scores(texts) >= 0.5).sum()) for sample in (t.SAMPLE, 1000, 600))
    print(whole, parts)
    assert all(abs(part - whole) <= 0.05 * whole for part in parts)


def test_weights_of_rows_are_repetitions():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(90, 2)), rng.integers(0, 2, 90)
    n = np.where(y == 0, 7, 1)
    assert np.allclose(t.logistic(x, y, weigh=n.astype(float)), t.logistic(np.repeat(x, n, 0), np.repeat(y, n)))


def test_the_driver_does_not_fit(spark, documents, monkeypatch):
    def where(sample, stands_for=None):
        return t.Model(str(os.getpid()).encode(), str(len(sample)).encode(), np.zeros(5))

    monkeypatch.setattr(t, "fit", where)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    model = t.fit_labels(documents([f"word{i}" for i in range(30)]), labels)
    assert int(model.toxic) != os.getpid() and 0 < int(model.ordinary) < 30
