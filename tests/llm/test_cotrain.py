import numpy as np
from conftest import AWKWARD

import __spark_entry__ as entry_module
from emberline.llm import cotrain as c


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = entry_module.queries()["op5_cotraining"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(r["score"], r["content_score"], r["page_score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [h[0] for h in held if h[-1] == 1], [h[0] for h in held if h[-1] == 0]
    area = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    print(area, np.mean([(h[0] >= 0.5) == h[-1] for h in held]), np.mean(np.array(good) >= 0.5), np.mean(np.array(bad) < 0.5))
    assert area > 0.9 and np.mean(np.array(good) >= 0.5) > 0.95


def test_awkward_rows(spark, documents):
    docs = documents([*AWKWARD, *[f"fine words {i}" for i in range(40)], *[f"$$$ ### {i} !!" for i in range(40)]])
    n = len(AWKWARD)
    labels = spark.createDataFrame([(n + i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in c.score(docs, labels, 1).collect()}
    assert len(got) == n + 80 and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[n + i]["predicted"] == (i < 40) for i in range(80)]) > 0.9
    assert {r["score"] for r in c.score(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in c.score(docs, labels.filter("false")).collect()} == {0.5}
    assert c.score(docs.filter("false"), labels).count() == 0
