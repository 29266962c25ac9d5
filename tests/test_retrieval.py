"""Exact top-k by three layouts, and evidence numbering."""

import numpy as np
from pyspark.sql import functions as F

from emberline.operators import evidence as ev
from emberline.operators import nearest as nn
from emberline.operators import textvectors as tv
from emberline.sources.tables import table


def vectors(spark, rows, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{key} long, vec array<double>")


def test_block_grid_and_brute_force_agree(spark):
    rng = np.random.default_rng(1)
    queries, items = rng.normal(size=(17, 8)), rng.normal(size=(230, 8))
    items[50:120] = items[50]  # a third of the items are copies of one
    items[3] = 0  # no direction, never found
    q, c = vectors(spark, queries, "q"), vectors(spark, items, "i").repartition(5)
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, np.nan)
    scores = np.round(unit(queries) @ unit(items).T, 9)
    want = {
        (a, b) for a in range(17)
        for b in sorted((b for b in range(230) if not np.isnan(scores[a, b])), key=lambda b: (-scores[a, b], b))[:6]
    }
    block = nn.cosine_topk(q, c, ["q"], ["i"], 6)
    grid = nn.cosine_topk(q, c, ["q"], ["i"], 6, block_limit=7)
    assert {(r["q"], r["i"]) for r in block.collect()} == want
    assert {(r["q"], r["i"]) for r in grid.collect()} == want


def test_nearest_reference(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "id long, a double, b double")
    known = spark.createDataFrame([("x", 0.0, 1.0, 10.0), ("y", 1.0, 0.0, 20.0), ("z", 9.0, 8.0, 90.0)], "k string, a double, b double, t double")
    got = nn.nearest_reference(rows, ["a", "b"], known, "k", ["t"], 1).orderBy("id").collect()
    assert [r["t_knn"] for r in got] == [10.0, 90.0]


def hits(spark, rows):
    return spark.createDataFrame(
        [(1, n, paper, section, f"text{n}", f"title{paper}", 2000, "A", "c") for n, (paper, section) in enumerate(rows, 1)],
        "question_id long, rank int, paper_id long, section string, text string, title string, year int, authors string, category string",
    )


def test_two_sections_of_one_paper_share_a_number(spark):
    rows = hits(spark, [(7, "a"), (8, "a"), (7, "b"), (7, "a"), (9, "z")])
    numbered = ev.number_references(ev.first_per_section(rows))
    got = [(r["evidence_pos"], r["ref_num"], r["paper_id"], r["section"]) for r in numbered.orderBy("evidence_pos").collect()]
    assert got == [(1, 1, 7, "a"), (2, 2, 8, "a"), (3, 1, 7, "b"), (4, 3, 9, "z")]
    text = ev.evidence_text(numbered).first()["evidence_text"]
    assert text == "[1] (a) text1\n\n[2] (a) text2\n\n[1] (b) text3\n\n[3] (z) text5"
    assert [r["ref_num"] for r in ev.reference_list(numbered).orderBy("ref_num").collect()] == [1, 2, 3]


def test_at_most_ten_evidence_rows(spark):
    numbered = ev.number_references(ev.first_per_section(hits(spark, [(n, "s") for n in range(14)])))
    assert sorted(r["ref_num"] for r in numbered.collect()) == list(range(1, 11))


def test_prompt_blocks(spark):
    row = spark.range(1).select(
        ev.answer_prompt(F.lit("Q"), F.lit("E"), F.lit(""), F.lit("R")).alias("a"),
        ev.answer_prompt(F.lit("Q"), F.lit(""), F.lit(None).cast("string"), F.lit("")).alias("b"),
        ev.score_display(F.lit(0.876)).alias("c"), ev.score_display(F.lit(1.5)).alias("d"),
        ev.shorten(F.lit("x" * 51), 50).alias("e"),
    ).first()
    assert row["a"] == "**用户问题：** Q\n\n**相关文献证据：**\nE\n\n**推理分析：**\nR\n"
    assert row["b"].endswith(ev.NO_EVIDENCE_LINE)
    assert (row["c"], row["d"]) == ("88%", "1.50")
    assert row["e"] == "x" * 50 + " et al."


def recall_and_pairs(queries, items, keys):
    near = tv.approximate_topk(queries, items, keys, ["vec_id"], 5, cell_rows=50)
    exact = nn.cosine_topk(queries, items, keys, ["vec_id"], 5)
    found = near.join(exact.drop("score"), [*keys, "vec_id"], "left_semi").count() / exact.count()
    centres = tv.fit_centroids(items, round(4 * items.count() ** 0.5))
    filed = tv.file_items(items, centres).cache()
    asked = tv.probing(queries, centres, tv.probes_needed(queries, items, filed, keys, ["vec_id"], 5, centres, tv.RECALL))
    pairs = asked.groupBy("list").agg(F.count("*").alias("a")).join(filed.groupBy("list").agg(F.count("*").alias("b")), "list").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    return found, pairs / (queries.count() * items.count())


def test_inverted_file_of_clusters(spark):
    """At least nine in ten of the exact neighbours, from less than a tenth of the pairs."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 24))
    rows = centre[rng.integers(60, size=3000)] + 0.35 * rng.normal(size=(3000, 24))
    items = vectors(spark, rows, "vec_id").repartition(4)
    queries = items.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q")
    found, pairs = recall_and_pairs(queries, items, ["q"])
    assert found >= 0.9 and pairs < 0.1, (found, pairs)


def test_inverted_file_of_the_tables(spark):
    """Vectors of the tables point anywhere; recall is kept all the same."""
    items = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    queries = items.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q")
    found, pairs = recall_and_pairs(queries, items, ["q"])
    print("recall", found, "pairs", pairs)
    assert found >= 0.9 and pairs < 0.6, (found, pairs)


def test_inverted_file_of_copies_and_vectors_without_direction(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 1.0]), (101, [0.0, 0.0]), (102, [0.6, 0.8])]
    items = spark.createDataFrame(rows, "id long, vec array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 5.0])], "q long, vec array<double>")
    got = tv.approximate_topk(queries, items, ["q"], ["id"], 3, lists=3, probes=3, cell_rows=4).collect()
    assert sorted((r["q"], r["id"], r["score"]) for r in got) == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (3, 0, 0.0), (3, 100, 1.0), (3, 102, 0.8)]
    assert tv.approximate_topk(queries, items.limit(0), ["q"], ["id"], 3).count() == 0
