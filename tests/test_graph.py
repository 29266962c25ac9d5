"""Graph building and path search against brute force."""

import random
from datetime import date

import duckdb

from emberline.operators import graph as gr
from emberline.plans import catalogue_graph
from emberline.plans.graph_build import build_graph, stored_graph
from emberline.sources.entities import ENTITY_SCHEMA, append_entities, order_entities, read_entities

ROWS = [
    (1, "T1", 2001, [" A ", "", "B"], ["CSR", " "], ["FTIR"], ["coal"], [("CSR", "%"), (" ", "x")], [["CSR", "ash"], ["x"], ["", "y"]]),
    (2, "T2", None, [str(i) for i in range(12)], ["CSR"], [], [], [("CSR", "pct")], []),
]


def test_build_is_idempotent_and_clean(spark):
    rows = spark.createDataFrame(ROWS, ENTITY_SCHEMA)
    once, twice = build_graph(rows), build_graph(rows.union(rows))
    assert sorted(once.edges.collect()) == sorted(twice.edges.collect())
    assert once.nodes.count() == twice.nodes.count()
    names = {(r["label"], r["key"]) for r in once.nodes.collect()}
    assert {("Author", "A"), ("Concept", "ash"), ("Concept", "CSR"), ("Method", "FTIR")} <= names
    assert ("Author", "9") in names and ("Author", "10") not in names
    unit = [r["unit"] for r in once.nodes.where("label = 'Property'").collect()]
    assert unit == ["pct"]
    assert [r["year"] for r in once.nodes.where("label = 'Paper' AND key = '2'").collect()] == [0]
    assert gr.key_violations(once.nodes).count() == 0


def trails(edges, first, second, limit):
    ways = [(e["edge_id"], f"{e['src_label']}|{e['src']}", f"{e['dst_label']}|{e['dst']}") for e in edges]
    ways += [(i, b, a) for i, a, b in ways if a != b]
    starts = {n for _, a, b in ways for n in (a, b) if n.startswith("Concept|") and first in n[8:].lower()}
    ends = {n for _, a, b in ways for n in (a, b) if n.startswith("Concept|") and second in n[8:].lower()}
    out, level = [], [((), (n,)) for n in starts]
    for length in (1, 2, 3):
        level = [((*ids, i), (*path, b)) for ids, path in level for i, a, b in ways if a == path[-1] and i not in ids]
        out += [(length, ids, path) for ids, path in level if path[-1] in ends]
    return [(n, list(ids)) for n, ids, _ in sorted(out)[:limit]]


def test_paths_equal_brute_force_with_hubs(spark):
    rng = random.Random(11)
    rows = []
    for paper in range(14):
        concepts = sorted({rng.choice(["c one", "c two", "d one", "e"]) for _ in range(3)})
        rows.append((paper, f"T{paper}", 2000, ["hub author"], concepts, [rng.choice(["m1", "m2"])], [], [], [rng.sample(["c one", "c two", "d one"], 2)] if paper % 4 == 0 else []))
    graph = build_graph(spark.createDataFrame(rows, ENTITY_SCHEMA))
    edges = graph.edges.collect()
    for first, second, limit in (("one", "two", 5), ("c", "e", 7), ("d", "d", 4), ("e", "c one", 40)):
        got = [(r["length"], r["ids"]) for r in gr.concept_connections(graph.nodes, graph.edges, first, second, limit).collect()]
        assert sorted(got) == sorted(trails(edges, first, second, limit))


def test_contained_words_both_ways(spark):
    names = spark.createDataFrame([("Coal Rank",), ("rank",), ("x",)], "name string")
    words = spark.createDataFrame([("RANK",), ("al r",), ("zz",)], "word string")
    want = {("Coal Rank", "RANK"), ("rank", "RANK"), ("Coal Rank", "al r")}
    assert {tuple(r) for r in gr.contained_words(names, words).collect()} == want
    assert {tuple(r) for r in gr.contained_words(names, words, limit=1).collect()} == want


def test_entity_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, ENTITY_SCHEMA)
    path = str(tmp_path / "entities")
    append_entities(rows.where("paper_id = 1"), path)
    append_entities(rows.where("paper_id = 2"), path)
    assert sorted(r["paper_id"] for r in read_entities(spark, path).collect()) == [1, 2]
    (tmp_path / "array.json").write_text('[{"paper_id": 5,\n "title": "x"},\n {"paper_id": 6}]')
    assert sorted(r["paper_id"] for r in read_entities(spark, str(tmp_path / "array.json"), multi_line=True).collect()) == [5, 6]


def test_knowledge_default_text(spark):
    graph = build_graph(spark.createDataFrame(ROWS, ENTITY_SCHEMA))
    asked = spark.createDataFrame([("Paper-STUDIES_CONCEPT-!csr!",), ("Paper-CITES-!csr!",), ("?",)], "request string")
    none = spark.createDataFrame([], "request string, rank int, text string")
    got = {r["request"]: r["knowledge"] for r in gr.knowledge_extract(asked, graph.nodes, graph.edges, none).collect()}
    assert got["Paper-STUDIES_CONCEPT-!csr!"] == "T1 STUDIES_CONCEPT CSR\nT2 STUDIES_CONCEPT CSR"
    assert got["?"] == got["Paper-CITES-!csr!"] == gr.NOTHING_FOUND


def test_a_blank_word_is_in_every_name(spark):
    names = spark.createDataFrame([("Coal",), ("",), ("a b",), (None,)], "name string")
    words = spark.createDataFrame([("",), (" ",), ("O",), ("zz",)], "word string")
    want = {("Coal", ""), ("", ""), ("a b", ""), ("a b", " "), ("Coal", "O")}
    for limit in (2000, 1):
        assert {tuple(r) for r in gr.contained_words(names, words, limit=limit).collect()} == want


def test_papers_of_one_row_are_not_shuffled_for_their_edges(spark):
    many = [(i, f"T{i}", 2000, ["A"], ["c", "c", "d"], [], [], [("p", "u"), ("p", "v")], [["c", "d"]]) for i in range(3, 40)]
    rows = spark.createDataFrame(ROWS + many + many[:5], ENTITY_SCHEMA)
    edges = build_graph(rows).edges
    found = [tuple(r) for r in edges.collect()]
    assert len(found) == len(set(found)) and sum(e[2] == "RELATED_TO" for e in found) == 2
    assert sum(e[2] == "STUDIES_CONCEPT" for e in found) == 2 * len(many) + 2
    alone = build_graph(spark.createDataFrame(ROWS + many, ENTITY_SCHEMA)).edges
    assert sorted(map(tuple, alone.collect())) == sorted(found)
    # only relationships between concepts go through a shuffle
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    lost = spark.createDataFrame([(9, "T", 2000, None, ["c"], [], [], [], [["c", "d"]]), (8, "T", 2000, [], ["c"], [], [], [], None)], ENTITY_SCHEMA)
    assert build_graph(lost).edges.count() == 0


def test_longer_paths_are_not_built_once_the_limit_is_reached(spark, monkeypatch):
    rows = [(i, f"T{i}", 2000, [], ["c one", f"d {i}"], [], [], [], [["c one", f"d {i}"]]) for i in range(8)]
    graph, kept = build_graph(spark.createDataFrame(rows, ENTITY_SCHEMA)), []
    write = gr.written
    monkeypatch.setattr(gr, "written", lambda df, label, *by: kept.append(label) or write(df, label, *by))
    edges = graph.edges.collect()
    for limit, lengths in ((8, 1), (5, 1), (12, 2), (30, 3)):
        kept.clear()
        got = [(r["length"], r["ids"]) for r in gr.concept_connections(graph.nodes, graph.edges, "one", "d", limit).collect()]
        assert sorted(got) == sorted(trails(edges, "one", "d", limit)) and len(kept) == lengths, limit


def test_a_stored_graph_is_the_built_one_without_ids_on_disk(spark):
    many = [(i, f"T{i}", 2000, ["A", "A"], ["c", "c", "d"], ["m", "m"], [], [("p", "u"), ("p", "v")], [["c", "d"]]) for i in range(3, 9)]
    rows = spark.createDataFrame(ROWS + many + many[:2] + [(None, "T", 2001, [], ["c"], [], [], [], [])], ENTITY_SCHEMA)
    built, stored = build_graph(rows), stored_graph(rows)
    for a, b in zip(built, stored):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    files = stored.edges.inputFiles()
    assert files and "edge_id" not in spark.read.parquet(*files).columns
    # papers in one row are nodes without a shuffle: only other nodes and properties are grouped
    alone = build_graph(spark.createDataFrame(ROWS + many, ENTITY_SCHEMA)).nodes
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    assert alone.where("label = 'Paper'").count() == len(ROWS + many)


def test_lines_are_moved_to_their_order_one_by_one(spark, tmp_path):
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_returnflag string", [(1, 1, "A"), (1, 1, "A"), (1, 2, None), (None, 1, "N"), (2, None, "R"), (3, 9, "R")]),
        "part": ("p_partkey long, p_type string, p_brand string, p_name string", [(1, "T2", "B", "n"), (2, "T1", None, "n"), (None, "T3", "B", "n")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string", [(1, 1, date(2001, 1, 1), "5-LOW"), (2, 7, None, None), (None, 1, None, "x")]),
        "customer": ("c_custkey long, c_name string", [(1, "Ann"), (None, "Bob")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = order_entities(spark, str(tmp_path))
    got = {r["paper_id"]: r for r in found.collect()}
    assert set(got) == {1, 2, None} and got[2]["concepts"] == got[None]["concepts"] == []
    assert got[1]["concepts"] == ["T1", "T2"] and got[1]["methods"] == ["B"] and got[1]["materials"] == ["n"]
    assert got[1]["concept_relations"] == [["T1", "T2"]] and [p["name"] for p in got[1]["properties"]] == ["flag A"]
    # both halves of the sets are built after the shuffle
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    sets = [i for i, line in enumerate(plan) if "ObjectHashAggregate" in line]
    assert len(sets) == 2 and not any("Exchange" in line for line in plan[sets[0] : sets[1]])


def test_relationships_at_few_concepts_are_not_joined_with_them(spark, monkeypatch):
    rows = [(i, f"T{i}", 2000, ["one", "d 1"], ["c one", f"d {i}"], ["d 2"], [], [], [["c one", f"d {i}"]] if i % 2 else []) for i in range(8)]
    graph, plans = stored_graph(spark.createDataFrame(rows, ENTITY_SCHEMA).coalesce(1)), []
    write = gr.written
    monkeypatch.setattr(gr, "written", lambda df, *x: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *x))
    edges = graph.edges.collect()
    for most in (2000, 1):
        monkeypatch.setattr(gr, "NODE_LIMIT", most)
        plans.clear()
        got = [(r["length"], r["ids"]) for r in gr.concept_connections(graph.nodes, graph.edges, "one", "d", 8).collect()]
        assert sorted(got) == sorted(trails(edges, "one", "d", 8))
        assert [plan.count("LeftSemi") > 0 for plan in plans] == [most == 1] * 2
        assert most == 1 or [plan.count("Join") for plan in plans] == [0, 1]
        found = gr.concept_connections(graph.nodes, graph.edges, "one", "nothing", 3)
        assert found.count() == 0 and found.columns == ["length", "ids", "path_nodes", "path_rels"]


def test_three_steps_move_only_relationships_that_fit_between_the_ends(spark, monkeypatch):
    rows = [(i, f"T{i}", 2000, ["A"], ["c one", f"x {i}"], ["M"], ["S"], [("p", "u")], [[f"x {i}", f"y {i}"]]) for i in range(3)]
    rows += [(10 + i, f"T{i}", 2000, ["A"], ["d two", f"y {i}"], ["M"], ["S"], [("p", "u")], []) for i in range(3)]
    graph, plans = stored_graph(spark.createDataFrame(rows, ENTITY_SCHEMA).coalesce(1)), []
    write = gr.written
    monkeypatch.setattr(gr, "written", lambda df, *x: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *x))
    edges = graph.edges.collect()
    for most, first, second, left in ((2000, "x", "two", ""), (2, "x", "two", ""), (2, "c one", "x 2", "RELATED_TO")):
        monkeypatch.setattr(gr, "NODE_LIMIT", most)
        plans.clear()
        found = gr.concept_connections(graph.nodes, graph.edges.where(f"rel <> '{left}'"), first, second, 30)
        ways = [e for e in edges if e["rel"] != left]
        assert sorted((r["length"], r["ids"]) for r in found.collect()) == sorted(trails(ways, first, second, 30))
        assert len(plans) == 3 and (most == 2 or "LeftSemi" not in plans[2])


def test_far_connections_lead_over_papers_of_any_id(spark, tmp_path):
    lines = [(25, 1), (25, 2), (37, 1), (37, 2), (37, 3), (4, 1), (4, 3), (900, 2)]
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_returnflag string", [(o, p, "N") for o, p in lines]),
        "part": ("p_partkey long, p_type string, p_brand string, p_name string", [(1, "ECONOMY", "B1", "n1"), (2, "MEDIUM", "B2", "n2"), (3, "LARGE", "B1", "n3")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string", [(o, 1, date(2001, 1, 1), "5-LOW") for o in (4, 25, 37, 900)]),
        "customer": ("c_custkey long, c_name string", [(1, "Ann")]),
    }
    db = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        db.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue_graph.concept_connections_far(spark, str(tmp_path)).collect()]
    assert sorted(r[2] for r in got) == [f"Concept: ECONOMY > Paper: Order {o} > Concept: MEDIUM" for o in (25, 37)]
    assert sorted(got) == sorted(db.sql(catalogue_graph.ORACLES["concept_connections_far"]).fetchall())
