"""Named graph queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.operators import graph as gr
from emberline.operators import retrieval as rt
from emberline.plans.catalogue_retrieval import SQL_SCORED
from emberline.plans.graph_build import build_graph, read_graph, stored_graph, write_graph
from emberline.session import fresh_path, written
from emberline.sources.entities import append_entities, order_entities, pending, read_entities
from emberline.sources.tables import chunks, question_vectors, table


def _graph(spark, d):
    """The entity rows are read more than once; they are computed once and written."""
    return build_graph(written(order_entities(spark, d), "entities"))


def entity_hygiene(spark, d):
    rows = gr.clean_entities(order_entities(spark, d))
    return rows.select(
        F.col("paper").cast("long").alias("paper_id"), "title", F.col("year").cast("long").alias("year"),
        F.array_join("authors", ",").alias("authors"), F.array_join("concepts", ",").alias("concepts"),
        F.array_join("methods", ",").alias("methods"), F.array_join("materials", ",").alias("materials"),
        F.array_join(F.transform("properties", lambda p: F.concat(p["name"], F.lit("="), p["unit"])), ",").alias("properties"),
        F.array_join(F.transform("relations", lambda p: F.concat(p["a"], F.lit("-"), p["b"])), ",").alias("relations"),
    )


def entity_resume(spark, d):
    """Entities written in one increment; what is still to do after it."""
    rows = order_entities(spark, d)
    path = fresh_path(spark, "entities")
    append_entities(rows.where("year < 1998"), path)
    left = pending(rows.select("paper_id", "title"), read_entities(spark, path))
    return left.select("paper_id", "title")


def graph_nodes(spark, d):
    nodes = gr.build_nodes(gr.clean_entities(order_entities(spark, d)))
    return nodes.select("label", "key", "name", "title", F.col("year").cast("long").alias("year"), "unit")


def graph_edges(spark, d):
    return _graph(spark, d).edges.select("src_label", "src", "rel", "dst_label", "dst")


def graph_counts(spark, d):
    return gr.graph_counts(*_graph(spark, d))


def graph_written_counts(spark, d):
    """The graph sink: written partitioned, read back, counted."""
    path = fresh_path(spark, "graph")
    write_graph(_graph(spark, d), path)
    return gr.graph_counts(*read_graph(spark, path))


def graph_key_check(spark, d):
    """Violations of node keys, before the merge: names seen with more than one unit."""
    rows = gr.clean_entities(order_entities(spark, d)).select(F.explode("properties").alias("p")).select(
        F.lit("Property").alias("label"), F.col("p.name").alias("key"), F.col("p.unit").alias("unit")
    )
    return gr.key_violations(rows.distinct())


def related_papers(spark, d):
    return gr.related_papers(*_graph(spark, d), "promo", 10).withColumn("year", F.col("year").cast("long"))


def paper_methods(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("paper_id"))
    return gr.paper_methods(_graph(spark, d).edges, urgent)


def materials_with_property(spark, d):
    graph = _graph(spark, d)
    return gr.materials_with_property(graph.nodes, gr.material_properties(graph.edges), "Flag r")


def concept_connections(spark, d):
    graph = stored_graph(order_entities(spark, d))
    rows = gr.concept_connections(graph.nodes, graph.edges, "promo", "small")
    return rows.select(
        F.col("length").cast("long").alias("length"), F.array_join("ids", " / ").alias("ids"),
        F.array_join("path_nodes", " > ").alias("path_nodes"), F.array_join("path_rels", " > ").alias("path_rels"),
    )


def concept_connections_far(spark, d):
    """Without RELATED_TO there is no direct path, so two- and three-step paths must be found.

    Leaving RELATED_TO out is what is asked; all other relationships of all papers may be walked.
    """
    graph = stored_graph(order_entities(spark, d))
    rows = gr.concept_connections(graph.nodes, graph.edges.where("rel <> 'RELATED_TO'"), "economy", "medium", 12)
    return rows.select(
        F.col("length").cast("long").alias("length"), F.array_join("ids", " / ").alias("ids"),
        F.array_join("path_nodes", " > ").alias("path_nodes"), F.array_join("path_rels", " > ").alias("path_rels"),
    )


def _key_concepts(spark, d):
    """Four key concepts per label, of which three count."""
    words = F.array(F.lit("promo"), F.lit("A"), F.lit("zzz"), F.lit("small"))
    turned = F.concat(F.slice(words, (F.col("question_id") % 4 + 1).cast("int"), 4), words)
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("question_id")).distinct().select(
        "question_id", F.slice(turned, 1, 4).alias("key_concepts")
    )


def concept_fan_in(spark, d):
    rows = gr.concept_fan_in(_key_concepts(spark, d), *_graph(spark, d))
    return rows.withColumn("year", F.col("year").cast("long"))


def graph_context(spark, d):
    return gr.graph_context(gr.concept_fan_in(_key_concepts(spark, d), *_graph(spark, d)))


def knowledge_requests(spark, d):
    """Requests per label: graph hits first, then retrieved chunks."""
    asked = F.element_at(
        F.array(F.lit("Paper-STUDIES_CONCEPT-!promo!"), F.lit("Paper-USES_METHOD-!brand#25!"), F.lit("Author-WROTE-!77!"), F.lit("unclear")),
        (F.col("question_id") % 4 + 1).cast("int"),
    )
    found = rt.ranked_hits(question_vectors(spark, d), chunks(spark, d)).withColumn("request", asked)
    # questions that make the same request share its ranks
    shared = F.row_number().over(Window.partitionBy("request").orderBy("rank", "question_id"))
    hits = found.select(
        "request", shared.alias("rank"),
        F.concat(F.lit("chunk "), F.col("paper_id").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")).alias("text"),
    )
    requests = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("question_id")).distinct().select(asked.alias("request"))
    return gr.knowledge_extract(requests, *_graph(spark, d), hits)


QUERIES = {
    f.__name__: f
    for f in (
        entity_hygiene, entity_resume, graph_nodes, graph_edges, graph_counts, graph_written_counts, graph_key_check,
        related_papers, paper_methods, materials_with_property, concept_connections, concept_connections_far,
        concept_fan_in, graph_context, knowledge_requests,
    )
}

SQL_GRAPH = """
li AS (SELECT l_orderkey, p_type, p_brand, p_name, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey),
paper AS (SELECT o_orderkey::VARCHAR AS key, 'Order ' || o_orderkey AS title, year(o_orderdate) AS year, o_orderpriority FROM orders),
types AS (SELECT DISTINCT l_orderkey::VARCHAR AS src, p_type AS dst FROM li SEMI JOIN orders ON o_orderkey = l_orderkey),
pairs AS (SELECT src, dst AS a, lead(dst) OVER (PARTITION BY src ORDER BY dst) AS b FROM types),
e AS (
  SELECT 'Author' AS src_label, c_name AS src, 'WROTE' AS rel, 'Paper' AS dst_label, o_orderkey::VARCHAR AS dst FROM orders JOIN customer ON c_custkey = o_custkey
  UNION SELECT 'Paper', src, 'STUDIES_CONCEPT', 'Concept', dst FROM types
  UNION SELECT 'Paper', l_orderkey::VARCHAR, 'USES_METHOD', 'Method', p_brand FROM li SEMI JOIN orders ON o_orderkey = l_orderkey
  UNION SELECT 'Paper', l_orderkey::VARCHAR, 'ANALYZES_MATERIAL', 'Material', p_name FROM li SEMI JOIN orders ON o_orderkey = l_orderkey
  UNION SELECT 'Paper', l_orderkey::VARCHAR, 'MEASURES_PROPERTY', 'Property', 'flag ' || l_returnflag FROM li SEMI JOIN orders ON o_orderkey = l_orderkey
  UNION SELECT 'Concept', a, 'RELATED_TO', 'Concept', b FROM pairs WHERE b IS NOT NULL
),
unit AS (SELECT dst AS key, arg_max(o_orderpriority, src::BIGINT) AS unit FROM e JOIN paper ON paper.key = src WHERE rel = 'MEASURES_PROPERTY' GROUP BY dst),
n AS (
  SELECT 'Paper' AS label, key, NULL::VARCHAR AS name, title, year, NULL::VARCHAR AS unit FROM paper
  UNION ALL SELECT DISTINCT src_label, src, src, NULL, NULL, NULL FROM e WHERE src_label = 'Author'
  UNION ALL SELECT DISTINCT dst_label, dst, dst, NULL, NULL, NULL FROM e WHERE dst_label IN ('Concept', 'Method', 'Material')
  UNION ALL SELECT 'Property', key, key, NULL, NULL, unit FROM unit
)"""
_COUNTS = f"""WITH {SQL_GRAPH}
SELECT 'node' AS kind, label AS name, count(*) AS cnt FROM n GROUP BY label
UNION ALL SELECT 'relationship', rel, count(*) FROM e GROUP BY rel"""


def _paths(edges: str, first: str, second: str, limit: int) -> str:
    return f"""WITH {SQL_GRAPH},
ed AS (SELECT concat_ws('|', src_label, src, rel, dst_label, dst) AS id, rel, src_label || '|' || src AS a, dst_label || '|' || dst AS b FROM e WHERE {edges}),
ways AS (SELECT * FROM ed UNION ALL SELECT id, rel, b, a FROM ed WHERE a <> b),
s AS (SELECT 'Concept|' || key AS node FROM n WHERE label = 'Concept' AND contains(lower(key), '{first}')),
z AS (SELECT 'Concept|' || key AS node FROM n WHERE label = 'Concept' AND contains(lower(key), '{second}')),
p1 AS (SELECT [id] AS ids, [a, b] AS path, [rel] AS rels FROM ways WHERE a IN (FROM s)),
p2 AS (SELECT ids || [id] AS ids, path || [b] AS path, rels || [rel] AS rels FROM p1 JOIN ways ON ways.a = path[-1] WHERE NOT list_contains(ids, id)),
fin AS (SELECT * FROM ways WHERE b IN (FROM z)),
p3 AS (SELECT ids || [id] AS ids, path || [b] AS path, rels || [rel] AS rels FROM p2 JOIN fin ON fin.a = path[-1] WHERE NOT list_contains(ids, id)),
allp AS (
  SELECT 1 AS length, * FROM p1 WHERE path[-1] IN (FROM z)
  UNION ALL SELECT 2, * FROM p2 WHERE path[-1] IN (FROM z)
  UNION ALL SELECT 3, * FROM p3
),
top AS (SELECT * FROM allp ORDER BY length, ids, path LIMIT {limit})
SELECT length, array_to_string(ids, ' / ') AS ids,
  array_to_string(list_transform(path, lambda x: CASE WHEN starts_with(x, 'Paper|') THEN 'Paper: Order ' || x[7:] ELSE replace(x, '|', ': ') END), ' > ') AS path_nodes,
  array_to_string(rels, ' > ') AS path_rels
FROM top"""


_FAN = SQL_GRAPH + """,
q AS (
  SELECT question_id, (words[question_id % 4 + 1:] || words)[1:3] AS kc
  FROM (SELECT DISTINCT label::BIGINT AS question_id, ['promo', 'A', 'zzz', 'small'] AS words FROM embeddings)
),
asked AS (SELECT question_id, unnest(kc) AS asked, generate_subscripts(kc, 1) AS pos FROM q),
hit AS (
  SELECT asked, src::BIGINT AS paper_id, title, year, dst AS concept, row_number() OVER (PARTITION BY asked ORDER BY year DESC, src::BIGINT, dst) AS hit
  FROM e JOIN paper ON paper.key = src JOIN (SELECT DISTINCT asked FROM asked) w ON contains(lower(dst), lower(asked))
  WHERE rel = 'STUDIES_CONCEPT' QUALIFY hit <= 3
),
fan AS (
  SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY pos, hit) AS place, count(*) OVER (PARTITION BY question_id) AS total,
    paper_id, title, year, concept
  FROM asked JOIN hit USING (asked)
)"""
ORACLES = {
    "entity_hygiene": """
WITH li AS (SELECT l_orderkey, p_type, p_brand, p_name, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (
  SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS c, list_sort(list(DISTINCT p_brand)) AS b, list_sort(list(DISTINCT p_name)) AS n,
    list_sort(list(DISTINCT l_returnflag)) AS f FROM li GROUP BY 1
)
SELECT o_orderkey AS paper_id, 'Order ' || o_orderkey AS title, year(o_orderdate) AS year, coalesce(c_name, '') AS authors,
  coalesce(array_to_string(c, ','), '') AS concepts, coalesce(array_to_string(b, ','), '') AS methods, coalesce(array_to_string(n, ','), '') AS materials,
  coalesce(array_to_string(list_transform(f, lambda x: 'flag ' || x || '=' || o_orderpriority), ','), '') AS properties,
  coalesce(array_to_string(list_transform(range(1, len(c)), lambda i: c[i] || '-' || c[i + 1]), ','), '') AS relations
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN s ON l_orderkey = o_orderkey""",
    "entity_resume": "SELECT o_orderkey AS paper_id, 'Order ' || o_orderkey AS title FROM orders WHERE year(o_orderdate) >= 1998",
    "graph_nodes": f"WITH {SQL_GRAPH} SELECT label, key, name, title, year, unit FROM n",
    "graph_edges": f"WITH {SQL_GRAPH} SELECT src_label, src, rel, dst_label, dst FROM e",
    "graph_counts": _COUNTS,
    "graph_written_counts": _COUNTS,
    "graph_key_check": f"""WITH {SQL_GRAPH}
SELECT 'Property' AS label, dst AS key, count(DISTINCT o_orderpriority) AS n FROM e JOIN paper ON paper.key = src
WHERE rel = 'MEASURES_PROPERTY' GROUP BY dst HAVING count(DISTINCT o_orderpriority) > 1""",
    "related_papers": f"""WITH {SQL_GRAPH}
SELECT src::BIGINT AS paper_id, title, year, dst AS concept FROM e JOIN paper ON paper.key = src
WHERE rel = 'STUDIES_CONCEPT' AND contains(lower(dst), 'promo') ORDER BY year DESC, paper_id, concept LIMIT 10""",
    "paper_methods": f"""WITH {SQL_GRAPH}
SELECT src::BIGINT AS paper_id, dst AS method FROM e JOIN paper ON paper.key = src WHERE rel = 'USES_METHOD' AND o_orderpriority = '1-URGENT'""",
    "materials_with_property": f"""WITH {SQL_GRAPH}
SELECT DISTINCT m.dst AS material, p.dst AS property, unit FROM e m JOIN e p ON p.src = m.src AND p.rel = 'MEASURES_PROPERTY' JOIN unit ON unit.key = p.dst
WHERE m.rel = 'ANALYZES_MATERIAL' AND contains(lower(p.dst), 'flag r') ORDER BY material, property LIMIT 20""",
    "concept_connections": _paths("true", "promo", "small", 5),
    "concept_connections_far": _paths("rel <> 'RELATED_TO'", "economy", "medium", 12),
    "concept_fan_in": f"WITH {_FAN} SELECT question_id, place, total, paper_id, title, year, concept FROM fan",
    "graph_context": f"""WITH {_FAN}
SELECT question_id, max(total) AS total, string_agg('- ' || title || ' (' || year || '): studies ' || concept, chr(10) ORDER BY place) AS kg_context
FROM fan WHERE place <= 5 GROUP BY question_id""",
    "knowledge_requests": f"""WITH {SQL_SCORED}, {SQL_GRAPH},
req AS (SELECT * FROM (VALUES (0, 'Paper-STUDIES_CONCEPT-!promo!', 'Paper', 'STUDIES_CONCEPT', 'promo'), (1, 'Paper-USES_METHOD-!brand#25!', 'Paper', 'USES_METHOD', 'brand#25'),
  (2, 'Author-WROTE-!77!', 'Author', 'WROTE', '77'), (3, 'unclear', '', '', '')) v(question_id, request, label, rel, value)),
g AS (
  SELECT request, 0 AS source, src AS at1, dst AS at2, coalesce(name, title) || ' ' || e.rel || ' ' || dst AS text
  FROM req JOIN e ON e.rel = req.rel AND src_label = label AND contains(lower(dst), lower(value)) JOIN n ON n.label = src_label AND n.key = src
),
v AS (
  SELECT request, 1 AS source, lpad((row_number() OVER (PARTITION BY request ORDER BY rank, top10.question_id))::VARCHAR, 12, '0') AS at1, '' AS at2, 'chunk ' || paper_id || '_' || chunk_index AS text
  FROM top10 JOIN req ON req.question_id = top10.question_id % 4
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY request ORDER BY source, at1, at2) AS place FROM (SELECT * FROM g UNION ALL SELECT * FROM v) QUALIFY place <= 10
)
SELECT request, string_agg(text, chr(10) ORDER BY place) AS knowledge FROM r GROUP BY request""",
}
