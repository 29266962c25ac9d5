"""Property graph as two tables, and the pattern queries on it.

``nodes`` is (label, key, name, title, year, unit); ``edges`` is (src_label, src, rel, dst_label, dst,
edge_id).  Building is a distinct union, so that running it twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.text import contains_ignoring_case, strip
from emberline.session import rows_within, written

# Node labels, relationships, and how many authors, results and hops are kept.
LABELS = ("Paper", "Author", "Concept", "Method", "Material", "Property")
RELATIONSHIPS = (
    "WROTE", "CITES", "STUDIES_CONCEPT", "USES_METHOD", "ANALYZES_MATERIAL",
    "MEASURES_PROPERTY", "RELATED_TO", "CHARACTERIZES", "HAS_PROPERTY",
)
MAX_AUTHORS = 10
RELATED_LIMIT, PATH_LIMIT, MATERIAL_LIMIT, KNOWLEDGE_LIMIT = 10, 5, 20, 10
CONCEPTS_USED, PAPERS_PER_CONCEPT, PAPERS_SHOWN = 3, 3, 5
REQUEST_PATTERN = r"^\s*([A-Za-z]+)-([A-Z_]+)-!(.*)!\s*$"
NOTHING_FOUND = "No relevant knowledge found for this request."


def clean_names(names: Column) -> Column:
    """Stripped names without blanks."""
    return F.filter(F.transform(names, strip), lambda x: x.isNotNull() & (x != ""))


def clean_properties(properties: Column) -> Column:
    named = F.transform(properties, lambda p: F.struct(strip(p["name"]).alias("name"), F.coalesce(p["unit"], F.lit("")).alias("unit")))
    return F.filter(named, lambda p: p["name"].isNotNull() & (p["name"] != ""))


def clean_pairs(pairs: Column) -> Column:
    """Pairs of at least two names, both not blank."""
    long_enough = F.filter(pairs, lambda p: F.size(p) >= 2)
    stripped = F.transform(long_enough, lambda p: F.struct(strip(F.get(p, F.lit(0))).alias("a"), strip(F.get(p, F.lit(1))).alias("b")))
    return F.filter(stripped, lambda p: (p["a"] != "") & (p["b"] != ""))


def clean_entities(papers: DataFrame) -> DataFrame:
    """Entity arrays after hygiene; only the first ten authors count."""
    return papers.select(
        F.col("paper_id").cast("string").alias("paper"),
        "title",
        F.coalesce("year", F.lit(0)).alias("year"),
        clean_names(F.slice("authors", 1, MAX_AUTHORS)).alias("authors"),
        clean_names(F.col("concepts")).alias("concepts"),
        clean_names(F.col("methods")).alias("methods"),
        clean_names(F.col("materials")).alias("materials"),
        clean_properties(F.col("properties")).alias("properties"),
        clean_pairs(F.col("concept_relations")).alias("relations"),
    )


def edge_id(src_label: Column, src: Column, rel: Column, dst_label: Column, dst: Column) -> Column:
    return F.concat_ws("|", src_label, src, rel, dst_label, dst)


def with_edge_id(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", edge_id(*[F.col(c) for c in ("src_label", "src", "rel", "dst_label", "dst")]))


def repeated_papers(entities: DataFrame) -> DataFrame:
    """Papers in several rows."""
    return written(entities.groupBy("paper").agg(F.count("*").alias("n")).where("n > 1").select("paper"), "repeated")


def _by_repeats(entities: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of papers in one row, and rows of papers in several, if there are any."""
    if repeated.isEmpty():
        return entities, None
    again = repeated.withColumnRenamed("paper", "_paper")
    same = F.col("paper").eqNullSafe(F.col("_paper"))
    return entities.join(again, same, "left_anti"), entities.join(again, same, "left_semi")


def build_edges(entities: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """All relationships of all papers, each once.

    All but those between concepts have their paper at one end, so that a paper in one row has no copies
    in others: its relationships are made distinct where it is.  Only those of papers in several rows, and
    those between concepts, which combine map-side, are shuffled.  ``entities`` are read twice.
    """

    def edge(sl: str, s: Column, rel: str, dl: str, t: Column) -> Column:
        return F.struct(
            F.lit(sl).alias("src_label"), s.alias("src"), F.lit(rel).alias("rel"), F.lit(dl).alias("dst_label"), t.alias("dst")
        )

    paper = F.col("paper")

    # names are made distinct before they are relationships: strings are hashed, structs would be compared in pairs
    def names(c: str) -> Column:
        return F.array_distinct(F.transform(c, lambda p: p["name"]) if c == "properties" else F.col(c))

    every = F.concat(
        F.transform(names("authors"), lambda x: edge("Author", x, "WROTE", "Paper", paper)),
        F.transform(names("concepts"), lambda x: edge("Paper", paper, "STUDIES_CONCEPT", "Concept", x)),
        F.transform(names("methods"), lambda x: edge("Paper", paper, "USES_METHOD", "Method", x)),
        F.transform(names("materials"), lambda x: edge("Paper", paper, "ANALYZES_MATERIAL", "Material", x)),
        F.transform(names("properties"), lambda x: edge("Paper", paper, "MEASURES_PROPERTY", "Property", x)),
    )
    related = F.transform("relations", lambda p: edge("Concept", p["a"], "RELATED_TO", "Concept", p["b"]))
    # a paper without one of its lists has no relationship at all
    whole = reduce(and_, [F.col(c).isNotNull() for c in ("authors", "concepts", "methods", "materials", "properties", "relations")])
    every, related = F.when(whole, every), F.when(whole, related)

    def listed(rows: DataFrame, edges: Column) -> DataFrame:
        return rows.select(F.explode_outer(edges).alias("e")).where("e IS NOT NULL").select("e.*")

    once, several = _by_repeats(entities, repeated_papers(entities) if repeated is None else repeated)
    rows = listed(once, every)
    if several is not None:
        rows = rows.unionByName(listed(several, every).distinct())
    rows = rows.unionByName(listed(entities, related).distinct())
    return with_edge_id(rows)


def build_nodes(entities: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """One node per (label, key); the last paper that set a property wins.

    Most nodes have no properties and are plain distinct pairs, which hash and combine map-side; only
    papers and measured properties need the ordered maximum.  Where ``repeated`` is given, papers in one row
    are nodes as they are and only the others are shuffled.
    """

    def named(label: str, names: Column) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(label).alias("label"), x.alias("key")))

    related = F.flatten(F.transform("relations", lambda p: F.array(p["a"], p["b"])))
    every = F.concat(
        named("Author", F.col("authors")), named("Concept", F.col("concepts")), named("Concept", related),
        named("Method", F.col("methods")), named("Material", F.col("materials")),
    )
    plain = entities.select(F.explode_outer(every).alias("n")).where("n IS NOT NULL").select("n.*").distinct()
    order = F.struct(F.length("paper"), F.col("paper"))
    once, several = (None, entities) if repeated is None else _by_repeats(entities, repeated)
    papers = None if once is None else once.select("paper", "title", "year")
    if several is not None:
        last = several.groupBy("paper").agg(F.max_by(F.struct("title", "year"), order).alias("p")).select("paper", "p.title", "p.year")
        papers = last if papers is None else papers.unionByName(last)
    papers = papers.select(F.lit("Paper").alias("label"), F.col("paper").alias("key"), "title", F.col("year").cast("int").alias("year"))
    measured = entities.select("paper", F.explode_outer("properties").alias("m")).where("m IS NOT NULL")
    properties = measured.groupBy(F.col("m.name").alias("key")).agg(F.max_by("m.unit", order).alias("unit")).select(
        F.lit("Property").alias("label"), "key", "unit"
    )
    rows = plain.unionByName(papers, allowMissingColumns=True).unionByName(properties, allowMissingColumns=True)
    return rows.select("label", "key", F.when(F.col("label") != "Paper", F.col("key")).alias("name"), "title", "year", "unit")


def key_violations(nodes: DataFrame) -> DataFrame:
    """Node keys that occur more than once."""
    return nodes.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by label and by relationship, largest first."""
    by_label = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("cnt"))
    by_rel = edges.groupBy(F.lit("relationship").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("cnt"))
    return by_label.unionByName(by_rel).orderBy("kind", F.desc("cnt"), "name")


def related_papers(nodes: DataFrame, edges: DataFrame, concept: str, limit: int = RELATED_LIMIT) -> DataFrame:
    """Papers that study a concept whose name holds ``concept``; newest first."""
    found = edges.where("rel = 'STUDIES_CONCEPT'").where(contains_ignoring_case(F.col("dst"), F.lit(concept)))
    papers = nodes.where("label = 'Paper'").select("key", "title", "year")
    return (
        found.join(papers, found.src == papers.key)
        .select(F.col("key").cast("long").alias("paper_id"), "title", "year", F.col("dst").alias("concept"))
        .orderBy(F.desc("year"), "paper_id", "concept")
        .limit(limit)
    )


def paper_methods(edges: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """Methods per paper; ``papers`` (paper_id) narrows it to some papers."""
    rows = edges.where("rel = 'USES_METHOD'").select(F.col("src").cast("long").alias("paper_id"), F.col("dst").alias("method"))
    return rows if papers is None else rows.join(papers, "paper_id", "left_semi")


def material_properties(edges: DataFrame) -> DataFrame:
    """HAS_PROPERTY edges derived from papers that analyse a material and measure a property.

    Both sides are sets per paper, bounded by the vocabulary; a paper's materials meet its properties
    in arrays, and duplicates vanish map-side.
    """
    per_paper = edges.where("rel IN ('ANALYZES_MATERIAL', 'MEASURES_PROPERTY')").groupBy("src").agg(
        F.collect_set(F.when(F.col("rel") == "ANALYZES_MATERIAL", F.col("dst"))).alias("ms"),
        F.collect_set(F.when(F.col("rel") == "MEASURES_PROPERTY", F.col("dst"))).alias("ps"),
    )
    rows = per_paper.select(F.explode("ms").alias("src"), "ps").select("src", F.explode("ps").alias("dst")).distinct()
    rows = rows.select(F.lit("Material").alias("src_label"), "src", F.lit("HAS_PROPERTY").alias("rel"), F.lit("Property").alias("dst_label"), "dst")
    return rows.withColumn("edge_id", edge_id(*[F.col(c) for c in ("src_label", "src", "rel", "dst_label", "dst")]))


def materials_with_property(nodes: DataFrame, edges: DataFrame, name: str, limit: int = MATERIAL_LIMIT) -> DataFrame:
    found = edges.where("rel = 'HAS_PROPERTY'").where(contains_ignoring_case(F.col("dst"), F.lit(name)))
    units = nodes.where("label = 'Property'").select("key", "unit")
    return (
        found.join(units, found.dst == units.key)
        .select(F.col("src").alias("material"), F.col("dst").alias("property"), "unit")
        .orderBy("material", "property")
        .limit(limit)
    )


#: Most nodes at an end of paths that are held as a list.
NODE_LIMIT = 2000


def _ending(side: DataFrame, at: str) -> Callable[[DataFrame], DataFrame]:
    """Keeps the steps that have one of the concepts of ``side`` at their end ``at`` (``a`` or ``b``).

    A checked number of concepts goes along as a list, so that no step is moved to meet them; the label is
    compared first, which skips files and leaves the other steps without names.  Only for more concepts than
    that are steps at a concept joined with them.
    """
    rows = rows_within(side, NODE_LIMIT)

    def kept(steps: DataFrame) -> DataFrame:
        steps = steps.where(F.col(f"{at}_label") == "Concept")
        if rows is None:
            return steps.join(side.withColumnRenamed("node", at), at, "left_semi")
        return steps.where(F.col(at).isin([r["node"] for r in rows]))

    return kept


def _between(middle: DataFrame, steps: DataFrame, near: str, at: str) -> DataFrame:
    """Keeps the ``middle`` steps whose end ``at`` is the end ``near`` of one of ``steps``.

    The labels of those ends, which are few kinds, leave most relationships where they are; a checked number of
    ends goes along as a list, and only for more are the steps that are left joined with them.
    """
    labels = [r[0] for r in steps.select(f"{near}_label").distinct().collect()]
    middle = middle.where(F.col(f"{at}_label").isin(labels))
    rows = rows_within(steps.select(near), NODE_LIMIT)
    if rows is None:
        return middle.join(steps.select(F.col(near).alias(at)).distinct(), at, "left_semi")
    return middle.where(F.col(at).isin(list({r[near] for r in rows})))


def concept_connections(nodes: DataFrame, edges: DataFrame, first: str, second: str, limit: int = PATH_LIMIT) -> DataFrame:
    """Undirected paths of one to three relationships between two sets of concepts, shortest first.

    A path may revisit a node but not a relationship.  Among paths of one length the order is by the
    relationship ids, which makes an exact cut possible: a hub keeps only its ``limit + 2`` smallest
    relationships to either end set.  Any path through a larger one is beaten by ``limit`` others that
    differ only there, since at most two of those relationships can already be on the path.  So the
    number of paths built is bounded by the number of edges, however large a hub is.

    Shorter paths come first, so those of a length are only looked for while ``limit`` is not reached; the
    few that are kept are written.  Relationships at an end set are found where they lie, see ``_ending``.
    """
    node_name = F.concat_ws("|", "label", "key")
    concepts = nodes.where("label = 'Concept'").withColumn("node", node_name)
    starts = concepts.where(contains_ignoring_case(F.col("name"), F.lit(first))).select("node")
    ends = concepts.where(contains_ignoring_case(F.col("name"), F.lit(second))).select("node")
    there = edges.select(
        "edge_id", "rel", F.concat_ws("|", "src_label", "src").alias("a"), F.concat_ws("|", "dst_label", "dst").alias("b"),
        F.col("src_label").alias("a_label"), F.col("dst_label").alias("b_label"),
    )
    # a relationship from a node to itself is walked once, all others both ways
    turned = {"a": "b", "b": "a", "a_label": "b_label", "b_label": "a_label"}
    back = there.where("a <> b").select(*[F.col(turned.get(c, c)).alias(c) for c in there.columns])
    both = there.unionByName(back)
    keep = limit + 2
    from_start, to_end = _ending(starts, "a"), _ending(ends, "b")

    def nearest(touching: DataFrame, outer: str, inner: str) -> DataFrame:
        rank = Window.partitionBy(inner).orderBy("edge_id", outer)
        return touching.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= keep).drop("_n")

    into = nearest(from_start(both), "a", "b").select(F.col("a").alias("n0"), F.col("b").alias("n1"), F.col("edge_id").alias("e1"), F.col("rel").alias("r1"))
    out_of = nearest(to_end(both), "b", "a").select(F.col("a").alias("m"), F.col("b").alias("last"), F.col("edge_id").alias("ez"), F.col("rel").alias("rz"))
    one = to_end(from_start(both)).select(
        F.lit(1).alias("length"), F.array("edge_id").alias("ids"), F.array("a", "b").alias("path"), F.array("rel").alias("rels")
    ).orderBy("ids", "path").limit(limit)
    two = into.join(out_of, (F.col("n1") == F.col("m")) & (F.col("e1") != F.col("ez"))).select(
        F.lit(2).alias("length"), F.array("e1", "ez").alias("ids"), F.array("n0", "n1", "last").alias("path"), F.array("r1", "rz").alias("rels")
    )

    def three() -> DataFrame:
        middle = both
        for steps, near, at in ((from_start(both), "b", "a"), (to_end(both), "a", "b")):
            middle = _between(middle, steps, near, at)
        middle = middle.select(F.col("a").alias("n1"), F.col("b").alias("m"), F.col("edge_id").alias("e2"), F.col("rel").alias("r2"))
        return (
            middle.join(into, "n1").where("e1 <> e2")
            .join(out_of, "m").where("ez <> e2 AND ez <> e1")
            .select(
                F.lit(3).alias("length"), F.array("e1", "e2", "ez").alias("ids"),
                F.array("n0", "n1", "m", "last").alias("path"), F.array("r1", "r2", "rz").alias("rels"),
            )
        )

    paths, n = None, 0
    for longer in (lambda: one, lambda: two, three):
        found = written(longer().orderBy("ids", "path").limit(limit - n), "paths")
        paths, n = found if paths is None else paths.unionByName(found), n + found.count()
        if n >= limit:
            break
    return _named_paths(paths, nodes)


def _named_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path nodes as ``label: name``; papers, which have no name, are looked up by title.  There are few paths."""
    titles = nodes.where("label = 'Paper'").select(F.concat_ws("|", "label", "key").alias("node"), "title")
    steps = paths.select("length", "ids", "rels", "path", F.posexplode("path").alias("at", "node"))
    titles = titles.join(F.broadcast(steps.select("node").distinct()), "node", "left_semi")
    label = F.substring_index("node", "|", 1)
    shown = F.when(label == "Paper", F.coalesce("title", F.lit(""))).otherwise(F.expr("substring(node, length(substring_index(node, '|', 1)) + 2)"))
    text = F.concat(label, F.lit(": "), shown)
    named = steps.join(titles, "node", "left").groupBy("length", "ids", "rels", "path").agg(
        F.array_sort(F.collect_list(F.struct("at", text.alias("t")))).alias("_p")
    )
    return named.select("length", "ids", F.transform("_p", lambda p: p["t"]).alias("path_nodes"), F.col("rels").alias("path_rels"))


#: Most words that may be held as one array while names are matched.
WORD_LIMIT = 2000


def contained_words(names: DataFrame, words: DataFrame, limit: int = WORD_LIMIT) -> DataFrame:
    """Pairs (name, word) where the name holds the word, ignoring case; every name holds an empty word.

    A checked number of words goes along as an array and is filtered per name.  More words than that
    are met by an equi-join on the substrings of the names, which are short, so that no pair is ever
    formed that does not match.
    """
    words = words.select("word").distinct()
    rows = rows_within(words, limit)
    if rows is not None:
        if not rows:
            return names.select("name", F.lit("").alias("word")).where(F.lit(False))
        given = F.array(*[F.lit(r["word"]) for r in rows])
        return names.select("name", F.explode(F.filter(given, lambda w: contains_ignoring_case(F.col("name"), w))).alias("word"))
    size = F.length("name")
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.lower(F.substring("name", i, n))),
        )
    )
    parts = F.concat(F.array(F.lit("")), F.when(size > 0, parts).otherwise(F.array().cast("array<string>")))
    pieces = names.where("name IS NOT NULL").select("name", F.explode(F.array_distinct(parts)).alias("_part"))
    return pieces.join(words.withColumn("_part", F.lower("word")), "_part").select("name", "word")


def concept_fan_in(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Papers for the first three key concepts of each question, three per concept, in order.

    ``questions`` is (question_id, key_concepts).  Distinct concept names are matched against the
    concept nodes first; papers are ranked per matched key concept, not per question.
    """
    asked = questions.select("question_id", F.posexplode(F.slice("key_concepts", 1, CONCEPTS_USED)).alias("concept_pos", "asked"))
    concepts = nodes.where("label = 'Concept'").select("name")
    matched = contained_words(concepts, asked.select(F.col("asked").alias("word"))).select(
        F.col("name").alias("concept"), F.col("word").alias("asked")
    )
    papers = nodes.where("label = 'Paper'").select(F.col("key").alias("src"), "title", "year")
    found = (
        edges.where("rel = 'STUDIES_CONCEPT'").select("src", F.col("dst").alias("concept"))
        .join(papers, "src").join(matched, "concept")
        .withColumn("paper_id", F.col("src").cast("long"))
    )
    order = Window.partitionBy("asked").orderBy(F.desc("year"), "paper_id", "concept")
    best = found.withColumn("hit", F.row_number().over(order)).where(F.col("hit") <= PAPERS_PER_CONCEPT)
    place = Window.partitionBy("question_id").orderBy("concept_pos", "hit")
    return (
        asked.join(best, "asked")
        .withColumn("place", F.row_number().over(place))
        .withColumn("total", F.count("*").over(Window.partitionBy("question_id")))
        .select("question_id", "place", "total", "paper_id", "title", "year", "concept")
    )


def graph_context(fan_in: DataFrame) -> DataFrame:
    """Context lines of a question: the first five papers."""
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.col("year").cast("string"), F.lit("): studies "), F.col("concept"))
    rows = fan_in.where(F.col("place") <= PAPERS_SHOWN).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("place", line.alias("t")))).alias("_p"), F.max("total").alias("total")
    )
    return rows.select("question_id", "total", F.array_join(F.transform("_p", lambda p: p["t"]), "\n").alias("kg_context"))


def parse_requests(requests: DataFrame) -> DataFrame:
    """Requests ``NodeType-RELATIONSHIP-!value!`` taken apart."""
    parts = [F.regexp_extract("request", REQUEST_PATTERN, i) for i in (1, 2, 3)]
    return requests.select("request", parts[0].alias("label"), parts[1].alias("rel"), strip(parts[2]).alias("value"))


def knowledge_extract(requests: DataFrame, nodes: DataFrame, edges: DataFrame, passages: DataFrame) -> DataFrame:
    """Graph hits, then passages, at most ten per request; a default text when there is nothing.

    ``passages`` is (request, rank, text): what vector retrieval found for the request.  The graph
    side matches the distinct far ends of a relationship, not every edge, with the request values.
    """
    asked = parse_requests(requests.select("request").distinct())
    ends = edges.select("rel", F.col("src_label").alias("label"), "dst").distinct()
    pairs = contained_words(ends.select(F.col("dst").alias("name")).distinct(), asked.where("value <> ''").select(F.col("value").alias("word")))
    pairs = pairs.select(F.col("name").alias("dst"), F.col("word").alias("value"))
    matched = ends.join(pairs, "dst").join(asked, ["rel", "label", "value"])
    hits = matched.join(edges.withColumnRenamed("src_label", "label"), ["rel", "label", "dst"])
    titles = nodes.select("label", F.col("key").alias("src"), F.coalesce("name", "title").alias("shown"))
    graph = hits.join(titles, ["label", "src"]).select(
        "request", F.lit(0).alias("source"), F.struct("src", "dst").alias("at"),
        F.concat(F.col("shown"), F.lit(" "), F.col("rel"), F.lit(" "), F.col("dst")).alias("text"),
    )
    vector = passages.select(
        "request", F.lit(1).alias("source"),
        F.struct(F.lpad(F.col("rank").cast("string"), 12, "0").alias("src"), F.lit("").alias("dst")).alias("at"), "text",
    )
    order = Window.partitionBy("request").orderBy("source", "at")
    ranked = graph.unionByName(vector).withColumn("place", F.row_number().over(order)).where(F.col("place") <= KNOWLEDGE_LIMIT)
    joined = ranked.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("_p"))
    return asked.select("request").join(joined, "request", "left").select(
        "request",
        F.coalesce(F.array_join(F.transform("_p", lambda p: p["text"]), "\n"), F.lit(NOTHING_FOUND)).alias("knowledge"),
    )
