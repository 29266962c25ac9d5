"""Named corpus queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import text as tx
from emberline.operators import sections as sc
from emberline.operators import tagging as tg
from emberline.plans import ingest as ing
from emberline.sources import catalog as ct
from emberline.sources.tables import documents, papers, table


def corpus_files(spark, d):
    """The table files under the folder, found recursively (names only: paths differ between hosts)."""
    files = ct.find_files(spark, d, "*.parquet")
    return files.select(F.substring_index("file_path", "/", -1).alias("name"), "length")


def paper_paths(spark, d):
    path = tx.normalise_path(F.col("raw_path"))
    page_path = F.regexp_replace("url", r"^https?:/|[?#].*$", "")
    mine = papers(spark, d).select(path.alias("path"))
    web = table(spark, d, "pages").select(tx.normalise_path(page_path).alias("path"))
    return mine.unionByName(web).select("path", tx.path_category(F.col("path")).alias("category"))


def paper_titles(spark, d):
    text = sc.full_text(F.col("pages"))
    path = tx.normalise_path(F.col("raw_path"))
    return papers(spark, d).select(
        "paper_id", tx.guess_title(text, path).alias("title"), tx.guess_year(text).cast("long").alias("year"), sc.usable(text).alias("usable")
    )


def page_offsets(spark, d):
    rows = papers(spark, d).select("paper_id", F.posexplode(sc.page_offsets(F.col("pages"))).alias("page", "offset"))
    return rows.select("paper_id", F.col("page").cast("long").alias("page"), F.col("offset").cast("long").alias("offset"))


def paper_sections(spark, d):
    rows = sc.with_sections(papers(spark, d)).select("paper_id", F.posexplode_outer("sections").alias("section_no", "s")).where("section_no IS NOT NULL")
    return rows.select(
        "paper_id", F.col("section_no").cast("long").alias("section_no"), "s.title", "s.text",
        *[F.col(f"s.{c}").cast("long").alias(c) for c in ("page_start", "page_end", "start", "stop")],
    )


def document_chunks(spark, d):
    docs = documents(spark, d).select("doc_id", F.posexplode_outer(sc.chunk_text(F.col("text"))).alias("chunk_index", "chunk")).where("chunk_index IS NOT NULL")
    return docs.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


def paper_chunks(spark, d):
    return sc.chunk_rows(sc.with_chunks(sc.with_sections(papers(spark, d))), "paper_id")


def chunks_per_paper(spark, d):
    return paper_chunks(spark, d).groupBy("paper_id").agg(F.count("*").alias("chunks"))


def chunk_store(spark, d):
    parsed = ing.parsed_papers(papers(spark, d))
    base = parsed.withColumn("authors", F.split("lang", "")).withColumn("keywords", F.array("source", "lang"))
    return ct.store_rows(paper_chunks(spark, d), base).select(
        "id", "section", "text", "title", "category", F.col("year").cast("long").alias("year"), "authors", "keywords"
    )


def _seen(spark, d):
    """Paths of the French papers, which count as ingested before."""
    return papers(spark, d).where("lang = 'fr'").select(tx.normalise_path(F.col("raw_path")).alias("file_path"))


def unseen_papers(spark, d):
    rows = papers(spark, d).select("paper_id", tx.normalise_path(F.col("raw_path")).alias("file_path"))
    return ct.unseen(rows, _seen(spark, d))


def ingest_outcomes(spark, d):
    report = ing.outcome_report(ing.ingest(papers(spark, d), _seen(spark, d)).outcomes)
    return report.withColumn("mean_chunks", F.round("mean_chunks", 6))


def ingest_catalog(spark, d):
    rows = ing.ingest(papers(spark, d), _seen(spark, d)).catalog
    return rows.select("file_path", "title", "authors", F.col("year").cast("long").alias("year"), "category", "language", "chunk_count")


def ingest_chunks(spark, d):
    rows = ing.ingest(papers(spark, d), _seen(spark, d)).chunks
    return rows.groupBy("category").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def catalog_upsert(spark, d):
    """A first catalogue, then German papers again with new titles and French ones for the first time."""
    text = sc.full_text(F.col("pages"))
    path = tx.normalise_path(F.col("raw_path"))
    rows = papers(spark, d).select(path.alias("file_path"), "lang", F.length(text).cast("long").alias("chars"))
    first = rows.where("lang <> 'fr'").select("file_path", "lang", "chars", F.lit("first").alias("batch"))
    second = rows.where("lang IN ('de', 'fr')").select("file_path", "lang", "chars", F.lit("second").alias("batch"))
    return ct.upsert(first, second, "file_path")


def catalog_lists(spark, d):
    """JSON lists written and parsed again, cut to the first authors and keywords."""
    words = F.split("text", " ", -1)
    rows = documents(spark, d).select(
        "doc_id", F.to_json(words).alias("authors"), F.to_json(F.slice(words, 2, 1 << 30)).alias("keywords"), F.lit(None).cast("string").alias("auto_topics")
    )
    lists = ct.catalog_lists(rows)
    return lists.select(
        "doc_id", F.array_join(F.slice("authors", 1, ct.AUTHORS_KEPT), ", ").alias("authors"),
        F.array_join(F.slice("keywords", 1, ct.KEYWORDS_KEPT), ", ").alias("keywords"), F.size("auto_topics").cast("long").alias("n_topics"),
    )


def text_measures(spark, d):
    return documents(spark, d).select(
        "doc_id", tx.token_estimate(F.col("text")).alias("tokens"), tx.has_cjk(F.col("text")).alias("cjk"), tx.is_ascii(F.col("text")).alias("ascii")
    )


def _terms(spark, d):
    """A vocabulary from the data: the first words of the benchmark items."""
    return tg.vocabulary(table(spark, d, "benchmark").select(F.lower(F.get(F.split("text", " "), F.lit(0))).alias("term")))


def document_tags(spark, d):
    found = tg.tags(F.col("text"), _terms(spark, d))
    merged = tg.merge_tags(found, F.array(F.concat(F.lit(" "), F.upper("lang")), F.lit("  ")))
    return documents(spark, d).select("doc_id", F.array_join(merged, ",").alias("tags"))


def topic_tags(spark, d):
    """The controlled vocabulary over documents: counts per topic."""
    found = tg.tags(F.concat_ws(" ", "text", F.when(F.col("lang") == "de", F.lit("Pyrolysis, porosity, CSR and csr"))), tg.COKING_TOPICS)
    return documents(spark, d).select(F.explode_outer(found).alias("topic")).where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("documents"))


def document_entities(spark, d):
    terms = _terms(spark, d)
    families = {"concepts": terms[::2], "methods": terms[1::2]}
    rows = tg.dictionary_entities(documents(spark, d).select("doc_id", "text"), "text", families)
    return rows.select(
        "doc_id", F.array_join("concepts", ",").alias("concepts"), F.array_join("methods", ",").alias("methods"),
        F.array_join(F.transform("concept_relations", lambda p: F.array_join(p, "-")), ",").alias("relations"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        corpus_files, paper_paths, paper_titles, page_offsets, paper_sections, document_chunks, paper_chunks,
        chunks_per_paper, chunk_store, unseen_papers, ingest_outcomes, ingest_catalog, ingest_chunks, catalog_upsert,
        catalog_lists, text_measures, document_tags, topic_tags, document_entities,
    )
}

_STRIP = "regexp_replace({0}, '^[\\s\\x0b\\x1c-\\x1f\\x85\\x{{a0}}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\x{{a0}}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


SQL_PAPERS = """
p0 AS (
  SELECT doc_id AS paper_id, lang, source, '/corpus/Coal blend paper/' || source || '/' || doc_id || '.pdf' AS file_path,
    string_split(replace(replace(replace(replace(replace(text, chr(10) || 'The ', chr(10) || 'Results and Discussion' || chr(10) || 'The '),
      chr(10) || 'To ', chr(10) || '2. Methods' || chr(10) || 'To '), chr(10) || 'De ', chr(10) || 'Introduction' || chr(10) || 'De '),
      chr(10) || 'Der ', chr(10) || 'Conclusions' || chr(10) || 'Der '), chr(10) || 'In ', chr(10) || chr(10) || 'In '), chr(10) || 'It ') AS pages
  FROM documents
),
p AS (SELECT *, array_to_string(pages, chr(10)) AS text FROM p0),
off AS (
  SELECT paper_id, page, coalesce(sum(len) OVER (PARTITION BY paper_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM (SELECT paper_id, unnest(list_transform(pages, lambda x: length(x) + 1)) AS len, generate_subscripts(pages, 1) - 1 AS page FROM p)
)"""
_HEAD = sc.HEADING
SQL_SECTIONS = SQL_PAPERS + f""",
cut AS (SELECT paper_id, len(pages) AS n_pages, string_split(regexp_replace(text, '(?im)^({_HEAD})', chr(57344) || '\\1', 'g'), chr(57344)) AS parts FROM p),
piece AS (SELECT paper_id, n_pages, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS no FROM cut),
span AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY paper_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM piece),
span2 AS (SELECT *, start + length(part) AS stop FROM span),
kept AS (
  SELECT paper_id, no, n, n_pages, CASE WHEN n = 1 THEN 'Full Text' WHEN no = 1 THEN 'Preamble' ELSE {_strip(f"regexp_extract(part, '(?im)^{_HEAD}')")} END AS title,
    {_strip('part')} AS text, start, stop FROM span2
  WHERE n = 1 OR no > 1 OR (stop > 200 AND {_strip('part')} <> '')
),
sect AS (
  SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY no) - 1 AS section_no, title, text, start, stop,
    CASE WHEN no = 1 THEN 0 ELSE (SELECT max(page) FROM off WHERE off.paper_id = kept.paper_id AND "offset" <= start) END AS page_start,
    CASE WHEN n = 1 THEN n_pages - 1 WHEN no = 1 THEN (SELECT max(page) FROM off WHERE off.paper_id = kept.paper_id AND "offset" <= stop)
      ELSE (SELECT max(page) FROM off WHERE off.paper_id = kept.paper_id AND "offset" <= stop - 1) END AS page_end
  FROM kept
)"""


def _chunker(source: str, key: str) -> str:
    """A recursive chunker over ``source`` (key columns, text)."""
    return f"""
walk AS (
  WITH RECURSIVE w AS (
    SELECT {key}, text, length(text) AS n, 0::BIGINT AS start, NULL::BIGINT AS stop, 0::BIGINT AS step FROM {source} WHERE length(text) > 2000
    UNION ALL
    SELECT {key}, text, n, e - 200, e, step + 1 FROM (
      SELECT *, CASE WHEN start + 2000 >= n THEN start + 2000 WHEN para > 0 THEN start + 2000 - para - 1 WHEN sent > 0 THEN start + 2000 - sent ELSE start + 2000 END AS e
      FROM (SELECT *, strpos(reverse(text[start + 1001:start + 2000]), chr(10) || chr(10)) AS para, strpos(reverse(text[start + 1001:start + 2000]), ' .') AS sent FROM w WHERE start < n)
    )
  )
  SELECT {key}, step, {_strip('text[lag_start + 1:stop]')} AS chunk FROM (
    SELECT *, lag(start, 1, 0) OVER (PARTITION BY {key} ORDER BY step) AS lag_start FROM w) WHERE step > 0
),
chunked AS (
  SELECT {key}, step, chunk FROM walk WHERE chunk <> ''
  UNION ALL SELECT {key}, 1, text FROM {source} WHERE length(text) <= 2000
)"""


SQL_CHUNKS = SQL_SECTIONS + "," + _chunker("sect", "paper_id, section_no") + """,
pc AS (
  SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY section_no, step) - 1 AS chunk_index, title AS section, chunk AS text
  FROM chunked JOIN sect USING (paper_id, section_no)
)"""
_TITLE = f"""coalesce(left(list_filter(list_filter(list_transform(string_split({_strip('text')}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')[1:10],
  lambda x: length(x) > 15 AND NOT regexp_matches(x, '(?i)^(page|vol|issue|doi|http|www)'))[1], 200), paper_id::VARCHAR)"""
_YEAR = "CASE WHEN y BETWEEN 1950 AND 2030 THEN y END"
SQL_META = SQL_CHUNKS + f""",
meta AS (
  SELECT paper_id, lang, source, file_path, {_TITLE} AS title, nullif(regexp_extract(left(text, 3000), '(19|20)[0-9][0-9]'), '')::BIGINT AS y,
    length({_strip('text')}) >= 100 AS usable FROM p
),
cnt AS (SELECT paper_id, count(*) AS chunk_count FROM pc GROUP BY 1),
outc AS (
  SELECT meta.*, coalesce(chunk_count, 0) AS chunk_count, CASE WHEN lang = 'fr' THEN 'skipped' WHEN usable AND coalesce(chunk_count, 0) > 0 THEN 'success' ELSE 'failed' END AS status
  FROM meta LEFT JOIN cnt USING (paper_id)
)"""
_VOCAB = "(SELECT list_sort(list(DISTINCT lower(string_split(text, ' ')[1]))) FROM benchmark)"
_TOPICS = "[" + ", ".join(f"'{t}'" for t in tg.COKING_TOPICS) + "]"
_TAGGED = """
u AS (SELECT doc_id, term, (length(low) - length(replace(low, lower(term), ''))) // length(term) AS n FROM t, unnest(v) x(term)),
r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS k FROM u WHERE n > 0 QUALIFY k <= 5)"""

ORACLES = {
    "paper_paths": f"""WITH {SQL_PAPERS}
SELECT file_path AS path, source AS category FROM p
UNION ALL SELECT regexp_replace(url, '^https?:/|[?#].*$', '', 'g'), 'uncategorized' FROM pages""",
    "paper_titles": f"""WITH {SQL_META} SELECT paper_id, title, {_YEAR} AS year, usable FROM meta""",
    "page_offsets": f"""WITH {SQL_PAPERS} SELECT paper_id, page, "offset" FROM off""",
    "paper_sections": f"WITH {SQL_SECTIONS} SELECT paper_id, section_no, title, text, page_start, page_end, start, stop FROM sect",
    "document_chunks": f"""WITH {_chunker('documents', 'doc_id')}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS chunk_index, chunk FROM chunked""",
    "paper_chunks": f"WITH {SQL_CHUNKS} SELECT paper_id, chunk_index, section, text FROM pc",
    "chunks_per_paper": f"WITH {SQL_CHUNKS} SELECT paper_id, count(*) AS chunks FROM pc GROUP BY paper_id",
    "chunk_store": f"""WITH {SQL_META}
SELECT paper_id || '_' || chunk_index AS id, section, pc.text, left(title, 200) AS title, source AS category, coalesce({_YEAR}, 0) AS year,
  left(lang, 1) || ', ' || lang[2:2] AS authors, source || ', ' || lang AS keywords
FROM pc JOIN meta USING (paper_id)""",
    "unseen_papers": f"WITH {SQL_PAPERS} SELECT paper_id, file_path FROM p WHERE lang <> 'fr'",
    "ingest_outcomes": f"""WITH {SQL_META}
SELECT status, count(*) AS papers, sum(CASE WHEN status = 'skipped' THEN 0 ELSE chunk_count END)::BIGINT AS chunks,
  round(avg(CASE WHEN status = 'skipped' THEN 0 ELSE chunk_count END), 6) AS mean_chunks FROM outc GROUP BY status""",
    "ingest_catalog": f"""WITH {SQL_META}
SELECT file_path, title, '[]' AS authors, {_YEAR} AS year, source AS category, lang AS language, chunk_count FROM outc WHERE status = 'success'""",
    "ingest_chunks": f"""WITH {SQL_META}
SELECT source AS category, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM pc JOIN outc USING (paper_id) WHERE status = 'success' GROUP BY 1""",
    "catalog_upsert": f"""WITH {SQL_PAPERS}
SELECT file_path, lang, length(text) AS chars, CASE WHEN lang IN ('de', 'fr') THEN 'second' ELSE 'first' END AS batch FROM p""",
    "catalog_lists": """
SELECT doc_id, array_to_string(w[1:5], ', ') AS authors, array_to_string(w[2:11], ', ') AS keywords, 0 AS n_topics
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
    "text_measures": """
SELECT doc_id, length(text) // 4 AS tokens, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS cjk, length(text) > 0 AND length(text) = strlen(text) AS ascii FROM documents""",
    "document_tags": f"""WITH t AS (SELECT doc_id, lang, lower(text) AS low, {_VOCAB} AS v FROM documents), {_TAGGED}
SELECT doc_id, coalesce(string_agg(term, ',' ORDER BY k) || ',', '') || any_value(lang) AS tags FROM t LEFT JOIN r USING (doc_id) GROUP BY doc_id""",
    "topic_tags": f"""WITH t AS (SELECT doc_id, lower(text || CASE WHEN lang = 'de' THEN ' Pyrolysis, porosity, CSR and csr' ELSE '' END) AS low, {_TOPICS} AS v FROM documents), {_TAGGED}
SELECT term AS topic, count(*) AS documents FROM r GROUP BY term""",
    "document_entities": f"""
WITH v AS (SELECT {_VOCAB} AS v),
u AS (SELECT doc_id, term, i, strpos(lower(text), term) AS pos FROM documents, (SELECT unnest(v) AS term, generate_subscripts(v, 1) AS i FROM v) WHERE contains(lower(text), term)),
c AS (SELECT doc_id, list(term ORDER BY pos, term) FILTER (i % 2 = 1) AS c, list(term ORDER BY pos, term) FILTER (i % 2 = 0) AS m FROM u GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(c, ','), '') AS concepts, coalesce(array_to_string(m, ','), '') AS methods,
  coalesce(array_to_string(list_transform(range(1, len(c)), lambda k: c[k] || '-' || c[k + 1]), ','), '') AS relations
FROM documents LEFT JOIN c USING (doc_id)""",
}
