"""Named retrieval queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions.vectors import cosine_similarity, downsample, float_to_pcm, norm, pcm_to_float, rms, wav_pcm
from emberline.operators import evidence as ev
from emberline.operators import retrieval as rt
from emberline.plans.evidence_batch import chunk_metadata, evidence_batch, question_labels
from emberline.sources.tables import chunks, question_vectors, table

SQL_QUESTIONS = """
qv AS (
  SELECT label::BIGINT AS question_id, 0::BIGINT AS query_pos, list(x ORDER BY dim) AS vec
  FROM (SELECT label, dim, avg(x::DOUBLE) AS x
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
        GROUP BY label, dim)
  GROUP BY label
  UNION ALL
  SELECT label::BIGINT, 1::BIGINT, arg_min(embedding, vec_id)::DOUBLE[] FROM embeddings GROUP BY label
),
ch AS (
  SELECT vec_id, vec_id // 5 AS paper_id, vec_id % 5 AS chunk_index, 's' || (vec_id % 3) AS section,
         label::BIGINT AS category, embedding::DOUBLE[] AS vec
  FROM embeddings
)"""
SQL_SCORED = SQL_QUESTIONS + """,
sc AS (
  SELECT question_id, query_pos, vec_id, paper_id, chunk_index, section, category,
         round(list_cosine_similarity(q.vec, c.vec), 9) AS score
  FROM qv q, ch c
),
top5 AS (
  SELECT * FROM sc QUALIFY row_number() OVER (
    PARTITION BY question_id, query_pos ORDER BY score DESC, paper_id, chunk_index) <= 5
),
best AS (
  SELECT * FROM top5 QUALIFY row_number() OVER (
    PARTITION BY question_id, paper_id, chunk_index ORDER BY score DESC, query_pos) = 1
),
top10 AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, paper_id, chunk_index) AS rank
  FROM best QUALIFY rank <= 10
)"""
SQL_EVIDENCE = SQL_SCORED + """,
meta AS (
  SELECT t.*, d.text, left(d.text, 60) AS title, left(d.text, 80) AS authors,
         CASE WHEN t.vec_id % 7 = 0 THEN 0 ELSE 1990 + t.vec_id % 40 END AS year
  FROM top10 t JOIN documents d ON d.doc_id = t.vec_id
),
sect AS (
  SELECT * FROM meta QUALIFY row_number() OVER (PARTITION BY question_id, paper_id, section ORDER BY rank) = 1
),
evid AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS evidence_pos
  FROM sect QUALIFY evidence_pos <= 10
),
firsts AS (
  SELECT *, min(evidence_pos) OVER (PARTITION BY question_id, paper_id) AS first_pos FROM evid
),
numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY question_id ORDER BY first_pos) AS ref_num FROM firsts
),
refs AS (
  SELECT question_id, ref_num, arg_min(paper_id, evidence_pos) AS paper_id, arg_min(title, evidence_pos) AS title,
         arg_min(year, evidence_pos) AS year, arg_min(authors, evidence_pos) AS authors,
         arg_min(category, evidence_pos) AS category
  FROM numbered GROUP BY question_id, ref_num
)"""


def _scores(df):
    return df.withColumn("score", F.round("score", 6))


def _ranked(spark, d):
    return rt.ranked_hits(question_vectors(spark, d), chunks(spark, d))


def _hits_with_metadata(spark, d):
    return chunk_metadata(_ranked(spark, d), chunks(spark, d), table(spark, d, "documents"))


def _numbered(spark, d):
    return ev.number_references(ev.first_per_section(_hits_with_metadata(spark, d)))


def retrieval_top_k(spark, d):
    return _scores(rt.retrieve(question_vectors(spark, d), chunks(spark, d)))


def retrieval_filtered(spark, d):
    hits = rt.retrieve(question_vectors(spark, d), chunks(spark, d), 3, where=F.col("category") == 3)
    return _scores(hits)


def retrieval_best_hit(spark, d):
    return _scores(rt.keep_best_hit(rt.retrieve(question_vectors(spark, d), chunks(spark, d), rt.PER_QUERY)))


def retrieval_ranked(spark, d):
    return _scores(_ranked(spark, d)).select("question_id", "rank", "paper_id", "chunk_index", "score")


def retrieval_union_counts(spark, d):
    hits = rt.retrieve(question_vectors(spark, d), chunks(spark, d), rt.PER_QUERY)
    return hits.groupBy("question_id").agg(
        F.count("*").alias("hits"), F.countDistinct("paper_id", "chunk_index").alias("distinct_hits")
    )


def best_chunk_per_paper(spark, d):
    return _scores(rt.best_chunk_per_paper(_ranked(spark, d)))


def evidence_rows(spark, d):
    return _numbered(spark, d).select("question_id", "evidence_pos", "ref_num", "paper_id", "section", "chunk_index")


def evidence_references(spark, d):
    return ev.reference_list(_numbered(spark, d)).select("question_id", "ref_num", "paper_id", "title", "year", "category")


def evidence_blocks(spark, d):
    return ev.evidence_text(_numbered(spark, d))


def reference_blocks(spark, d):
    return ev.references_text(ev.reference_list(_numbered(spark, d)))


def reference_entries(spark, d):
    entry = ev.reference_entry(
        F.col("ref_num"), F.col("authors"), F.col("title"), F.col("year"), F.col("category").cast("string")
    )
    return ev.reference_list(_numbered(spark, d)).select("question_id", "ref_num", entry.alias("entry"))


def answer_prompts(spark, d):
    return evidence_batch(
        question_vectors(spark, d), chunks(spark, d), table(spark, d, "documents"), question_labels(spark, d)
    )


def hit_summaries(spark, d):
    return ev.hit_summary(_hits_with_metadata(spark, d))


def run_metadata(spark, d):
    kinds = question_labels(spark, d).select("question_id", "question_type")
    return rt.run_summary(_ranked(spark, d), kinds)


def vector_similarity_to_mean(spark, d):
    """Similarity of every vector to its label's mean, as a column expression."""
    means = question_vectors(spark, d).where("query_pos = 0").select(F.col("question_id").alias("category"), F.col("vec").alias("mean_vec"))
    rows = chunks(spark, d).join(means, "category")
    return rows.select("vec_id", F.round(cosine_similarity(F.col("vec"), F.col("mean_vec")), 6).alias("similarity"))


def vector_levels(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(rms(F.col("embedding")), 6).alias("rms"), F.round(norm(F.col("embedding")), 6).alias("norm")
    )


def pcm_scaling(spark, d):
    """Vectors taken as samples: to int16 and back, and the wave-file variant."""
    loud = F.transform("embedding", lambda x: x.cast("double") * 4)
    pcm = float_to_pcm(loud)
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.array_join(pcm, ",").alias("pcm"),
        F.array_join(wav_pcm(loud), ",").alias("wav"),
        F.round(rms(pcm_to_float(pcm)), 6).alias("rms"),
    )


def resampled(spark, d):
    low = downsample(F.col("embedding"), 48000, 16000)
    odd = downsample(F.col("embedding"), 44100, 16000)
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.size(low).cast("long").alias("n48"),
        F.size(odd).cast("long").alias("n44"),
        F.round(norm(low), 6).alias("norm48"),
        F.round(norm(odd), 6).alias("norm44"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_top_k, retrieval_filtered, retrieval_best_hit, retrieval_ranked, retrieval_union_counts,
        best_chunk_per_paper, evidence_rows, evidence_references, evidence_blocks, reference_blocks,
        reference_entries, answer_prompts, hit_summaries, run_metadata, vector_similarity_to_mean,
        vector_levels, pcm_scaling, resampled,
    )
}

_YEAR = "CASE WHEN year <> 0 THEN ' (' || year || ')' ELSE '' END"
_KIND = "CASE question_id % 5 WHEN 0 THEN 'factual' WHEN 1 THEN 'comparison' WHEN 2 THEN 'causal' WHEN 3 THEN 'process' ELSE 'recommendation' END"
_EVIDENCE_TEXT = """string_agg('[' || ref_num || '] (' || section || ') ' || left(text, 600), chr(10) || chr(10) ORDER BY evidence_pos)"""

ORACLES = {
    "retrieval_top_k": f"""WITH {SQL_SCORED}
SELECT question_id, query_pos, paper_id, chunk_index, round(score, 6) AS score FROM sc
QUALIFY row_number() OVER (PARTITION BY question_id, query_pos ORDER BY score DESC, paper_id, chunk_index) <= 10""",
    "retrieval_filtered": f"""WITH {SQL_SCORED}
SELECT question_id, query_pos, paper_id, chunk_index, round(score, 6) AS score FROM sc WHERE category = 3
QUALIFY row_number() OVER (PARTITION BY question_id, query_pos ORDER BY sc.score DESC, paper_id, chunk_index) <= 3""",
    "retrieval_best_hit": f"""WITH {SQL_SCORED}
SELECT question_id, query_pos, paper_id, chunk_index, round(score, 6) AS score FROM best""",
    "retrieval_ranked": f"""WITH {SQL_SCORED}
SELECT question_id, rank, paper_id, chunk_index, round(score, 6) AS score FROM top10""",
    "retrieval_union_counts": f"""WITH {SQL_SCORED}
SELECT question_id, count(*) AS hits, count(DISTINCT (paper_id, chunk_index)) AS distinct_hits FROM top5 GROUP BY 1""",
    "best_chunk_per_paper": f"""WITH {SQL_SCORED}
SELECT question_id, paper_id, chunk_index, round(score, 6) AS score FROM top10
QUALIFY row_number() OVER (PARTITION BY question_id, paper_id ORDER BY top10.score DESC, rank) = 1""",
    "evidence_rows": f"""WITH {SQL_EVIDENCE}
SELECT question_id, evidence_pos, ref_num, paper_id, section, chunk_index FROM numbered""",
    "evidence_references": f"""WITH {SQL_EVIDENCE}
SELECT question_id, ref_num, paper_id, title, year, category FROM refs""",
    "evidence_blocks": f"""WITH {SQL_EVIDENCE}
SELECT question_id, {_EVIDENCE_TEXT} AS evidence_text FROM numbered GROUP BY question_id""",
    "reference_blocks": f"""WITH {SQL_EVIDENCE}
SELECT question_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**参考文献：**' || chr(10) ||
  string_agg('[' || ref_num || '] ' || CASE WHEN length(authors) > 50 THEN left(authors, 50) || ' et al.' ELSE authors END
    || '. "' || title || '"' || {_YEAR}, chr(10) ORDER BY ref_num) AS references_text
FROM refs GROUP BY question_id""",
    "reference_entries": f"""WITH {SQL_EVIDENCE}
SELECT question_id, ref_num, '[' || ref_num || '] ' || CASE WHEN length(authors) > 60 THEN left(authors, 60) || ' et al.' ELSE authors END
    || '. "' || title || '"' || {_YEAR} || ' [' || category || ']' AS entry FROM refs""",
    "answer_prompts": f"""WITH {SQL_EVIDENCE},
texts AS (SELECT question_id, {_EVIDENCE_TEXT} AS evidence_text FROM numbered GROUP BY question_id),
ql AS (SELECT label::BIGINT AS question_id, count(*) AS n FROM embeddings GROUP BY label)
SELECT question_id, {_KIND} AS question_type,
  '**用户问题：** ' || 'Which chunks of category ' || question_id || ' matter most among ' || n || '?' || chr(10) || chr(10)
  || '**相关文献证据：**' || chr(10) || evidence_text || chr(10) AS prompt
FROM ql JOIN texts USING (question_id)""",
    "hit_summaries": f"""WITH {SQL_EVIDENCE}
SELECT question_id,
  string_agg('> - [' || rank || '] ' || left(title, 60) || ' (' || CASE WHEN year <> 0 THEN year::VARCHAR ELSE '?' END
    || ') -- 相关度 ' || round_even(score * 100, 0)::BIGINT || '%', chr(10) ORDER BY rank) FILTER (rank <= 5)
  || CASE WHEN count(*) > 5 THEN chr(10) || '> - ... 及其他 ' || (count(*) - 5) || ' 条' ELSE '' END AS summary
FROM meta GROUP BY question_id""",
    "run_metadata": f"""WITH {SQL_SCORED},
q AS (SELECT DISTINCT label::BIGINT AS question_id FROM embeddings),
n AS (SELECT question_id, count(*) AS chunk_count FROM top10 GROUP BY 1)
SELECT question_id, {_KIND} AS question_type, coalesce(chunk_count, 0) AS chunk_count,
       {_KIND} IN ('comparison', 'causal', 'recommendation') AS complex
FROM q LEFT JOIN n USING (question_id)""",
    "vector_similarity_to_mean": f"""WITH {SQL_QUESTIONS}
SELECT vec_id, round(list_cosine_similarity(c.vec, q.vec), 6) AS similarity
FROM ch c JOIN qv q ON q.question_id = c.category AND q.query_pos = 0""",
    "vector_levels": """
SELECT vec_id, round(sqrt(list_inner_product(v, v) / len(v)), 6) AS rms, round(sqrt(list_inner_product(v, v)), 6) AS norm
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
    "pcm_scaling": """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 4) AS v FROM embeddings),
p AS (
  SELECT vec_id, v, list_transform(list_transform(v, lambda x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x))),
    lambda x: floor(CASE WHEN x < 0 THEN x * 32768 ELSE x * 32767 END + 0.5)::INTEGER) AS pcm FROM s
)
SELECT vec_id, array_to_string(pcm, ',') AS pcm,
  array_to_string(list_transform(v, lambda x: trunc(greatest(-32768.0::DOUBLE, least(32767.0::DOUBLE, x * 32768)))::INTEGER), ',') AS wav,
  round(sqrt(list_sum(list_transform(pcm, lambda x: (x / 32768.0::DOUBLE) ** 2)) / len(pcm)), 6) AS rms
FROM p""",
    "resampled": """
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) AS n FROM embeddings),
r AS (
  SELECT vec_id, v, n, ratio, i, i * ratio AS pos
  FROM s, (VALUES (48000 / 16000.0::DOUBLE), (44100 / 16000.0::DOUBLE)) t(ratio), unnest(range(0, floor(n / ratio)::BIGINT)) u(i)
),
y AS (
  SELECT vec_id, ratio, v[floor(pos)::BIGINT + 1] * (1 - (pos - floor(pos)))
     + v[least(floor(pos)::BIGINT + 1, n - 1) + 1] * (pos - floor(pos)) AS y FROM r
)
SELECT vec_id, count(*) FILTER (ratio = 3) AS n48, count(*) FILTER (ratio <> 3) AS n44,
  round(sqrt(sum(y * y) FILTER (ratio = 3)), 6) AS norm48, round(sqrt(sum(y * y) FILTER (ratio <> 3)), 6) AS norm44
FROM y GROUP BY vec_id""",
}
