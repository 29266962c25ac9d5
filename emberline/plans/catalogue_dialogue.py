"""Named dialogue and routing queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import jsontext as js
from emberline.functions import routing as ro
from emberline.functions.text import clauses, sentences, token_estimate
from emberline.operators import dialogue as dg
from emberline.operators.sliced import SLICE_ROWS, ordered_concat
from emberline.session import fresh_path
from emberline.sources.chatlog import append_turns
from emberline.sources.tables import messages, table, turns

PHRASES = ["今日煤炭价格", "把方案填入焦炉", "添加一个煤", "你好！", "预测一下CSR", "What is coke"]
REPLIES = ['"Factual"', "comparison of methods", "CAUSAL", "no idea", "general_chat, optimization", "process"]
CUES = ["attion", "thing", "ungen", "eau"]


def _turns(spark, d):
    return turns(spark, d)


def session_titles(spark, d):
    rows = messages(spark, d).select("session_id", (F.col("session_id") % 10).alias("user_id")).distinct()
    return dg.session_list(rows, _turns(spark, d))


def session_last_times(spark, d):
    return _turns(spark, d).groupBy("session_id").agg(F.max("ts_sec").alias("last_ts"))


def chat_messages(spark, d):
    return dg.message_rows(_turns(spark, d)).orderBy("session_id", "ts_sec", "turn", "part").drop("part")


def chat_log(spark, d):
    """The log written in two appends and read back."""
    rows = _turns(spark, d)
    path = fresh_path(spark, "chatlog")
    append_turns(rows.where("user_id < 5"), path)
    append_turns(rows.where("user_id >= 5"), path)
    return spark.read.parquet(path)


def message_context(spark, d):
    return dg.with_context(messages(spark, d)).select("session_id", "turn", "context")


def user_turn_context(spark, d):
    """The last six user texts, without cutting or hint."""
    asked = messages(spark, d).where("role = 'user'").withColumn("asked", F.col("turn"))
    from emberline.operators.sliced import positions

    placed = positions(asked.withColumn("slice", F.expr(f"turn div {SLICE_ROWS}")), ["session_id"], "slice", ["turn"], "pos").drop("slice")
    rows = dg.with_context(placed.withColumn("turn", F.col("pos")), dg.CONTEXT_TURNS, 10**6, None)
    return rows.select("session_id", F.col("asked").alias("turn"), "context")


def recent_messages(spark, d):
    return dg.recent_history(messages(spark, d), 3).select("session_id", "turn", "role")


def token_usage(spark, d):
    usage = messages(spark, d).select("session_id", F.col("role").alias("model"), token_estimate(F.col("text")).alias("tokens"))
    return dg.usage_totals(usage)


def transcript_assembly(spark, d):
    seg = F.when(F.col("role") == "system", F.lit("sys")).otherwise(F.expr("turn div 2").cast("string"))
    rows = messages(spark, d).select("session_id", seg.alias("seg_id"), F.col("turn").alias("arrival"), "text")
    return dg.assemble_transcripts(rows)


def conversation_texts(spark, d):
    rows = messages(spark, d).withColumn("slice", F.expr(f"turn div {SLICE_ROWS}"))
    return ordered_concat(rows, ["session_id"], "slice", ["turn"], "text", "full_text", "\n")


def message_sentences(spark, d):
    parts = sentences(F.col("text"))
    return messages(spark, d).select(
        "session_id", "turn", F.array_join(parts["complete"], "¦").alias("complete"), parts["rest"].alias("rest")
    )


def sentence_ids(spark, d):
    return dg.sentence_rows(messages(spark, d).where("role = 'assistant'"))


def message_clauses(spark, d):
    parts = clauses(F.col("text"))
    return messages(spark, d).select(
        "session_id", "turn", F.array_join(parts["complete"], "¦").alias("complete"), parts["rest"].alias("rest")
    )


def domain_mentions(spark, d):
    return messages(spark, d).where(dg.mentions_any(F.col("text"), CUES)).select("session_id", "turn")


def _questions(spark, d):
    """A question per message: a phrase chosen by position, with the text unless it is a greeting."""
    at = ((F.col("session_id") + F.col("turn")) % 6).cast("int")
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), at)
    return messages(spark, d).select(
        "session_id", "turn",
        F.when(at == 3, phrase).otherwise(F.concat(phrase, F.lit(" "), "text")).alias("question"),
        F.get(F.array(*[F.lit(p) for p in REPLIES]), ((F.col("session_id") * 5 + F.col("turn")) % 6).cast("int")).alias("label"),
    )


def question_types(spark, d):
    rows = _questions(spark, d).withColumn("kind", ro.question_type(F.col("question"), F.col("label")))
    return rows.select(
        "session_id", "turn", "kind",
        ro.is_complex(F.col("kind")).alias("complex"), ro.needs_retrieval(F.col("kind")).alias("retrieves"),
        ro.route_after_graph(F.col("kind"), F.col("turn")).alias("after_graph"),
    )


def question_agents(spark, d):
    return _questions(spark, d).select("session_id", "turn", ro.keyword_agent(F.col("question")).alias("agent"))


def _replies(spark, d):
    """Model replies made from events: fenced, plain or broken JSON with agents by event type."""
    first = F.expr(
        "CASE event_type WHEN 'click' THEN 'coal_price' WHEN 'view' THEN 'knowledge_qa' "
        "WHEN 'purchase' THEN 'optimization' WHEN 'signup' THEN 'simple_chat' ELSE 'robot' END"
    )
    body = F.concat(
        F.lit('{"agents": ["'), first, F.lit('", "teapot"'),
        F.when(F.col("value") > 50, F.lit(', "optimization"')).otherwise(F.lit("")),
        F.lit('], "reasoning": "r"}'),
    )
    kind = F.col("event_id") % 3
    reply = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, body).otherwise(F.left(body, F.lit(30)))
    return table(spark, d, "events").select("event_id", "event_type", "value", "user_id", reply.alias("reply"))


def agent_plans(spark, d):
    plan = ro.agent_plan(F.col("reply"))
    rows = _replies(spark, d).withColumn("plan", plan)
    first = F.get("plan", F.lit(0))
    return rows.select(
        "event_id",
        F.array_join("plan", ",").alias("plan"),
        ro.plan_display(F.col("plan")).alias("display"),
        ro.agent_type(first).alias("kind"),
        ro.route_after_plan(F.col("plan"), F.lit(0)).alias("route"),
        ro.route_after_plan(F.col("plan"), F.lit(1)).alias("second_route"),
    )


def parsed_metadata(spark, d):
    """Metadata replies over documents: fenced JSON with missing fields, or broken ones."""
    head = F.get(F.split("text", "\n", -1), F.lit(0))
    body = F.concat(
        F.lit('{"title": "T'), F.col("doc_id").cast("string"), F.lit('", "authors": ["A", "B'), F.col("doc_id").cast("string"), F.lit('"]'),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(', "year": '), (F.col("doc_id") % 50 + 1970).cast("string"))).otherwise(F.lit("")),
        F.lit("}"),
    )
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, body).otherwise(F.concat(F.lit("Sorry: "), head))
    rows = table(spark, d, "documents").select("doc_id", js.metadata(reply, F.col("text")).alias("m"))
    return rows.select(
        "doc_id", "m.title", F.array_join("m.authors", ", ").alias("authors"), "m.abstract",
        F.size("m.keywords").cast("long").alias("n_keywords"), F.col("m.year").cast("long").alias("year"),
    )


def parsed_queries(spark, d):
    body = F.concat(F.lit('{"english_queries": ["q'), F.col("turn").cast("string"), F.lit('", "coke"], "key_concepts": ["CSR"]}'))
    reply = F.when(F.col("turn") % 2 == 0, body).otherwise(F.lit("none"))
    parsed = js.search_queries(reply, F.col("text"))
    rows = messages(spark, d).select("session_id", "turn", parsed.alias("p"))
    return rows.select(
        "session_id", "turn", F.array_join("p.english_queries", "|").alias("queries"),
        F.array_join("p.key_concepts", "|").alias("concepts"), F.size("p.key_methods").cast("long").alias("n_methods"),
    )


def follow_up_blocks(spark, d):
    body = F.concat(
        F.lit('["'), F.col("event_type"), F.lit('?", "'), F.col("user_id").cast("string"), F.lit('?", "c?", "d?"]')
    )
    reply = F.when(F.col("event_id") % 4 == 0, F.lit("sorry")).otherwise(body)
    return table(spark, d, "events").select("event_id", js.follow_up_block(js.follow_ups(reply)).alias("block"))


QUERIES = {
    f.__name__: f
    for f in (
        session_titles, session_last_times, chat_messages, chat_log, message_context, user_turn_context,
        recent_messages, token_usage, transcript_assembly, conversation_texts, message_sentences, sentence_ids,
        message_clauses, domain_mentions, question_types, question_agents, agent_plans, parsed_metadata,
        parsed_queries, follow_up_blocks,
    )
}

SQL_TURNS = """
m AS (SELECT conv_id AS session_id, turn, role, text FROM conversations),
t AS (
  SELECT session_id, session_id % 10 AS user_id, turn, 1704067200 + turn * 60 + session_id AS ts_sec, text AS user_message,
         coalesce(CASE WHEN next_role = 'assistant' THEN next_text END, '') AS bot_response
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM m WINDOW w AS (PARTITION BY session_id ORDER BY turn))
  WHERE role = 'user'
)"""
_MARKS = "[。！？.!?]"
SQL_SENTENCES = SQL_TURNS + f""",
s0 AS (
  SELECT *, string_split(regexp_replace(text, '({_MARKS})\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts,
         regexp_matches(text, '{_MARKS}\\s*$') AS closed FROM m
),
s AS (
  SELECT session_id, turn, role, CASE WHEN len(parts) <= 1 THEN []::VARCHAR[] WHEN closed THEN parts ELSE parts[:len(parts) - 1] END AS complete,
         CASE WHEN len(parts) <= 1 THEN text WHEN closed THEN '' ELSE parts[-1] END AS rest FROM s0
),
sf AS (SELECT session_id, turn, role, list_filter(complete, lambda p: p <> '') AS complete, rest FROM s)"""
_PHRASES = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_LABELS = "[" + ", ".join("'" + p + "'" for p in REPLIES) + "]"
SQL_QUESTIONS = SQL_TURNS + f""",
q AS (
  SELECT session_id, turn, CASE WHEN (session_id + turn) % 6 = 3 THEN {_PHRASES}[4] ELSE {_PHRASES}[(session_id + turn) % 6 + 1] || ' ' || text END AS question,
         {_LABELS}[(session_id * 5 + turn) % 6 + 1] AS label FROM m
)"""
_CHAIN = " ".join(f"WHEN contains(l, '{t}') THEN '{t}'" for t in ro.QUESTION_TYPES)

ORACLES = {
    "session_titles": f"""WITH {SQL_TURNS},
f AS (SELECT session_id, arg_min(user_message, (ts_sec, turn)) FILTER (user_message <> '') AS first, max(ts_sec) AS last_ts FROM t GROUP BY 1)
SELECT s.session_id, s.session_id % 10 AS user_id, coalesce(left(first, 10), '新对话') AS title, last_ts
FROM (SELECT DISTINCT session_id FROM m) s LEFT JOIN f USING (session_id)""",
    "session_last_times": f"WITH {SQL_TURNS} SELECT session_id, max(ts_sec) AS last_ts FROM t GROUP BY session_id",
    "chat_messages": f"""WITH {SQL_TURNS}
SELECT session_id, turn, ts_sec, user_message AS text, 'user' AS type FROM t WHERE trim(user_message) <> ''
UNION ALL SELECT session_id, turn, ts_sec, bot_response, 'bot' FROM t WHERE trim(bot_response) <> ''""",
    "chat_log": f"""WITH {SQL_TURNS}
SELECT session_id, turn, ts_sec, user_message, CASE WHEN trim(bot_response) = '' THEN '（空响应或被中断）' ELSE trim(bot_response) END AS bot_response FROM t""",
    "message_context": f"""WITH {SQL_TURNS}
SELECT session_id, turn, '{dg.DOMAIN_HINT}' || coalesce(' ' || string_agg(left(trim(text), 200), ' ') OVER (
  PARTITION BY session_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '') AS context FROM m""",
    "user_turn_context": f"""WITH {SQL_TURNS}
SELECT session_id, turn, coalesce(string_agg(trim(text), ' ') OVER (
  PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS context FROM m WHERE role = 'user'""",
    "recent_messages": f"""WITH {SQL_TURNS}
SELECT session_id, turn, role FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 3""",
    "token_usage": f"""WITH {SQL_TURNS}
SELECT session_id, role AS model, sum(length(text) // 4)::BIGINT AS tokens, count(*) AS calls FROM m GROUP BY 1, 2""",
    "transcript_assembly": f"""WITH {SQL_TURNS},
seg AS (SELECT session_id, CASE WHEN role = 'system' THEN 'sys' ELSE (turn // 2)::VARCHAR END AS seg_id, turn, text FROM m),
last AS (SELECT session_id, seg_id, arg_max(text, turn) AS text FROM seg GROUP BY 1, 2)
SELECT session_id, trim(string_agg(text, '' ORDER BY CASE WHEN seg_id = 'sys' THEN 1000000000 ELSE seg_id::BIGINT END)) AS transcript
FROM last GROUP BY session_id""",
    "conversation_texts": f"WITH {SQL_TURNS} SELECT session_id, string_agg(text, chr(10) ORDER BY turn) AS full_text FROM m GROUP BY session_id",
    "message_sentences": f"WITH {SQL_SENTENCES} SELECT session_id, turn, array_to_string(complete, '¦') AS complete, rest FROM sf",
    "sentence_ids": f"""WITH {SQL_SENTENCES},
u AS (
  SELECT session_id, turn, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos
  FROM (SELECT session_id, turn, list_transform(complete, lambda x: trim(x)) || CASE WHEN trim(rest) <> '' THEN [trim(rest)] ELSE []::VARCHAR[] END AS parts
        FROM sf WHERE role = 'assistant')
)
SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn, pos) AS sentence_id, sentence FROM u""",
    "message_clauses": f"""WITH {SQL_TURNS},
c AS (SELECT session_id, turn, string_split(regexp_replace(text, '([。！？.!?；;，,])', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM m),
r AS (
  SELECT session_id, turn, parts[-1] AS tail, list_reduce(list_prepend('', parts[:len(parts) - 1]),
    lambda a, p: CASE WHEN length(regexp_extract(a, '[^\\x01]*$')) >= 6 THEN a || chr(1) || p ELSE a || p END) AS joined FROM c
),
x AS (SELECT session_id, turn, tail, string_split(joined, chr(1)) AS cl FROM r),
y AS (SELECT *, length(cl[-1]) >= 6 AS full_last FROM x)
SELECT session_id, turn, array_to_string(CASE WHEN full_last THEN cl ELSE cl[:len(cl) - 1] END, '¦') AS complete,
  CASE WHEN full_last THEN tail ELSE cl[-1] || tail END AS rest FROM y""",
    "domain_mentions": f"WITH {SQL_TURNS} SELECT session_id, turn FROM m WHERE " + " OR ".join(f"contains(text, '{c}')" for c in CUES),
    "question_types": f"""WITH {SQL_QUESTIONS},
k AS (SELECT session_id, turn, CASE WHEN regexp_matches(question, '{ro.OPTIMIZATION_KEYWORDS}') THEN 'optimization' {_CHAIN} ELSE 'factual' END AS kind
  FROM (SELECT *, replace(replace(lower(trim(label)), '"', ''), '''', '') AS l FROM q))
SELECT session_id, turn, kind, kind IN ('comparison', 'causal', 'recommendation') AS complex, kind NOT IN ('general_chat', 'optimization') AS retrieves,
  CASE WHEN kind IN ('comparison', 'causal', 'recommendation') AND turn > 0 THEN 'reason' ELSE 'generate' END AS after_graph FROM k""",
    "question_agents": f"""WITH {SQL_QUESTIONS}
SELECT session_id, turn, CASE WHEN regexp_matches(question, '{ro.PRICE_KEYWORDS}') THEN 'coal_price' WHEN regexp_matches(question, '{ro.OVEN_KEYWORDS}') THEN 'oven_control'
  WHEN regexp_matches(question, '{ro.DATA_KEYWORDS}') THEN 'data_management' WHEN regexp_matches(question, '{ro.GREETING}') THEN 'simple_chat' END AS agent FROM q""",
    "agent_plans": """
WITH p AS (
  SELECT event_id, CASE WHEN event_id % 3 = 2 THEN ['knowledge_qa'] ELSE
    CASE WHEN len(known) = 0 THEN ['knowledge_qa'] ELSE known END END AS plan
  FROM (SELECT event_id, (CASE event_type WHEN 'click' THEN ['coal_price'] WHEN 'view' THEN ['knowledge_qa'] WHEN 'purchase' THEN ['optimization']
      WHEN 'signup' THEN ['simple_chat'] ELSE []::VARCHAR[] END) || (CASE WHEN value > 50 THEN ['optimization'] ELSE []::VARCHAR[] END) AS known FROM events)
)
SELECT event_id, array_to_string(plan, ',') AS plan,
  array_to_string(list_transform(plan, lambda a: CASE a WHEN 'optimization' THEN '配煤优化' WHEN 'knowledge_qa' THEN '知识问答' WHEN 'simple_chat' THEN '闲聊' ELSE '煤价查询' END), ' → ') AS display,
  CASE plan[1] WHEN 'optimization' THEN 'optimization' WHEN 'simple_chat' THEN 'general_chat' ELSE 'factual' END AS kind,
  CASE plan[1] WHEN 'optimization' THEN 'edu_optimization' WHEN 'simple_chat' THEN 'simple_chat' ELSE 'translate' END AS route,
  CASE WHEN len(plan) < 2 THEN 'simple_chat' WHEN plan[2] = 'optimization' THEN 'edu_optimization' ELSE 'translate' END AS second_route
FROM p""",
    "parsed_metadata": """
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'T' || doc_id ELSE regexp_replace(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1], '^\\s+|\\s+$', '', 'g') END AS title,
  CASE WHEN doc_id % 3 < 2 THEN 'A, B' || doc_id ELSE '' END AS authors, '' AS abstract, 0 AS n_keywords,
  CASE WHEN doc_id % 3 < 2 AND doc_id % 2 = 0 THEN doc_id % 50 + 1970 END AS year
FROM documents""",
    "parsed_queries": f"""WITH {SQL_TURNS}
SELECT session_id, turn, CASE WHEN turn % 2 = 0 THEN 'q' || turn || '|coke' ELSE text END AS queries,
  CASE WHEN turn % 2 = 0 THEN 'CSR' ELSE '' END AS concepts, 0 AS n_methods FROM m""",
    "follow_up_blocks": """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**您可能还想了解：**' || chr(10)
  || '1. ' || event_type || '?' || chr(10) || '2. ' || user_id || '?' || chr(10) || '3. c?' END AS block FROM events""",
}
