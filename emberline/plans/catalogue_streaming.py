"""Named streaming queries: drained streams, checked against the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import speech as sp
from emberline.plans import catalogue_speech as cs
from emberline.plans.catalogue_dialogue import SQL_TURNS
from emberline.sources.tables import frames, stream_table
from emberline.streaming import operators as st


def _frames(spark, d):
    return frames(stream_table(spark, d, "events"))


def _messages(spark, d):
    return stream_table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")


def stream_diagnostics(spark, d):
    rows = _frames(spark, d).withColumn("bytes", F.when(F.col("k") < 3, F.col("k") * 700 + 1).otherwise(F.lit(1024)))
    rows = rows.withColumn("bad", sp.frame_checks(F.col("bytes"), 320, 1300)["simple_bad"])
    return st.run_once(st.second_diagnostics(rows), "diagnostics")


def stream_idle_transcripts(spark, d):
    # twenty times slower than the other queries, so that sessions do fall silent
    slow = _frames(spark, d).withColumn("t_us", F.col("t_us") * 20)
    rows = slow.withColumn("seg_id", F.when(F.col("k") % 5 == 0, F.lit("x")).otherwise((F.col("k") % 5).cast("string")))
    return st.run_once(st.idle_transcripts(rows), "idle")


def stream_segments(spark, d):
    return st.run_once(st.energy_segments(_frames(spark, d), loud_above=0.005, loud_frames=2, quiet_frames=4), "segments")


def stream_changes(spark, d):
    return st.run_once(st.changed_rows(_frames(spark, d)), "changes")


def stream_stable_texts(spark, d):
    return st.run_once(st.stable_texts(_frames(spark, d)), "stable")


def stream_throttle(spark, d):
    return st.run_once(st.throttled(_frames(spark, d)), "throttle")


def stream_clauses(spark, d):
    """Assistant texts as deltas; the reply of a turn ends with the turn."""
    rows = _messages(spark, d).where("role = 'assistant'").withColumn("is_last", F.lit(True))
    return st.run_once(st.clauses(rows), "clauses")


def stream_history(spark, d):
    return st.run_once(st.recent_texts(_messages(spark, d), 6), "history").select("session_id", "turn", "context")


def stream_partials(spark, d):
    return st.run_once(st.speech_partials(_frames(spark, d), after_ms=96, **cs.SENSITIVE), "partials")


def stream_states(spark, d):
    rows = _frames(spark, d).withColumn("state", cs.dialogue_state())
    return st.run_once(st.changed_rows(rows, "state"), "states").select("session", "frame_id", "state")


def stream_barge_ins(spark, d):
    rows = _frames(spark, d)
    outputs = rows.where("text = 'purchase'").select(
        "session", F.col("frame_id").alias("output_id"), F.col("t_us").alias("start_us"), (F.col("t_us") + F.col("k") * 20000).alias("end_us")
    )
    speech = _frames(spark, d).where("text = 'click'")
    return st.run_once(st.barge_ins(outputs, speech), "barge")


def stream_turn_log(spark, d):
    return st.run_once(st.turn_log(_messages(spark, d)), "turns")


QUERIES = {
    f.__name__: f
    for f in (
        stream_diagnostics, stream_idle_transcripts, stream_segments, stream_changes, stream_stable_texts, stream_throttle, stream_partials,
        stream_clauses, stream_history, stream_states, stream_barge_ins, stream_turn_log,
    )
}

ORACLES = {
    "stream_diagnostics": cs.ORACLES["second_diagnostics"].replace(
        "FROM b GROUP BY ALL", "FROM b WHERE (t_us // 1000000 + 1) * 1000000 <= (SELECT max(t_us) - 10000000 FROM f) // 1000 * 1000 GROUP BY ALL"
    ),
    "stream_idle_transcripts": f"""WITH {cs.SQL_FRAMES},
slow AS (SELECT * REPLACE (t_us * 20 AS t_us) FROM f),
g AS (SELECT *, CASE WHEN k % 5 = 0 THEN 1000000000 ELSE k % 5 END AS place, CASE WHEN t_us - lag(t_us) OVER w < 5000000 THEN 0 ELSE 1 END AS fresh FROM slow WINDOW w AS (PARTITION BY session ORDER BY t_us, frame_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY t_us, frame_id) AS island FROM g),
l AS (SELECT session, island, place, arg_max(text, (t_us, frame_id)) AS text FROM i GROUP BY ALL),
e AS (SELECT session, island, min(t_us) AS start_us, max(t_us) + 5000000 AS end_us FROM i GROUP BY ALL)
SELECT session, start_us, end_us, string_agg(text, '' ORDER BY place) AS transcript FROM e JOIN l USING (session, island)
WHERE end_us <= (SELECT max(t_us) - 10000000 FROM slow) // 1000 * 1000 GROUP BY session, island, start_us, end_us""",
    "stream_segments": f"""WITH {cs._machine('0.005', 2, 4)}
SELECT session, open_pos, 'speech_start' AS event, open_pos AS pos FROM seg UNION ALL SELECT session, open_pos, 'speech_end', close_pos FROM seg WHERE close_pos IS NOT NULL""",
    "stream_changes": cs.ORACLES["text_changes"],
    "stream_stable_texts": f"""WITH {cs.SQL_FRAMES},
rn AS (SELECT session, t_us, text, lead(t_us) OVER w AS next_us, max(t_us) OVER (PARTITION BY session) AS last_start FROM ch WINDOW w AS (PARTITION BY session ORDER BY t_us, frame_id)),
seen AS (SELECT session, max(t_us) AS last_us FROM f GROUP BY session)
SELECT session, t_us AS start_us, t_us + 550000 AS trigger_us, text FROM rn JOIN seen USING (session)
WHERE coalesce(next_us, last_us) - t_us >= 550000 OR (next_us IS NULL AND (t_us + 550000) // 1000 + 1 <= (SELECT max(t_us) - 10000000 FROM f) // 1000)""",
    "stream_partials": f"WITH {cs.SQL_PARTIALS} SELECT session, open_pos, frame_id, t_us FROM part",
    "stream_throttle": cs.ORACLES["throttled_frames"],
    "stream_clauses": f"""WITH {SQL_TURNS},
c AS (SELECT session_id, turn, string_split(regexp_replace(text, '([。！？.!?；;，,])', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM m WHERE role = 'assistant'),
r AS (
  SELECT session_id, turn, parts[-1] AS tail, list_reduce(list_prepend('', parts[:len(parts) - 1]),
    lambda a, p: CASE WHEN length(regexp_extract(a, '[^\\x01]*$')) >= 6 THEN a || chr(1) || p ELSE a || p END) AS joined FROM c
),
x AS (SELECT session_id, turn, tail, string_split(joined, chr(1)) AS cl FROM r),
y AS (SELECT session_id, turn, CASE WHEN length(cl[-1]) >= 6 THEN cl || [tail] ELSE cl[:len(cl) - 1] || [cl[-1] || tail] END AS cl FROM x),
u AS (SELECT session_id, turn, unnest(cl) AS piece, generate_subscripts(cl, 1) AS pos FROM y)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn, pos) AS sentence_id, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS clause FROM u
WHERE regexp_replace(piece, '^\\s+|\\s+$', '', 'g') <> ''""",
    "stream_history": f"""WITH {SQL_TURNS}
SELECT session_id, turn, coalesce(string_agg(trim(text), ' ') OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS context FROM m""",
    "stream_states": cs.ORACLES["state_changes"],
    "stream_barge_ins": cs.ORACLES["barge_ins"],
    "stream_turn_log": """SELECT conv_id AS session_id, turn, role, trim(text) AS text FROM conversations""",
}
