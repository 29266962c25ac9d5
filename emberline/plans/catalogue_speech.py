"""Named speech queries (batch) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import speech as sp
from emberline.sources.tables import TIME_SQUEEZE, frames, table


def _frames(spark, d):
    return frames(table(spark, d, "events"))


def _sized(spark, d):
    """Frames with a byte size made from the event value; three in a hundred sizes are bad."""
    rows = _frames(spark, d).withColumn("bytes", F.when(F.col("k") < 3, F.col("k") * 700 + 1).otherwise(F.lit(1024)))
    return rows.withColumn("bad", sp.frame_checks(F.col("bytes"), 320, 1300)["simple_bad"])


def frame_validity(spark, d):
    size = F.floor(F.col("value") * 10).cast("long")
    checks = sp.frame_checks(size, 320, 1300)
    return _frames(spark, d).select("frame_id", size.alias("bytes"), *[c.alias(n) for n, c in checks.items()])


def frame_mismatch(spark, d):
    return sp.mismatch_ratio(_sized(spark, d), "session")


def second_diagnostics(spark, d):
    return sp.second_diagnostics(_sized(spark, d))


def profile_warnings(spark, d):
    """Client profiles made from events."""
    k = F.col("k")
    profile = F.when(
        k % 10 > 0,
        F.struct(
            F.when(k % 4 == 0, F.lit(" Opus ")).when(k % 4 == 1, F.lit("PCM_S16LE")).alias("encoding"),
            F.when(k % 3 == 0, F.lit(44100)).otherwise(F.lit(0)).alias("sample_rate"),
            F.lit(16000).alias("sample_rate_hz"),
            (k % 3).cast("int").alias("channels"),
            F.when(k % 5 == 0, F.lit(8)).otherwise(F.lit(16)).alias("bits_per_sample"),
            k.cast("int").alias("frame_ms"),
        ),
    )
    warnings = sp.profile_warnings(profile)
    return _frames(spark, d).select("frame_id", F.array_join(warnings, ";").alias("warnings"), (F.size(warnings) == 0).alias("ok"))


def text_changes(spark, d):
    return sp.changes(_frames(spark, d)).select("session", "frame_id", "t_us", "text")


def dialogue_state():
    """Dialogue states for the event names of the tables."""
    said = F.col("text")
    return F.when(said == "click", "listening").when(said == "view", "thinking").when(said.isin("purchase", "signup"), "speaking").otherwise("idle")


def state_changes(spark, d):
    return sp.state_changes(_frames(spark, d), dialogue_state()).select("session", "frame_id", "state")


def stable_partials(spark, d):
    return sp.stable_triggers(_frames(spark, d))


def throttled_frames(spark, d):
    return sp.throttled(_frames(spark, d).select("session", "frame_id", "t_us")).select("session", "frame_id", "t_us")


#: Frames of the tables lie up to a second apart: a sensitive detector gives segments that are long enough for several partials.
SENSITIVE = {"loud_above": 0.005, "loud_frames": 2, "quiet_frames": 4}


def speech_partials(spark, d):
    return sp.speech_partials(_frames(spark, d), after_ms=96, **SENSITIVE).select("session", "open_pos", "frame_id", "t_us")


def trailing_window(spark, d):
    rows = sp.trailing(_frames(spark, d))
    return rows.select("session", "frame_id", "trailing_frames", F.round(F.col("trailing_rms") + 1e-9, 6).alias("trailing_rms"))


def _segments(spark, d):
    return sp.energy_segments(_frames(spark, d))


def speech_segments(spark, d):
    return sp.segment_frames(_segments(spark, d))


def speech_segments_sensitive(spark, d):
    """Another setting of the detector: lower level, two loud frames, four quiet ones."""
    return sp.segment_frames(sp.energy_segments(_frames(spark, d), 0.005, 2, 4))


def preroll_frames(spark, d):
    starts = _segments(spark, d).select("session", F.col("open_pos").alias("start_pos"))
    return sp.preroll(_frames(spark, d), starts)


def running_speech(spark, d):
    return sp.running_speech_ms(_frames(spark, d)).select("session", "frame_id", F.col("speech_ms").cast("long").alias("speech_ms"))


def speculation_check(spark, d):
    """Per ten-second segment, whether the first text seen is also the last."""
    rows = _frames(spark, d).withColumn("segment", F.expr("t_us div 10000000"))
    seen = rows.groupBy("session", "segment").agg(
        F.min_by("text", F.struct("t_us", "frame_id")).alias("early"), F.max_by("text", F.struct("t_us", "frame_id")).alias("text"), F.count("*").alias("n")
    )
    return sp.speculation_hits(seen.where("n > 2").select("session", "segment", F.col("early").alias("text")), seen.select("session", "segment", "text"))


def _outputs(spark, d):
    rows = _frames(spark, d).where("text = 'purchase'")
    return rows.select("session", F.col("frame_id").alias("output_id"), F.col("t_us").alias("start_us"), (F.col("t_us") + F.col("k") * 20000).alias("end_us"))


def barge_ins(spark, d):
    return sp.barge_ins(_outputs(spark, d), _frames(spark, d).where("text = 'click'"))


def model_families(spark, d):
    """Families of model names, in the order in which they are first seen."""
    name = F.concat_ws("_", "text", (F.col("k") % 3).cast("string"))
    return _frames(spark, d).groupBy(F.split(name, "_")[0].alias("family")).agg(F.min("frame_id").alias("first_seen")).orderBy("first_seen")


QUERIES = {
    f.__name__: f
    for f in (
        frame_validity, frame_mismatch, second_diagnostics, profile_warnings, text_changes, state_changes, stable_partials,
        throttled_frames, speech_partials, trailing_window, speech_segments, speech_segments_sensitive, preroll_frames, running_speech, speculation_check, barge_ins,
        model_families,
    )
}

SQL_FRAMES = f"""
f AS (
  SELECT user_id AS session, event_id AS frame_id, epoch_us(ts) // {TIME_SQUEEZE} AS t_us, value / 10000 AS rms, value,
    (props->>'$.k')::BIGINT AS k, event_type AS text FROM events
),
b AS (SELECT *, bytes < 2 OR bytes % 2 = 1 OR bytes < 320 OR bytes > 1300 AS bad FROM (SELECT *, CASE WHEN k < 3 THEN k * 700 + 1 ELSE 1024 END AS bytes FROM f)),
st AS (SELECT *, CASE text WHEN 'click' THEN 'listening' WHEN 'view' THEN 'thinking' WHEN 'error' THEN 'idle' ELSE 'speaking' END AS state FROM f),
ch AS (SELECT * FROM f QUALIFY lag(text) OVER (PARTITION BY session ORDER BY t_us, frame_id) IS DISTINCT FROM text)"""
SQL_STABLE = SQL_FRAMES + """,
rn AS (
  SELECT session, t_us, text, coalesce(lead(t_us) OVER w, (SELECT max(t_us) FROM f WHERE f.session = ch.session)) AS until
  FROM ch WINDOW w AS (PARTITION BY session ORDER BY t_us, frame_id)
),
stable AS (SELECT session, t_us AS start_us, t_us + 550000 AS trigger_us, text FROM rn WHERE until - t_us >= 550000)"""


def _machine(above: str, loud: int, quiet: int) -> str:
    """The segment rule as a counter per frame."""
    return SQL_FRAMES + f""",
pos AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_us, frame_id) - 1 AS pos, rms > {above} AS loud FROM f),
machine AS (
  WITH RECURSIVE m AS (
    SELECT session, -1::BIGINT AS pos, false AS speaking, 0::BIGINT AS sc, 0::BIGINT AS quiet, NULL::BIGINT AS opened, NULL::BIGINT AS closed FROM (SELECT DISTINCT session FROM f)
    UNION ALL
    SELECT m.session, p.pos,
      CASE WHEN loud THEN speaking OR sc >= {loud - 1} WHEN speaking THEN quiet < {quiet - 1} ELSE false END,
      CASE WHEN loud THEN sc + 1 WHEN speaking AND quiet < {quiet - 1} THEN sc ELSE 0 END,
      CASE WHEN loud THEN 0 WHEN speaking AND quiet < {quiet - 1} THEN quiet + 1 ELSE 0 END,
      CASE WHEN loud AND NOT speaking AND sc >= {loud - 1} THEN p.pos WHEN closed IS NOT NULL THEN NULL ELSE opened END,
      CASE WHEN NOT loud AND speaking AND quiet >= {quiet - 1} THEN p.pos END
    FROM m JOIN pos p ON p.session = m.session AND p.pos = m.pos + 1
  )
  SELECT * FROM m
),
lastp AS (SELECT session, max(pos) AS last_pos FROM pos GROUP BY session),
seg AS (
  SELECT session, opened AS open_pos, max(closed) AS close_pos, coalesce(max(closed), any_value(last_pos)) AS end_pos
  FROM machine JOIN lastp USING (session) WHERE opened IS NOT NULL GROUP BY session, opened
)"""


SQL_MACHINE = _machine("0.012", 3, 38)
_SEGMENTS = """SELECT session, open_pos, close_pos, end_pos, (end_pos - open_pos + 1) * 32 AS speech_ms, (end_pos - open_pos + 1) * 32 >= 250 AS kept, true AS kept_if_forced,
  (end_pos - open_pos + 1) * 512 > 4800 AS fallback_ok FROM seg"""
SQL_THROTTLE = SQL_FRAMES + """,
thr AS (
  WITH RECURSIVE w AS (
    SELECT session, min(t_us) AS t_us FROM f GROUP BY session
    UNION ALL
    SELECT w.session, (SELECT min(f.t_us) FROM f WHERE f.session = w.session AND f.t_us >= w.t_us + 700000) FROM w WHERE w.t_us IS NOT NULL
  )
  SELECT w.session, min(frame_id) AS frame_id, t_us FROM w JOIN f USING (session, t_us) GROUP BY w.session, t_us
)"""

SQL_PARTIALS = _machine("0.005", 2, 4) + """,
due AS (
  SELECT s.session, s.open_pos, p.frame_id, p.t_us FROM seg s JOIN pos p ON p.session = s.session
  WHERE p.pos >= s.open_pos + 2 AND (s.close_pos IS NULL OR p.pos < s.close_pos)
),
part AS (
  WITH RECURSIVE w AS (
    SELECT session, open_pos, min(t_us) AS t_us FROM due GROUP BY session, open_pos
    UNION ALL
    SELECT w.session, w.open_pos, (SELECT min(d.t_us) FROM due d WHERE d.session = w.session AND d.open_pos = w.open_pos AND d.t_us >= w.t_us + 700000) FROM w WHERE w.t_us IS NOT NULL
  )
  SELECT w.session, w.open_pos, min(frame_id) AS frame_id, t_us FROM w JOIN due USING (session, open_pos, t_us) GROUP BY ALL
)"""

ORACLES = {
    "frame_validity": f"""WITH {SQL_FRAMES}, z AS (SELECT frame_id, floor(value * 10)::BIGINT AS bytes FROM f)
SELECT frame_id, bytes, bytes = 1024 AS agent_ok, bytes >= 2 AND bytes % 2 = 0 AS duplex_ok, bytes < 2 OR bytes % 2 = 1 OR bytes < 320 OR bytes > 1300 AS simple_bad,
  bytes >= 2 AND bytes % 2 = 0 AS simple_used FROM z""",
    "frame_mismatch": f"""WITH {SQL_FRAMES}
SELECT session, count(*) AS frames, count(*) FILTER (bad) AS bad_frames, round(count(*) FILTER (bad) / count(*)::DOUBLE, 4) AS mismatch_ratio FROM b GROUP BY session""",
    "second_diagnostics": f"""WITH {SQL_FRAMES}
SELECT session, t_us // 1000000 AS second, count(*) AS frames, count(*) FILTER (bad) AS bad_frames, round(arg_max(rms, (t_us, frame_id)), 6) AS rms, arg_max(bytes, (t_us, frame_id)) AS last_bytes
FROM b GROUP BY ALL""",
    "profile_warnings": f"""WITH {SQL_FRAMES},
w AS (SELECT frame_id, CASE WHEN k % 10 = 0 THEN 'missing_client_audio_profile' ELSE concat_ws(';', CASE WHEN k % 4 = 0 THEN 'encoding_not_pcm' END,
  CASE WHEN k % 3 = 0 THEN 'sample_rate_mismatch:44100!=16000' END, CASE WHEN k % 3 = 2 THEN 'channels_mismatch:2!=1' END,
  CASE WHEN k % 5 = 0 THEN 'bits_per_sample_mismatch:8!=16' END, CASE WHEN k <> 0 AND abs(k - 32) > 20 THEN 'frame_ms_far_from_recommend:' || k || '!~32' END) END AS warnings FROM f)
SELECT frame_id, warnings, warnings = '' AS ok FROM w""",
    "text_changes": f"WITH {SQL_FRAMES} SELECT session, frame_id, t_us, text FROM ch",
    "state_changes": f"""WITH {SQL_FRAMES}
SELECT session, frame_id, state FROM st QUALIFY lag(state) OVER (PARTITION BY session ORDER BY t_us, frame_id) IS DISTINCT FROM state""",
    "stable_partials": f"WITH {SQL_STABLE} SELECT session, start_us, trigger_us, text FROM stable",
    "throttled_frames": f"WITH {SQL_THROTTLE} SELECT session, frame_id, t_us FROM thr",
    "speech_partials": f"WITH {SQL_PARTIALS} SELECT session, open_pos, frame_id, t_us FROM part",
    "trailing_window": f"""WITH {SQL_FRAMES}
SELECT session, frame_id, count(*) OVER w AS trailing_frames, round(avg(rms) OVER w + 1e-9, 6) AS trailing_rms
FROM f WINDOW w AS (PARTITION BY session ORDER BY t_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW)""",
    "speech_segments": f"WITH {SQL_MACHINE} {_SEGMENTS}",
    "speech_segments_sensitive": f"WITH {_machine('0.005', 2, 4)} {_SEGMENTS}",
    "preroll_frames": f"""WITH {SQL_MACHINE}
SELECT s.session, open_pos AS start_pos, p.pos, p.frame_id FROM seg s JOIN pos p ON p.session = s.session AND p.pos BETWEEN open_pos - 15 AND open_pos - 1""",
    "running_speech": f"""WITH {SQL_FRAMES}
SELECT session, frame_id, (32 * count(*) FILTER (rms > 0.012) OVER (PARTITION BY session ORDER BY t_us, frame_id))::BIGINT AS speech_ms FROM f""",
    "speculation_check": f"""WITH {SQL_FRAMES},
s AS (SELECT session, t_us // 10000000 AS segment, arg_min(text, (t_us, frame_id)) AS early, arg_max(text, (t_us, frame_id)) AS text, count(*) AS n FROM f GROUP BY ALL)
SELECT session, segment, n > 2 AS triggered, n > 2 AND early = text AS kept FROM s""",
    "barge_ins": f"""WITH {SQL_FRAMES},
o AS (SELECT session, frame_id AS output_id, t_us AS start_us, t_us + k * 20000 AS end_us FROM f WHERE text = 'purchase')
SELECT session, output_id, start_us, end_us, (SELECT min(t_us) FROM f WHERE f.session = o.session AND text = 'click' AND t_us >= start_us AND t_us < end_us) AS cut_us FROM o""",
    "model_families": f"WITH {SQL_FRAMES} SELECT text AS family, min(frame_id) AS first_seen FROM f GROUP BY text",
}
