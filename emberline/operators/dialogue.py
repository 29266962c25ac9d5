"""Sessions, messages, context windows and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.text import sentences, strip
from emberline.operators.sliced import SLICE_ROWS, carry, ordered_concat, positions, with_halo

# Titles, placeholders and reach of the context.
TITLE_CHARS, DEFAULT_TITLE = 10, "新对话"
EMPTY_REPLY = "（空响应或被中断）"
DOMAIN_HINT = "焦化 炼焦 焦炭 煤焦油 配煤 高炉 焦炉 干熄焦 煤化工"
CONTEXT_MESSAGES, CONTEXT_CHARS, CONTEXT_TURNS, HISTORY_MESSAGES = 8, 200, 6, 40
LAST_PLACE = 10**9
IDLE_US, SPAN_SLICE_US = 5_000_000, 60_000_000


def session_list(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Each session with the start of its first user message as title, and its last time; newest first.

    First and last are aggregates with partial sums, so a very long session costs no more than others.
    """
    facts = turns.groupBy("session_id").agg(
        F.min_by("user_message", F.when(F.col("user_message") != "", F.struct("ts_sec", "turn"))).alias("_first"),
        F.max("ts_sec").alias("last_ts"),
    )
    return (
        sessions.join(facts, "session_id", "left")
        .select(
            "session_id",
            "user_id",
            F.coalesce(F.left("_first", F.lit(TITLE_CHARS)), F.lit(DEFAULT_TITLE)).alias("title"),
            "last_ts",
        )
        .orderBy(F.desc("last_ts"), "session_id")
    )


def message_rows(turns: DataFrame) -> DataFrame:
    """One turn to at most two messages, user before bot; blank ones are left out."""
    both = F.array(
        F.struct(F.col("user_message").alias("text"), F.lit("user").alias("type")),
        F.struct(F.col("bot_response").alias("text"), F.lit("bot").alias("type")),
    )
    rows = turns.select("session_id", "turn", "ts_sec", F.posexplode(both).alias("part", "m"))
    return rows.select("session_id", "turn", "ts_sec", "part", "m.text", "m.type").where(F.length(strip(F.col("text"))) > 0)


def with_context(messages: DataFrame, back: int = CONTEXT_MESSAGES, chars: int = CONTEXT_CHARS, hint: str | None = DOMAIN_HINT) -> DataFrame:
    """Add the texts of the previous messages, cut and joined, as ``context``.

    Messages are numbered in the order of ``turn``, which may have gaps; a slice borrows the rows it looks back to.
    """
    numbered = positions(messages.withColumn("_slice", F.expr(f"turn div {SLICE_ROWS}")), ["session_id"], "_slice", ["turn"], "_nth").drop("_slice")
    sliced = with_halo(numbered, "_nth", SLICE_ROWS, back)
    window = Window.partitionBy("session_id", "slice").orderBy("_nth").rowsBetween(-back, -1)
    short = F.left(strip(F.col("text")), F.lit(chars))
    texts = F.filter(F.collect_list(short).over(window), lambda t: t != "")
    parts = texts if hint is None else F.concat(F.array(F.lit(hint)), texts)
    return sliced.withColumn("context", F.array_join(parts, " ")).where("home").drop("slice", "home", "_nth")


def recent_history(messages: DataFrame, size: int) -> DataFrame:
    """The last ``size`` messages per session.

    Turns may have gaps: messages are numbered first, slice by slice; what is kept follows by comparison with their count.
    """
    numbered = positions(messages.withColumn("_slice", F.expr(f"turn div {SLICE_ROWS}")), ["session_id"], "_slice", ["turn"], "_nth")
    last = messages.groupBy("session_id").agg(F.count("*").alias("_count"))
    return numbered.join(last, "session_id").where(F.col("_nth") >= F.col("_count") - size).drop("_count", "_nth", "_slice")


def sentence_rows(messages: DataFrame) -> DataFrame:
    """Sentences with ids 1.. per session in order of emission; the open tail comes last."""
    parts = sentences(F.col("text"))
    tail = strip(parts["rest"])
    all_parts = F.concat(
        F.transform(parts["complete"], strip), F.when(tail != "", F.array(tail)).otherwise(F.array().cast("array<string>"))
    )
    split = messages.select("session_id", "turn", F.expr(f"turn div {SLICE_ROWS}").alias("slice"), all_parts.alias("_parts"))
    counted = carry(split, ["session_id"], "slice", ["turn"], {"_through": ("sum", F.size("_parts"))})
    rows = counted.select("session_id", "turn", (F.col("_through") - F.size("_parts")).alias("_before"), F.posexplode_outer("_parts").alias("_at", "sentence")).where("_at IS NOT NULL")
    return rows.select("session_id", "turn", (F.col("_before") + F.col("_at") + 1).alias("sentence_id"), "sentence")


def segment_place(seg_id: Column) -> tuple[Column, Column, Column]:
    """Where a segment stands: numbers in their order, then those too long for a place by length and digits, then all other ids."""
    digits = F.when(seg_id.rlike(r"^\d+$"), F.ltrim(seg_id, F.lit("0")))
    place = F.when(F.length(digits) <= 9, F.coalesce(F.nullif(digits, F.lit("")).try_cast("long"), F.lit(0))).otherwise(F.lit(LAST_PLACE))
    far = place == LAST_PLACE
    return place, F.when(far, F.coalesce(F.length(digits), F.lit(1 << 30))).otherwise(0), F.when(far, F.coalesce(digits, F.lit(""))).otherwise("")


def assemble_transcripts(segments: DataFrame) -> DataFrame:
    """Latest text per segment, segments in numeric order with others last, joined per session.

    ``segments`` is (session_id, seg_id, arrival, text); empty texts do not replace earlier ones.
    """
    latest = segments.where("text <> ''").groupBy("session_id", "seg_id").agg(
        F.max_by("text", "arrival").alias("text"), F.min("arrival").alias("first_arrival")
    )
    place, length, digits = segment_place(F.col("seg_id"))
    placed = latest.withColumns({"place": place, "_length": length, "_digits": digits}).withColumn("slice", F.expr(f"place div {SLICE_ROWS}"))
    joined = ordered_concat(placed, ["session_id"], "slice", ["place", "_length", "_digits", "first_arrival"], "text", "transcript")
    return joined.withColumn("transcript", strip(F.col("transcript")))


def joined_segments(pieces: Column, *arrival: str) -> Column:
    """The texts of an array of segments, in the order of ``assemble_transcripts``; ``arrival`` names the fields of the first arrival."""

    def placed(piece: Column) -> Column:
        place, length, digits = segment_place(piece["seg_id"])
        return F.struct(place.alias("p"), length.alias("l"), digits.alias("d"), *[piece[a].alias(a) for a in arrival], piece["text"].alias("text"))

    return strip(F.array_join(F.transform(F.array_sort(F.transform(pieces, placed)), lambda x: x["text"]), ""))


def idle_transcripts(segments: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """Transcripts of spans of a session that end with a pause: (session, start_us, end_us, transcript).

    ``segments`` is (session, seg_id, t_us, frame_id, text); every row prolongs a span, also one without text.
    """
    order = ["t_us", "frame_id"]
    rows = segments.withColumn("_slice", F.expr(f"t_us div {SPAN_SLICE_US}"))
    seen = carry(rows, ["session"], "_slice", order, {"_before": ("prev", F.col("t_us"))})
    fresh = F.when(F.col("_before").isNull() | (F.col("t_us") - F.col("_before") >= idle_us), F.struct(*order))
    marked = carry(seen.withColumn("_fresh", fresh), ["session"], "_slice", order, {"_span": ("last", F.col("_fresh"))})
    named = marked.withColumn("session_id", F.struct("session", "_span")).withColumn("arrival", F.struct(*order))
    spans = named.groupBy("session_id").agg(F.min("t_us").alias("start_us"), (F.max("t_us") + idle_us).alias("end_us"))
    texts = assemble_transcripts(named.select("session_id", "seg_id", "arrival", "text"))
    return spans.join(texts, "session_id", "left").select("session_id.session", "start_us", "end_us", F.coalesce("transcript", F.lit("")).alias("transcript"))


def reply_text(reply: Column) -> Column:
    """A reply as it is logged: stripped, or a placeholder."""
    return F.coalesce(F.nullif(strip(reply), F.lit("")), F.lit(EMPTY_REPLY))


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("session_id", "model").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))


def mentions_any(text: Column, cues: list[str], limit: int = 1500) -> Column:
    """Whether the text holds one of the cues; an empty list lets everything pass."""
    if len(cues) > limit:
        raise ValueError(f"more than {limit} cues; join by token instead")
    if not cues:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(text, c))
