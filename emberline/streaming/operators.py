"""Streams in, streams out; ``run_once`` drains a stream into a table for comparison with its twin.

Event time is ``ts``, later than 1970; rows more than ``LATE`` behind the newest are dropped by the watermark.  Ordered
operators give out a row once the watermark has passed it, whatever the order of arrival.  A stream that
ends is told so by a mark in a file of its own, which every ordered operator reads beside its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from emberline.operators.dialogue import IDLE_US, joined_segments, reply_text
from emberline.session import fresh_path
from emberline.streaming.processors import BargeIns, Changes, ClauseAssembly, EnergySegments, IdleTranscripts, Ordered, RecentTexts, SpeechPartials, StableText, Throttle

LATE = "10 seconds"
TURN_US, TURNS_LATE = 60_000_000, "1 hour"  # messages without a time: a minute per turn, sixty turns late at most
LANES = 1024  # keys of a stream, each for many sessions: its cost in time is per key, so their number must not grow with the sessions
END_US = 9_000_000_000_000_000  # the time of the mark, beyond all others, in the year 2255 (pandas counts nanoseconds)


def event_time(frames: DataFrame, late: str = LATE) -> DataFrame:
    return frames.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", late)


def second_diagnostics(frames: DataFrame) -> DataFrame:
    """Receive diagnostics per session and second, once the second is closed."""
    return (
        event_time(frames)
        .groupBy("session", F.window("ts", "1 second"))
        .agg(
            F.count("*").alias("frames"),
            F.sum(F.col("bad").cast("long")).alias("bad_frames"),
            F.max_by(F.struct("rms", "bytes"), F.struct("t_us", "frame_id")).alias("last"),
        )
        .select(
            "session", F.unix_seconds("window.start").alias("second"), "frames", "bad_frames",
            F.round("last.rms", 6).alias("rms"), F.col("last.bytes").alias("last_bytes"),
        )
    )


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """By lanes of sessions for an ``Ordered`` processor, else by the key itself; rows without a key have a lane of their own."""
    if isinstance(processor, Ordered):
        rows, key = rows.withColumn("lane", F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(LANES)))), "lane"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _until_the_end(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """As ``_keyed``, with the mark of the end beside the rows; ``end_stream`` writes it."""
    spark = rows.sparkSession
    marks = fresh_path(spark, "end")
    rows.sparkSession.createDataFrame([], rows.schema).write.parquet(marks)
    both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(marks))
    out = _keyed(event_time(both, late), key, processor, schema).where(F.col(key).isNotNull())
    out._end_marks = marks, rows.schema
    return out


def end_stream(stream: DataFrame) -> bool:
    """Tell a drained stream that nothing more will come; False if it does not wait for that."""
    marks, schema = getattr(stream, "_end_marks", (None, None))
    if marks is None:
        return False
    mark = [F.lit(END_US if field.name == "t_us" else None).cast(field.dataType).alias(field.name) for field in schema]
    stream.sparkSession.range(1).select(*mark).write.mode("append").parquet(marks)
    return True


def idle_transcripts(segments: DataFrame, idle_us: int = IDLE_US, late: str = LATE) -> DataFrame:
    """Transcripts of sessions that end after five seconds without a result.

    ``segments`` is (session, seg_id, t_us, frame_id, text).  Segments are put in order as in
    ``dialogue.assemble_transcripts``; empty texts prolong a session and replace nothing.
    """
    rows = event_time(segments.select("session", "t_us", "frame_id", F.col("seg_id").cast("string").alias("seg_id"), "text"), late)
    schema = "session bigint, start_us bigint, end_us bigint, pieces array<struct<seg_id: string, t_us: bigint, frame_id: bigint, text: string>>"
    ended = _keyed(rows, "session", IdleTranscripts(idle_us), schema)
    return ended.select("session", "start_us", "end_us", joined_segments(F.col("pieces"), "t_us", "frame_id").alias("transcript"))


def changed_rows(frames: DataFrame, column: str = "text", late: str = LATE, forget_us: int | None = None) -> DataFrame:
    rows = frames.select("session", "frame_id", "t_us", column)
    return _until_the_end(rows, "session", Changes(column, forget_us), f"session bigint, frame_id bigint, t_us bigint, {column} string", late)


def throttled(frames: DataFrame, late: str = LATE, **settings) -> DataFrame:
    rows = frames.select("session", "frame_id", "t_us")
    return _until_the_end(rows, "session", Throttle(**settings), "session bigint, frame_id bigint, t_us bigint", late)


def speech_partials(frames: DataFrame, late: str = LATE, **settings) -> DataFrame:
    rows = frames.select("session", "frame_id", "t_us", "rms")
    return _until_the_end(rows, "session", SpeechPartials(**settings), "session bigint, open_pos bigint, frame_id bigint, t_us bigint", late)


def energy_segments(frames: DataFrame, late: str = LATE, **settings) -> DataFrame:
    rows = frames.select("session", "frame_id", "t_us", "rms")
    return _until_the_end(rows, "session", EnergySegments(**settings), "session bigint, open_pos bigint, event string, pos bigint", late)


def stable_texts(frames: DataFrame) -> DataFrame:
    """Texts are compared without white space around them; blank ones are skipped."""
    rows = frames.select("session", "frame_id", "t_us", F.trim("text").alias("text")).where("text <> ''")
    return _keyed(event_time(rows), "session", StableText(), "session bigint, start_us bigint, trigger_us bigint, text string")


def _turn_time(messages: DataFrame) -> Column:
    return F.col("t_us") if "t_us" in messages.columns else (F.col("turn") + 1) * TURN_US


def clauses(deltas: DataFrame, late: str = TURNS_LATE) -> DataFrame:
    rows = deltas.select("session_id", _turn_time(deltas).alias("t_us"), "turn", "text", "is_last")
    return _until_the_end(rows, "session_id", ClauseAssembly(), "session_id bigint, sentence_id bigint, clause string", late)


def recent_texts(messages: DataFrame, size: int, late: str = TURNS_LATE) -> DataFrame:
    rows = messages.select("session_id", _turn_time(messages).alias("t_us"), "turn", "text")
    return _until_the_end(rows, "session_id", RecentTexts(size), "session_id bigint, turn bigint, text string, context string", late)


def barge_ins(outputs: DataFrame, speech: DataFrame, late: str = LATE) -> DataFrame:
    """Every output with the first speech that falls into it, if any.

    Both streams go by one watermark.  An output waits until it is cut or its own end has passed,
    however long it is; one without an end ends where it starts.
    """
    out = outputs.select(
        "session", F.col("start_us").alias("t_us"), F.lit(True).alias("is_output"), F.col("output_id").cast("long").alias("output_id"),
        F.coalesce("end_us", "start_us").alias("end_us"),
    )
    said = speech.select("session", "t_us", F.lit(False).alias("is_output"), F.lit(0).cast("long").alias("output_id"), F.col("t_us").alias("end_us"))
    schema = "session bigint, output_id bigint, start_us bigint, end_us bigint, cut_us bigint"
    return _until_the_end(out.unionByName(said), "session", BargeIns(), schema, late)


def turn_log(turns: DataFrame) -> DataFrame:
    """Rows for the append-only log; nothing is kept between batches."""
    return turns.select("session_id", "turn", "role", reply_text(F.col("text")).alias("text"))


def start_sink(stream: DataFrame, path: str, checkpoint: str, **trigger):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def run_once(stream: DataFrame, label: str) -> DataFrame:
    """Process everything that is available into a table in the shared folder, and read that.

    An ordered operator then learns that the stream has ended, and gives out what it still holds.
    """
    spark: SparkSession = stream.sparkSession
    path, checkpoint = fresh_path(spark, label), fresh_path(spark, f"{label}-checkpoint")
    start_sink(stream, path, checkpoint, availableNow=True).awaitTermination()
    if end_stream(stream):
        start_sink(stream, path, checkpoint, availableNow=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
