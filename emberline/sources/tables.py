"""Table access and the adapters that give the given tables the shape of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, spread over the cores when they come in few splits: text work is heavy."""
    return spread(table(spark, folder, "documents"))


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """The same table as a file stream; the table may be one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    if status.isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


# --- blend side -----------------------------------------------------------------------------


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Component table: one row per part, assay values from its sales; unsold parts have nulls."""
    sold = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(
            (F.avg("l_discount") * 100).alias("mad"),
            (F.avg("l_tax") * 200 + 5).alias("ad"),
            F.avg("l_quantity").alias("vdaf"),
            (F.avg("l_extendedprice") / 10000).alias("std"),
            (F.avg("l_linenumber") * 5).alias("x"),
            (F.avg("l_quantity") / 2).alias("y"),
        )
    )
    part = table(spark, folder, "part")
    return part.join(sold, part.p_partkey == sold.l_partkey, "left").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_type").alias("type"),
        F.col("p_retailprice").alias("price"),
        "mad",
        "ad",
        "vdaf",
        "std",
        F.when(F.col("l_partkey").isNotNull(), F.col("p_size") * 2.0).alias("g"),
        "x",
        "y",
        (F.col("mad") + 20).alias("cri"),
        (F.col("ad") * 2 + 40).alias("csr"),
        (F.col("x") / 2).alias("m10"),
        (F.col("ad") + 75).alias("m25"),
        (F.col("mad") + 70).alias("m40"),
    )


def blends(spark: SparkSession, folder: str) -> DataFrame:
    """Blend requests in long form: an order is a blend, its parts are the components."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("blend_id"), F.col("l_partkey").alias("component"))
        .agg(F.sum("l_quantity").alias("pct"))
    )


# --- corpus side ----------------------------------------------------------------------------


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers made from documents: headings, blank lines and page breaks set at fixed words."""
    docs = documents(spark, folder)
    text = F.col("text")
    for word, put in (
        ("\nThe ", "\nResults and Discussion\nThe "),
        ("\nTo ", "\n2. Methods\nTo "),
        ("\nDe ", "\nIntroduction\nDe "),
        ("\nDer ", "\nConclusions\nDer "),
        ("\nIn ", "\n\nIn "),
    ):
        text = F.replace(text, F.lit(word), F.lit(put))
    return docs.select(
        F.col("doc_id").alias("paper_id"),
        F.concat(
            F.lit("\\corpus\\Coal blend paper\\"),
            F.col("source"),
            F.lit("\\"),
            F.col("doc_id").cast("string"),
            F.lit(".pdf"),
        ).alias("raw_path"),
        F.split(text, "\nIt ", -1).alias("pages"),
        "source",
        "lang",
    )


# --- retrieval side -------------------------------------------------------------------------


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk vectors: five chunks per paper, three sections, the label is the category."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id"),
        F.expr("vec_id div 5").alias("paper_id"),
        (F.col("vec_id") % 5).alias("chunk_index"),
        F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("section"),
        F.col("label").cast("long").alias("category"),
        F.col("embedding").alias("vec"),
    )


def question_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Two query vectors per question, both taken from the whole table.

    A question stands for a label: query 0 is the mean vector of the label, query 1 its earliest
    vector.  The mean is built per dimension, with map-side partial sums.
    """
    vectors = table(spark, folder, "embeddings")
    mean = (
        vectors.select(F.col("label").cast("long").alias("question_id"), F.posexplode("embedding").alias("dim", "x"))
        .groupBy("question_id", "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("question_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))
        .select("question_id", F.lit(0).cast("long").alias("query_pos"), "vec")
    )
    first = (
        vectors.groupBy(F.col("label").cast("long").alias("question_id"))
        .agg(F.min_by(F.col("embedding").cast("array<double>"), "vec_id").alias("vec"))
        .select("question_id", F.lit(1).cast("long").alias("query_pos"), "vec")
    )
    return mean.unionByName(first)


# --- dialogue side --------------------------------------------------------------------------


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text"
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Chat log rows: a user message with the reply that follows it.

    Messages are numbered without gaps, so the reply is found by an equi-join on
    (session, turn + 1), whose keys are unique: a session that holds a third of the log is
    spread over all partitions, which a window per session would not do.
    """
    rows = messages(spark, folder)
    asked = rows.where(F.col("role") == "user").select(
        "session_id", "turn", (F.col("turn") + 1).alias("reply_turn"), F.col("text").alias("user_message")
    )
    replied = rows.where(F.col("role") == "assistant").select(
        "session_id", F.col("turn").alias("reply_turn"), F.col("text").alias("bot_response")
    )
    return asked.join(replied, ["session_id", "reply_turn"], "left").select(
        "session_id",
        (F.col("session_id") % 10).alias("user_id"),
        "turn",
        (F.lit(1704067200) + F.col("turn") * 60 + F.col("session_id")).alias("ts_sec"),
        "user_message",
        F.coalesce("bot_response", F.lit("")).alias("bot_response"),
    )


# --- speech side ----------------------------------------------------------------------------

#: Event times are hours apart; dividing them by this makes them fractions of a second.
TIME_SQUEEZE = 100_000


def frames(events: DataFrame) -> DataFrame:
    """Voice frames from events: the user is the session, order is (t_us, frame_id)."""
    return events.select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("frame_id"),
        F.expr(f"unix_micros(cast(ts AS timestamp)) div {TIME_SQUEEZE}").alias("t_us"),
        (F.col("value") / 10000).alias("rms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("event_type").alias("text"),
        F.col("value"),
    )
