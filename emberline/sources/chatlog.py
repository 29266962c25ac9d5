"""Append-only chat log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.dialogue import reply_text


def log_rows(turns: DataFrame) -> DataFrame:
    """Turns as they are stored: an empty reply becomes a placeholder."""
    return turns.select("session_id", "turn", "ts_sec", "user_message", reply_text(F.col("bot_response")).alias("bot_response"))


def append_turns(turns: DataFrame, path: str) -> None:
    log_rows(turns).write.mode("append").parquet(path)
