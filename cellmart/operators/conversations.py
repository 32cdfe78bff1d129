"""Stored conversations (conv_id, turn, role, text): saving, loading in order, listing, and ids by prefix; status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(stored: DataFrame, messages: DataFrame) -> DataFrame:
    """M1: the stored messages after a save: a conversation that is saved again has only its new messages."""
    return stored.join(messages.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(messages.select(*stored.columns))


def load(stored: DataFrame, conv_id) -> DataFrame:
    """M3: the messages of one conversation by turn; equal turns by role and text. An unknown id has none."""
    return stored.where(F.col("conv_id") == conv_id).orderBy("turn", "role", "text").select("turn", "role", "text")


def listing(stored: DataFrame) -> DataFrame:
    """Every conversation with its first text as title and the number of the user's messages."""
    return stored.groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"), F.count_if(F.col("role") == "user").alias("messages"))


def resolve(stored: DataFrame, prefix: str, whole: int = 36) -> str:
    """The one id that begins so; none or several are errors. Text as long as a whole id stands for itself."""
    if len(prefix) >= whole:
        return prefix
    found = stored.select(F.col("conv_id").cast("string").alias("id")).where(F.col("id").startswith(prefix)).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'several conversations begin' if found else 'no conversation begins'} with {prefix}")
    return found[0].id


def status_counts(rows: DataFrame, statuses: tuple[str, ...], column: str = "status") -> DataFrame:
    """one row: the total and the number of each status."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == s).alias(s) for s in statuses])
