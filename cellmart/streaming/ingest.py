"""Structured Streaming forms of ingestion and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmart.operators.store import Versions, upsert
from cellmart.sources.mapping import Source, normalize


def stream_pages(spark: SparkSession, path: str, per_trigger: int = 2) -> DataFrame:
    """L1: new page files as they come, a few at a time."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return raw.select(F.try_parse_json("value").alias("page"), F.col("_metadata.file_modification_time").alias("seen"), F.col("_metadata.file_path").alias("file")).where("page is not null")


def upsert_stream(pages: DataFrame, source: Source, store: Versions, checkpoint: str, path: str = "$"):
    """L2, L3: each batch of pages is normalised and upserted, in order of the files' times and names and of the records in them.
    A batch that repeats changes nothing, so no watermark has to drop late rows."""

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch.select("seen", "file", F.posexplode(F.try_variant_get("page", path, "array<variant>")).alias("place", "record"))
        new = normalize(rows.withColumn("seq", F.struct("seen", "file", "place")), source, keep=("seq",))
        old = store.read()
        store.write(upsert(old, new, "source_incident_id", "seq") if old is not None else upsert(new.drop("seq").limit(0), new, "source_incident_id", "seq"))

    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """The streaming form of F4: tumbling windows by type, with a watermark for late events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("cnt")).select(F.col("window.start").alias("start"), "event_type", "cnt")
