"""Parquet stores without transactions: a new version folder for each write, and a pointer to the one that counts."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmart.model import ATTRIBUTION


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the last row in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order]))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert(old: DataFrame, batch: DataFrame, key: str, order: str, keep: Iterable[str] = ATTRIBUTION) -> DataFrame:
    """B1, S3: the batch's last row per key replaces the old one, but for the attribution columns, which stay as they were."""
    new = keep_last(batch, [key], [F.col(order)]).drop(order)
    stay = [c for c in keep if c in old.columns]
    before = old.select(key, F.lit(True).alias("_had"), *[F.col(c).alias(f"_{c}") for c in stay])
    new = new.join(before, key, "left").select(*[F.when(F.col("_had"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in stay else c for c in old.columns])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_by_key(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union; rows of later parts replace those of earlier ones."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return keep_last(out, keys, [F.col("_part")]).drop("_part")


def update_coordinates(incidents: DataFrame, found: DataFrame, clear_attribution: bool = False) -> DataFrame:
    """Coordinates by id from found (source_incident_id, longitude, latitude)."""
    new = found.select("source_incident_id", F.col("longitude").alias("_x"), F.col("latitude").alias("_y"))
    out = incidents.join(new, "source_incident_id", "left")
    hit = F.col("_x").isNotNull()
    changed = {"longitude": F.coalesce("_x", "longitude"), "latitude": F.coalesce("_y", "latitude"), "has_coordinates": hit | F.col("has_coordinates"), "geocoded": hit | F.col("geocoded")}
    if clear_attribution:
        changed |= {c: F.when(~hit, F.col(c)) for c in ATTRIBUTION if c != "enriched"} | {"enriched": ~hit & F.col("enriched")}
    return out.withColumns({k: v for k, v in changed.items() if k in incidents.columns}).select(*incidents.columns)


def mark_geocoded(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """B4."""
    seen = ids.select("source_incident_id", F.lit(True).alias("_seen")).distinct()
    return incidents.join(seen, "source_incident_id", "left").withColumn("geocoded", F.coalesce("_seen", "geocoded")).select(*incidents.columns)


def update_attribution(incidents: DataFrame, attribution: DataFrame) -> DataFrame:
    """Attribution by id; rows that it names are enriched."""
    own = [c for c in attribution.columns if c != "source_incident_id"]
    new = attribution.select("source_incident_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in own])
    out = incidents.join(new, "source_incident_id", "left")
    changed = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in own} | {"enriched": F.coalesce("_hit", "enriched")}
    return out.withColumns(changed).select(*incidents.columns)


class Unenriched(ValueError):
    pass


def unenriched(incidents: DataFrame) -> DataFrame:
    """Sources with exportable rows not yet attributed, and how many."""
    return incidents.where("has_coordinates and not enriched").groupBy("source_id").agg(F.count(F.lit(1)).alias("cnt"))


def require_enriched(incidents: DataFrame) -> DataFrame:
    """An error that lists all those sources; the registry bounds their number."""
    left = unenriched(incidents).orderBy("source_id").collect()
    if left:
        raise Unenriched(", ".join(f"{r.source_id}: {r.cnt}" for r in left))
    return incidents


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in spark.checkpoint.dir, deleted when the driver ends; where that is unset, a temporary one if all runs in one place."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = f"{(top or 'file://' + tempfile.gettempdir()).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


class Versions:
    """A table as version folders and a pointer file; readers see whole versions only. Paths may be in any store Spark writes."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def current(self) -> dict | None:
        fs, p = self._fs(f"{self.at}/current.json")
        if not fs.exists(p):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.at}/current.json").collect()))

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.option("mergeSchema", "true").parquet(now["path"]) if now else None

    def write(self, df: DataFrame, partition_by: list[str] | None = None, **meta) -> dict:
        """B2: writes a version, then points to it. meta is kept with the pointer."""
        path = f"{self.at}/v-{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        now = {"path": path, **meta}
        fs, p = self._fs(f"{self.at}/current.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        return now

    def stale(self, fingerprint: dict) -> bool:
        """Whether what stands was made from something else."""
        now = self.current()
        return not now or now.get("fingerprint") != fingerprint


def fingerprints(incidents: DataFrame) -> dict:
    """Per source the number of rows and the last date."""
    rows = incidents.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("occurred_at").cast("string").alias("last")).collect()  # a row a source
    return {r.source_id: [r.n, r["last"]] for r in rows}


def watermark(incidents: DataFrame, fully_synced: bool, days: int = 7) -> DataFrame:
    """One row: the date from which to fetch again, null for everything."""
    since = F.max("occurred_at") - F.expr(f"interval {days} days")
    return incidents.agg((since if fully_synced else F.lit(None).cast("timestamp_ntz")).alias("since"))


def geojson_lines(incidents: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, for write.text."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    return incidents.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def boundary_lines(boundaries: DataFrame, properties: list[str]) -> DataFrame:
    """B7."""
    head = F.to_json(F.struct(*properties))
    return boundaries.where("boundary_geojson is not null").select(F.concat(F.lit('{"type":"Feature","geometry":'), "boundary_geojson", F.lit(',"properties":'), head, F.lit("}")).alias("value"))


def tiles(incidents: DataFrame, zoom: int) -> DataFrame:
    """Counts by web-mercator tile."""
    n = float(1 << zoom)
    lat = F.radians("latitude")
    y = (1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / 3.141592653589793) / 2 * n
    return incidents.groupBy(F.floor((F.col("longitude") + 180) / 360 * n).cast("int").alias("x"), F.floor(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("cnt"))
