"""The incident projection of the test tables: orders as incidents, with places in small clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same projection as SQL that DuckDB runs.
SQL = """
SELECT CAST(o.o_orderkey AS VARCHAR) AS source_incident_id, CONCAT('src_', CAST(n.n_regionkey AS VARCHAR)) AS source_id,
  o.o_orderpriority AS subcategory,
  CASE WHEN SUBSTRING(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 'VIOLENT' WHEN SUBSTRING(o.o_orderpriority, 1, 1) = '3' THEN 'PROPERTY' ELSE 'OTHER' END AS category,
  6 - CAST(SUBSTRING(o.o_orderpriority, 1, 1) AS INT) AS severity,
  CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE o.o_orderdate END AS occurred_at,
  CAST(-120 + 2 * c.c_nationkey AS DOUBLE) + CAST((o.o_custkey * 7919) % 8 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude,
  CAST(25 + c.c_nationkey AS DOUBLE) + CAST((o.o_orderkey * 104729) % 8 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
  (o.o_orderkey % 17 <> 0) AS has_coordinates,
  CASE o.o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS arrest_made,
  c.c_mktsegment AS city, n.n_name AS state,
  LPAD(CAST(n.n_regionkey AS VARCHAR), 2, '0') AS state_fips, LPAD(CAST(n.n_nationkey AS VARCHAR), 5, '0') AS county_geoid,
  LPAD(CAST(c.c_nationkey * 10 + c.c_custkey % 10 AS VARCHAR), 7, '0') AS place_geoid,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE LPAD(CAST(c.c_custkey % 100 AS VARCHAR), 11, '0') END AS tract_geoid,
  CAST(c.c_nationkey % 5 AS VARCHAR) AS neighborhood_id
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""
EXPORTABLE_SQL = "has_coordinates AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rank = F.substring("o_orderpriority", 1, 1)
    text = lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.select(
        text("o_orderkey").alias("source_incident_id"), F.concat(F.lit("src_"), text("n_regionkey")).alias("source_id"),
        F.col("o_orderpriority").alias("subcategory"),
        F.when(rank.isin("1", "2"), "VIOLENT").when(rank == "3", "PROPERTY").otherwise("OTHER").alias("category"),
        (6 - rank.cast("int")).alias("severity"),
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("occurred_at"),
        ((-120 + 2 * F.col("c_nationkey")).cast("double") + ((F.col("o_custkey") * 7919) % 8).cast("double") / 1000).alias("longitude"),
        ((25 + F.col("c_nationkey")).cast("double") + ((F.col("o_orderkey") * 104729) % 8).cast("double") / 1000).alias("latitude"),
        (F.col("o_orderkey") % 17 != 0).alias("has_coordinates"),
        F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 0).alias("arrest_made"),
        F.col("c_mktsegment").alias("city"), F.col("n_name").alias("state"),
        F.lpad(text("n_regionkey"), 2, "0").alias("state_fips"), F.lpad(text("n_nationkey"), 5, "0").alias("county_geoid"),
        F.lpad(text(F.col("c_nationkey") * 10 + F.col("c_custkey") % 10), 7, "0").alias("place_geoid"),
        F.when(F.col("c_custkey") % 7 != 0, F.lpad(text(F.col("c_custkey") % 100), 11, "0")).alias("tract_geoid"),
        text(F.col("c_nationkey") % 5).alias("neighborhood_id"),
    )


#: Tracts, neighbourhoods (two of one name) and their links, from supplier and region.
TRACTS_SQL = """SELECT LPAD(CAST(s_suppkey % 100 AS VARCHAR), 11, '0') AS geoid, MIN(s_name) AS name,
  CASE WHEN s_suppkey % 100 % 11 = 0 THEN NULL ELSE 1000 + s_suppkey % 100 % 900 END AS population,
  CASE WHEN s_suppkey % 100 % 13 = 0 THEN NULL ELSE CAST(1 + s_suppkey % 100 % 9 AS DOUBLE) END AS land_area_sq_mi
FROM supplier GROUP BY s_suppkey % 100"""
LINKS_SQL = """SELECT DISTINCT LPAD(CAST(s_suppkey % 100 AS VARCHAR), 11, '0') AS geoid, CAST((s_suppkey % 100) % 7 AS INT) AS neighborhood_id FROM supplier WHERE (s_suppkey % 100) % 4 <> 0
UNION ALL SELECT DISTINCT LPAD(CAST(s_suppkey % 100 AS VARCHAR), 11, '0') AS geoid, 6 AS neighborhood_id FROM supplier WHERE (s_suppkey % 100) % 10 = 1 AND (s_suppkey % 100) % 7 <> 6"""
NEIGHBORHOODS_SQL = """SELECT CAST(r_regionkey AS INT) AS id, r_name AS name FROM region UNION ALL SELECT CAST(r_regionkey + 5 AS INT) AS id, r_name AS name FROM region WHERE r_regionkey < 2"""


def dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracts, links, neighbourhoods)."""
    s, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "region")
    k = F.col("s_suppkey") % 100
    geoid = F.lpad(k.cast("string"), 11, "0").alias("geoid")
    tracts = s.groupBy(k.alias("k")).agg(F.min("s_name").alias("name")).select(
        F.lpad(F.col("k").cast("string"), 11, "0").alias("geoid"), "name",
        F.when(F.col("k") % 11 != 0, 1000 + F.col("k") % 900).alias("population"),
        F.when(F.col("k") % 13 != 0, (1 + F.col("k") % 9).cast("double")).alias("land_area_sq_mi"))
    links = s.where(k % 4 != 0).select(geoid, (k % 7).cast("int").alias("neighborhood_id")).distinct()
    links = links.unionByName(s.where((k % 10 == 1) & (k % 7 != 6)).select(geoid, F.lit(6).alias("neighborhood_id")).distinct())
    names = r.select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name"))
    names = names.unionByName(r.where("r_regionkey < 2").select((F.col("r_regionkey") + 5).cast("int").alias("id"), F.col("r_name").alias("name")))
    return tracts, links, names
