"""Line deduplication across documents (DataFrame functions only).

Lines are exploded with a 128-bit hash of their normalised key; documents are counted per hash in two steps with map-side
combines, so a line that stands in a third of all documents is never gathered in one task. The text itself is shuffled once,
to meet the positions that its document loses, and is put together again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmart.llm.common import ASCII_SPACE, hash128, text_or_empty, written

MIN_CHARS = 20
MIN_DOCS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, text (what is left), n_lines (before), n_dropped.

    docs needs doc_id and text; other columns are ignored. A null or empty text is one empty line. Keys of at least min_chars
    code points that at least min_docs different doc_ids hold lose all their lines except those in the largest doc_id.
    Rows with a null doc_id count together as one document, the smallest. Repeated rows are treated alike. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text")).select("doc_id", "text", *[h.alias(f"r{i}") for i, h in enumerate(hash128(F.col("text"), 5))], F.split("text", "\n").alias("lines"))
    keys = F.transform("lines", lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    long = F.transform(F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars), lambda x: F.struct(x["pos"].alias("pos"), *hash128(x["key"])))
    lines = written(rows.select("doc_id", "r0", "r1", F.explode(long).alias("x")).select("doc_id", "r0", "r1", "x.pos", "x.h1", "x.h2"), "lines")
    held = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    held = written(held.where(F.col("n") >= min_docs).select("h1", "h2", "last"), "held")
    lost = lines.join(held, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    lost = lost.groupBy(F.col("doc_id").alias("l_id"), F.col("r0").alias("l0"), F.col("r1").alias("l1")).agg(F.collect_set("pos").alias("gone"))
    whole = rows.join(written(lost, "lost"), (F.col("r0") == F.col("l0")) & (F.col("r1") == F.col("l1")) & F.col("doc_id").eqNullSafe(F.col("l_id")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return whole.select("doc_id", left.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, CAST(p AS BIGINT) AS pos, l[p] AS line,
         translate(trim(l[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), held AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), x AS (
  SELECT lines.*, held.k IS NOT NULL AND lines.doc_id <> held.last AS gone FROM lines LEFT JOIN held ON lines.k = held.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
