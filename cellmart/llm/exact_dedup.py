"""Exact deduplication by deterministic block naming (DataFrame functions only).

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted within their hash partition and get
integer names; then the names of adjacent blocks are paired, the distinct pairs are named in the same way, and so on until a
document has one name. Two documents have equal (levels, name) if and only if their normalised texts are equal: a name stands
for one block or one pair, never for a hash.

Only the distinct blocks are shuffled as text, once and after a map-side combine. Occurrences find their block's name by a
128-bit hash of it, and `_block_names` proves on the data that no two distinct blocks share that hash (else it takes
another seed), so the names stay free of collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmart.llm.common import ASCII_SPACE, hash128, text_or_empty, written

BLOCK_BYTES = 2048


def normalised(text: str = "text") -> Column:
    """Each run of white space becomes one space; null counts as empty. Single spaces are left alone, which saves the copy."""
    return F.regexp_replace(text_or_empty(text), rf"[\x09-\x0D][{ASCII_SPACE}]*|\x20[{ASCII_SPACE}]+", " ")


def _blocks(size: int) -> Column:
    """The array of blocks; an empty text has one empty block."""
    last = F.greatest(F.lit(0), F.floor((F.octet_length("bytes") - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names in sorted order within each partition: the partition's number above, the rank below."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _block_names(texts: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(h1, h2, name) of each distinct block, and the seed by which the hashes are unique."""
    for seed in range(42, 1042, 100):
        blocks = texts.select(F.explode(_blocks(size)).alias("block")).groupBy("block").agg(F.lit(1).alias("one"))
        names = written(_named(blocks, ["block"]).select(*hash128(F.col("block"), seed), "name"), "blocks")
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            return names, seed
    raise RuntimeError("ten seeds in a row gave two blocks the same 128-bit hash")


def _occurrences(texts: DataFrame, size: int, seed: int) -> DataFrame:
    """(doc_id, sha, n, pos, h1, h2) of each block of each text; n counts the text's blocks.

    An outer explode, as every text has a block: for a plain one Spark infers a filter that the array isn't empty, pushes it
    down to the scan with the array's whole expression in it, and so normalises the text once more for each of its blocks.
    """
    rows = texts.select("doc_id", F.unhex("sha").alias("sha"), F.transform(_blocks(size), lambda b: F.struct(*hash128(b, seed))).alias("b"))
    rows = rows.select("doc_id", "sha", F.size("b").alias("n"), "b")  # before the explode, which else repeats the array in each row
    return rows.select("doc_id", "sha", "n", F.posexplode_outer("b").alias("pos", "b")).select("doc_id", "sha", "n", "pos", "b.h1", "b.h2")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text counts as empty. group_size
    counts rows. Of repeated rows (same doc_id, equal text) one is kept. A null doc_id loses against any other; where a
    group has no other, keep_id is null and one of its rows is kept. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id"), normalised().alias("norm")).select("doc_id", F.sha2("norm", 256).alias("sha"), F.col("norm").cast("binary").alias("bytes"))
    names, seed = _block_names(texts, block_bytes)
    rows = _occurrences(texts, block_bytes, seed)
    # Repeated rows fall together here; times counts them.
    rows = rows.groupBy("doc_id", "sha", "n", "pos", "h1", "h2").agg(F.count(F.lit(1)).alias("times"))
    here = written(rows.join(names, ["h1", "h2"]).select("doc_id", "sha", "n", "pos", "name", "times"), "level")
    done, level = [], 0
    while True:
        done.append(here.where("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name", "times"))
        if here.where("n > 1").isEmpty():
            break
        level += 1
        right = F.pmod(F.col("pos"), F.lit(2)) == 1
        pairs = here.where("n > 1").groupBy("doc_id", "sha", "n", "times", F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(
            F.max(F.when(~right, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(-1)).alias("right"))
        names = written(_named(pairs.groupBy("left", "right").agg(F.lit(1).alias("one")), ["left", "right"]).select("left", "right", "name"), "pairs")
        here = written(pairs.join(names, ["left", "right"]).select("doc_id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("at").alias("pos"), "name", "times"), "level")
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    whole = written(whole, "identity")
    groups = whole.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"))
    # Written, so that either side of the join is a plain exchange, which adaptive execution may split where a group is hot.
    groups = written(groups, "groups")
    out = whole.join(groups, ["level", "name"]).select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates() drops, with all its columns: one row stays of each different text.

    It is the row of the smallest doc_id; where all are null, one of them. Rows of one doc_id with different texts, or of
    none, are no copies. Of rows that repeat in doc_id and text one stays. Null texts are empty and stay null. An empty table
    gives an empty result.
    """
    found = written(exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha")), "kept")
    rows = docs.select(F.col("doc_id").alias("_key"), F.unhex(F.sha2(normalised(), 256)).alias("_text"), F.struct("*").alias("_row"))
    rows = rows.join(found, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")), "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # only then can a row repeat
        rows = rows.dropDuplicates(["_key", "_text"])
    return rows.select("_row.*")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
