"""Nearest neighbours by largest inner product: multiprobe p-stable hashing, candidates of all tables reranked exactly.

Inner products become distances: vectors are put into bands of similar norm, scaled by the band's largest norm and given one
more coordinate that makes them unit vectors; queries are scaled to unit length. Each table hashes by WIDTH-wide cells of
Gaussian projections. A query visits its own bucket and the buckets around it that are likeliest to hold its neighbours, PROBES in
all, by the squared distances to the cell walls that a perturbation crosses (Lv and others, 2007).

Vectors and probes meet in a join on table and bucket. Buckets are dealt to groups of about SHARD_ROWS vectors; a larger bucket is
split, and its probes go to all parts; the queries that probe a group come in blocks of BLOCK_ROWS. So a task is bounded whatever
the size, and the work is what the probes visit. Each task ranks its candidates by the exact inner product in double precision;
the best of all tables are merged. A query with fewer candidates than it may have to return sees all rows, in blocks.

Equal vectors are indexed once; their ids come back when results are expanded, of which each vector needs no more than it can
return, so copies by the thousand cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmart.llm.common import rows_of, written

TABLES = 10
FUNCTIONS = 6
WIDTH = 1.5
PROBES = 80
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
SEED = 20


def usable(v: Column) -> Column:
    """No null or non-finite component, and not all zero; null vectors give null."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


class Hasher:
    """The tables' projections; buckets are numbers made of FUNCTIONS cells of 1024 each."""

    def __init__(self, dim: int, scale: dict[int, float], tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = SEED):
        self.scale, self.width, self.probes = scale, width, probes
        rng = np.random.default_rng(seed)
        self.axes, self.shift = rng.normal(size=(tables, dim + 1, functions)), rng.uniform(0, width, (tables, functions))
        self.steps = np.array(list(product((-1, 0, 1), repeat=functions)))
        self.radix = np.int64(1024) ** np.arange(min(functions, 6))

    def _code(self, cell: np.ndarray) -> np.ndarray:
        cell = cell.astype(np.int64) + 512
        return cell @ np.resize(self.radix, cell.shape[-1])

    def buckets(self, x: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        y = x / np.array([self.scale[b] for b in band.tolist()])[:, None]
        y = np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))[:, None]])
        return np.stack([self._code(np.floor((y @ a + s) / self.width)) for a, s in zip(self.axes, self.shift, strict=True)], axis=1)

    def probed(self, q: np.ndarray) -> Iterator[np.ndarray]:
        """For each table the buckets that each query visits, in the order of their chances."""
        unit = np.hstack([q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))])
        n = min(self.probes, len(self.steps))
        for a, s in zip(self.axes, self.shift, strict=True):
            f = (unit @ a + s) / self.width
            cell = np.floor(f)
            r = f - cell
            cost = np.stack([r**2, np.zeros_like(r), (1 - r) ** 2], axis=-1)
            total = sum(cost[:, i, self.steps[:, i] + 1] for i in range(r.shape[1]))
            order = np.argpartition(total, n - 1, axis=1)[:, :n] if n < len(self.steps) else np.broadcast_to(np.arange(n), total.shape)
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(total, order, axis=1), axis=1, kind="stable"), axis=1)
            yield self._code(cell[:, None, :] + self.steps[order])


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, seen: np.ndarray | None, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, inner product) of the best top of each query's candidates (all, without seen); ties to the smaller id."""
    rough = q @ x.T
    if seen is not None:
        rough = np.where(seen, rough, -np.inf)
    out = []
    for i, row in enumerate(rough):
        good = np.argpartition(-row, top - 1)[:top] if top < len(row) else np.arange(len(row))
        edge = row[good].min()
        good = np.flatnonzero((row >= edge - 1e-9 * max(1.0, abs(edge))) & (row > -np.inf)) if np.isfinite(edge) else good[row[good] > -np.inf]
        score = (x[good] * q[i]).sum(axis=1)
        order = np.lexsort((ids[good], -score))[:top]
        out.append((np.full(len(order), i), ids[good[order]], score[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


#: Of each query the negated inner products and ids of its candidates, which sort in the order of results.
_FOUND = "q long, found array<struct<away: double, c: long>>"


def _lists(q: np.ndarray, c: np.ndarray, score: np.ndarray) -> pa.Table:
    """A row for each query, whose rows lie together, as _FOUND."""
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(-score, pa.float64()), pa.array(c, pa.int64())], ["away", "c"])
    return pa.table({"q": pa.array(q[first], pa.int64()), "found": pa.ListArray.from_arrays(pa.array(np.append(first, len(q)), pa.int32()), pairs)})


def _ranked(a: pa.Table, b: pa.Table, need: int) -> pa.Table:
    """The best of b's vectors (c, v, and bucket if there is one) for each of a's queries (q, v, buckets)."""
    if not a.num_rows or not b.num_rows:
        return _lists(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ids, c, q, x = a["q"].to_numpy(), b["c"].to_numpy(), _vectors(a["v"]), _vectors(b["v"])
    out = []
    if "buckets" in a.column_names:
        known, of = np.unique(b["bucket"].to_numpy(), return_inverse=True)
        lists = a["buckets"].combine_chunks()
        edge, asked = lists.offsets.to_numpy(), lists.values.to_numpy()
    for i in range(0, len(ids), 128):
        seen = None
        if "buckets" in a.column_names:
            some = asked[edge[i] : edge[min(len(ids), i + 128)]]
            who = np.repeat(np.arange(min(len(ids), i + 128) - i), np.diff(edge[i : min(len(ids), i + 128) + 1]))
            at = np.minimum(np.searchsorted(known, some), len(known) - 1)
            hit = np.zeros((min(len(ids), i + 128) - i, len(known)), bool)
            hit[who[known[at] == some], at[known[at] == some]] = True
            seen = hit[:, of]
        row, found, score = best(q[i : i + 128], x, c, seen, need)
        out.append((ids[i + row], found, score))
    q, c, score = (np.concatenate(z) for z in zip(*out, strict=True))
    return _lists(q, c, score)


def candidates(rows: DataFrame, asks: DataFrame, hasher: Hasher, need: int, shard_rows: int, block_rows: int) -> DataFrame:
    """(q, found): the best need candidates of each query and group of buckets. rows: c, v, band; asks: q, v."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 5000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(hasher.buckets(_vectors(b.column(1)), b.column(2).to_numpy())), pa.list_(pa.int64()))], names=["c", "buckets"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1000):
            for t, found in enumerate(hasher.probed(_vectors(b.column(1)))):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(list(found), pa.list_(pa.int64()))], names=["q", "t", "buckets"])

    # A bucket's number has its band in it; a part of a large bucket is chosen by the vector's id.
    at = written(rows.select("c", "v", "band").mapInArrow(hashed, "c long, buckets array<long>"), "buckets")
    at = at.select("c", F.posexplode("buckets").alias("t", "code")).join(rows.select("c", "band"), "c")
    sizes = written(at.groupBy("t", "code", "band").agg(F.count(F.lit(1)).alias("m")).withColumn("parts", F.ceil(F.col("m") / shard_rows).cast("int")), "sizes")
    groups = max(1, -(-rows.count() // shard_rows))
    group = F.pmod(F.xxhash64("t", "code", "band", "part"), F.lit(groups)).cast("int")
    bucket = F.xxhash64("code", "band")
    large = sizes.where("parts > 1").select("t", "code", "band", "parts")
    placed = at.join(large, ["t", "code", "band"], "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("c"), F.col("parts"))).otherwise(0).cast("int"))
    placed = written(placed.select("t", group.alias("g"), "c", bucket.alias("bucket")), "placed")
    parts = sizes.select("t", "code", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("t", "code", group.alias("g"), bucket.alias("bucket"))
    probes = asks.select("q", "v").mapInArrow(probing, "q long, t int, buckets array<long>").select("q", "t", F.explode("buckets").alias("code"))
    probes = written(probes.join(parts, ["t", "code"]).groupBy("t", "g", "q").agg(F.collect_set("bucket").alias("buckets")), "probes")
    blocks = written(probes.groupBy("t", "g").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")), "blocks")  # tables x groups rows
    left = probes.join(blocks, ["t", "g"]).select("t", "g", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("b"), "q", "buckets").join(asks, "q")
    right = placed.join(blocks, ["t", "g"]).select("t", "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "c", "bucket").join(rows.select("c", "v"), "c")
    key = ["t", "g", "b"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _ranked(a, b, need), _FOUND)


def everything(rows: DataFrame, asks: DataFrame, need: int, shard_rows: int, block_rows: int, counts: tuple[int, int]) -> DataFrame:
    """(q, found) of a stated set of queries against all rows, in blocks."""
    shards, blocks = (max(1, -(-n // size)) for n, size in zip(counts, (shard_rows, block_rows), strict=True))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select(deal("q", blocks).alias("b"), every(shards).alias("s"), "q", "v")
    right = rows.select(every(blocks).alias("b"), deal("c", shards).alias("s"), "c", "v")
    return left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(lambda a, b: _ranked(a, b, need), _FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, probes: int = PROBES) -> DataFrame:
    """One row per query and neighbour: query_id, rank (from 1), vec_id, score.

    vectors and queries need vec_id and embedding; other columns are ignored. A query's neighbours are the top rows of
    vectors, but for those with its own vec_id, by inner product, ties to the smaller vec_id; fewer if there are fewer. Rows
    with a null vec_id and vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do
    vectors of another length than the commonest. A row that repeats counts once. Empty tables give an empty result.
    """
    need = top + 1
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" == queries.schema["embedding"].dataType.simpleString() else "double"
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where("id is not null").where(usable(F.col("v")))
    rows, asked = pick(vectors), pick(queries)
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dim[0].d if dim else 0
    first = Window.partitionBy("v").orderBy("id")
    rows = rows.where(F.size("v") == dim).groupBy("v", "id").agg(F.lit(1).alias("one")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= need)
    rows = rows.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("c"), "ids", "v")
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    rows = written(rows.withColumn("norm", norm).withColumn("band", F.floor(2 * F.log2("norm")).cast("int")), "vectors")
    asked = asked.where(F.size("v") == dim)
    asks = written(asked.groupBy("v").agg(F.min("id").alias("q")), "queries")
    scale = {r.band: r.most for r in rows.groupBy("band").agg(F.max("norm").alias("most")).collect()}  # a row a power of the root of two
    found = written(candidates(rows, asks, Hasher(dim, scale, probes=probes), need, shard_rows, block_rows), "candidates")
    # A query's lists are as many as its probes at most. A candidate of several tables stands there once for each, with the
    # same product, so the best ones are among the first of all lists.
    first = lambda n: F.slice(F.array_distinct(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, n * need)), 1, need)
    merged = lambda df, n: df.groupBy("q").agg(first(n).alias("found"))
    found, n_rows = merged(found, TABLES), rows.count()
    enough = written(found.where(F.size("found") >= min(need, n_rows)), "enough")
    short = written(asks.join(enough.select("q"), "q", "left_anti"), "short")
    n_short = short.count()
    if n_short:
        enough = enough.unionByName(merged(everything(rows, short, need, shard_rows, block_rows, (n_rows, n_short)), 1))
    ranked = enough.select("q", F.explode("found").alias("x")).select("q", "x.c", (-F.col("x.away")).alias("score"))
    ranked = ranked.join(rows.select("c", "ids"), "c").select("q", F.explode("ids").alias("id"), "score")
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("n") <= need)
    ranked = written(ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found")), "best")
    of = asked.join(asks, "v").select("id", "q").distinct()
    mine = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, top)
    return of.join(ranked, "q").select(F.col("id").alias("query_id"), F.posexplode(mine).alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), "x.score")
