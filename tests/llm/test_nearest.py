"""Nearest neighbours: recall against brute force, exact scores, copies, odd vectors."""

import numpy as np

from cellmart.llm import nearest as module
from cellmart.llm.nearest import Hasher, nearest
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(ids, x, query, top=20):
    s = (x * x[ids.index(query)]).sum(axis=1)
    order = sorted((-v, i) for v, i in zip(s, ids) if i != query)
    return [(i, -v) for v, i in order[:top]]


def recall(spark, at):
    t = spark.read.parquet(f"{at}/embeddings.parquet")
    rows = t.toPandas()
    ids, x = rows.vec_id.tolist(), np.array(rows.embedding.tolist(), np.float64)
    got = nearest(t, t.where("vec_id % 20 = 0")).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        want = brute(ids, x, q)
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 21))
        truth = {i: s for i, s in brute(ids, x, q, len(ids))}
        assert all(abs(truth[i] - s) < 1e-12 for i, s in zip(g.vec_id, g.score))
        hits += len(set(g.vec_id) & {i for i, _ in want})
        total += len(want)
    assert got.query_id.nunique() == sum(i % 20 == 0 for i in ids)
    return hits / total


def test_recall(spark):
    assert recall(spark, SF) >= 0.9
    assert recall(spark, SF.replace("0.001", "0.1")) >= 0.9


def test_recall_with_uneven_norms_and_shards(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(600, 16)) * rng.lognormal(0, 1.5, (600, 1))).astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)
    got = nearest(t, t.where("vec_id % 20 = 0"), shard_rows=100, block_rows=7).toPandas()
    ids, x = list(range(600)), x.astype(np.float64)
    hits = sum(len(set(g.vec_id) & {i for i, _ in brute(ids, x, q)}) for q, g in got.groupby("query_id"))
    assert hits / (30 * 20) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0], "") for i in range(60)] + [(100, [2.0, 0.0], ""), (100, [2.0, 0.0], ""), (101, [0.0, -1.0], "")]
    rows += [(200, None, ""), (220, [0.0, 0.0], ""), (240, [nan, 1.0], ""), (260, [inf, 1.0], ""), (280, [None, 1.0], ""), (300, [], ""), (320, [1.0, 2.0, 3.0], ""), (None, [5.0, 5.0], "")]
    t = spark.createDataFrame(rows, SCHEMA)
    got = nearest(t, t.where("vec_id % 20 = 0")).toPandas().sort_values(["query_id", "rank"])
    assert sorted(got.query_id.unique()) == [0, 20, 40, 100]
    assert got[got.query_id == 20].vec_id.tolist() == [100, *range(19)]
    assert got[got.query_id == 0].vec_id.tolist() == [100, *range(1, 20)]
    assert got[got.query_id == 100].vec_id.tolist() == list(range(20)) and (got[got.query_id == 100].score == 2).all()
    few = t.where("vec_id in (0, 1, 101)")
    assert nearest(few, few.where("vec_id = 0")).toPandas().sort_values("rank").vec_id.tolist() == [1, 101]
    assert nearest(t.limit(0), t.limit(0)).count() == 0


def test_probes_come_in_order_of_wall_distance():
    x = np.random.default_rng(1).normal(size=(400, 8))
    h = Hasher(8, {0: float(np.sqrt((x * x).sum(axis=1)).max())}, probes=60)
    own = h.buckets(x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * h.scale[0] * 0.999999999, np.zeros(400, int))
    for t, found in enumerate(h.probed(x[:50])):
        assert (found[:, 0] == own[:50, t]).mean() > 0.9  # its own bucket costs nothing
        few = next(f for i, f in enumerate(Hasher(8, h.scale, probes=3).probed(x[:50])) if i == t)
        assert (few == found[:, :3]).all()


def test_large_buckets_and_many_queries_are_split(spark):
    """A bucket with most of the rows, probed by all queries, in parts and blocks: the same as in one."""
    rng = np.random.default_rng(7)
    x = np.concatenate([1 + 0.01 * rng.normal(size=(300, 6)), rng.normal(size=(100, 6))]).astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)
    one, many = (sorted(map(tuple, nearest(t, t.where("vec_id % 5 = 0"), shard_rows=s, block_rows=b).collect())) for s, b in ((10**6, 10**6), (16, 8)))
    assert one == many


def test_work_is_what_the_probes_visit(spark, monkeypatch):
    """On clustered vectors recall holds while a small share of the rows is visited; no query falls back to all rows."""
    rng = np.random.default_rng(3)
    seen = []
    for n in (1000, 4000):
        centres = rng.normal(size=(n // 50, 12)) * 4
        x = (np.repeat(centres, 50, axis=0) + 0.3 * rng.normal(size=(n, 12))).astype(np.float32)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        t = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)
        monkeypatch.setattr(module, "everything", None)
        got = nearest(t, t.where("vec_id % 40 = 0")).toPandas()
        ids = list(range(n))
        y = x.astype(np.float64)
        hits = sum(len(set(g.vec_id) & {i for i, _ in brute(ids, y, q)}) for q, g in got.groupby("query_id"))
        assert hits / (20 * n / 40) >= 0.9
        norm = np.sqrt((y * y).sum(axis=1))
        band = np.floor(2 * np.log2(norm)).astype(int)
        h = Hasher(12, {b: norm[band == b].max() for b in set(band)})
        own, probed = h.buckets(y, band), list(h.probed(y[::40]))
        visits = np.mean([[len(set(np.flatnonzero(np.isin(own[:, t], p[i])))) for i in range(n // 40)] for t, p in enumerate(probed)])
        seen.append(visits / n)
    assert max(seen) < 0.25, seen
