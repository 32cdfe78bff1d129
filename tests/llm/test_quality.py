"""Ordinal regression: gradients' result on a known model, held-out accuracy, edge rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cellmart.llm import quality, queries
from tests.conftest import SF

SF01 = SF.replace("0.001", "0.1")


def test_ordered_thresholds_and_recovery():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 50, (3000, 6))
    true = rng.normal(size=50)
    score = true[x].sum(axis=1) + rng.logistic(size=3000)
    y = np.digitize(score, [-1.5, 1.0, 2.5])
    m = quality.fit(list(x), [np.ones(6, np.float32)] * 3000, y, bits=6, epochs=30, penalty=0.0)
    assert len(m.thresholds) == 3 and (np.diff(m.thresholds) > 0).all()
    assert np.corrcoef(m.weights[:50], true)[0, 1] > 0.95
    p = m.probabilities(np.array([-5.0, 0, 5]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and (np.diff(p @ np.arange(4)) > 0).all()


def test_one_grade_and_no_grade():
    m = quality.fit([np.array([1])], [np.ones(1, np.float32)], np.array([0]), bits=4)
    assert len(m.thresholds) == 0
    assert len(quality.fit([], [], np.array([], int), bits=4).thresholds) == 0


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    rated = quality.ratings(labels)
    learn, rest = rated.where("doc_id % 3 <> 0"), rated.where("doc_id % 3 = 0")
    got = quality.grade(docs, quality.train(docs, learn)).join(rest, "doc_id").toPandas()
    keep, good = got.tail_probability >= 0.5, got.grade == 2
    assert len(got) > 1000 and (keep == good).mean() > 0.98
    assert got.groupby("grade").expected_grade.mean().is_monotonic_increasing


def slow_row(text, model):
    """Expected grade and P(grade >= 2), by the definition, token by token."""
    text = text or ""
    hashed = lambda s, seed: zlib.crc32(s, seed) & (len(model.weights) - 1)
    words = set(re.findall(r"\w+", text.lower()))
    score = sum(float(model.weights[hashed(w.encode(), 0)]) for w in words) + sum(float(model.weights[hashed(w.encode(), 2)]) for w in {w[:4] for w in words if len(w) > 4})
    tokens, shapes = re.findall(rb"[^ \t\n\r\x0b\x0c]+", text.encode()), Counter()
    for t in tokens:
        folded = ["A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 or c >= 128 else "0" if 48 <= c <= 57 else chr(c) for c in t]
        shapes["".join(c for c, _ in itertools.groupby(folded)).encode()] += 1
    if again := sum(a == b for a, b in zip(tokens, tokens[1:])):
        shapes[b"\0again"] = again
    score += sum(float(model.weights[hashed(s, 1)]) * 6 * math.sqrt(n / len(tokens)) for s, n in shapes.items())
    below = [1 / (1 + math.exp(score - t)) for t in model.thresholds]
    return sum(1 - b for b in below), 1 - below[1]


def test_query_against_brute_force(spark):
    """op4_quality by an independent reading of the model; tokens count whole, however long."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, quality.ratings(labels))
    got = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        grade, tail = slow_row(r.text, model)
        assert abs(got[r.doc_id].expected_grade - grade) < 1e-4 and abs(got[r.doc_id].tail_probability - tail) < 1e-4 and got[r.doc_id].kept == (got[r.doc_id].tail_probability >= 0.5)
    long = "x1" * 40 + "-A" * 300
    at, value = quality.features(long)
    assert float(model.weights[at].astype(float) @ value) == pytest.approx(sum(float(model.weights[i]) * v for i, v in zip(at, value)))
    assert set(quality.features("a1" * 40)[0]) != set(quality.features("a1" * 40 + "A")[0])


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words", 0.5), (2, None, 1.0), (3, "", 1.0), (3, "", 1.0), (None, "BAD!! " * 50_000, 1.0), (4, "x" * 100_000, 1.0)], "doc_id long, text string, tail_probability double")
    none = spark.createDataFrame([], "doc_id long, grade int")
    m = quality.train(docs, none)
    assert [tuple(r)[1:] for r in quality.grade(docs, m).collect()] == [(None, None)] * 6
    assert quality.drop_rejected(docs, m).count() == 6
    some = spark.createDataFrame([(1, 2), (1, 2), (4, 0), (2, None), (None, 1), (99, 1)], "doc_id long, grade int")
    m = quality.train(docs, some)
    assert len(quality.grade(docs, m).collect()) == 6 and quality.grade(docs.limit(0), m).count() == 0
    assert quality.drop_rejected(docs, m).columns == docs.columns
