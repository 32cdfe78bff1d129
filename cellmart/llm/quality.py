"""Quality classifier: ordinal cumulative-link regression over hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): all grades share the weights w of hashed features, and the thresholds are
ordered. The model gives the expected grade and the tail probability P(grade >= cut) by which documents are selected.

Features: each different word (lower case) and each beginning of STEM letters once; each token shape (letters, capitals, digits folded; runs folded) and the
tokens that repeat the one before them, with SCALE times the square root of their share of the tokens. The weights are fitted on a sample of at most SAMPLE rated documents, those of the
smallest hashed doc_id, so that the sample is the same at every run; the result holds every document.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmart.llm.common import mapped, rows_of, save_bytes, scratch_dir, text_or_empty

SAMPLE = 10_000
BITS = 22
EPOCHS = 12
SCALE = 6.0
LEAST_DOCS = 5
STEM = 4
CUT = 2
_WORD = re.compile(r"\w+")
_RUN = re.compile(rb"(.)\1+", re.S)
_CLASS = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c
    for c in range(256)
)


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the text's features; equal indices may repeat."""
    mask = (1 << bits) - 1
    found = set(_WORD.findall(text.lower()))
    words = [zlib.crc32(w.encode()) & mask for w in found]
    words += [zlib.crc32(w.encode(), 2) & mask for w in {w[:STEM] for w in found if len(w) > STEM}]
    shapes: Counter[bytes] = Counter()
    raw = text.encode("utf-8", "replace")
    tokens = raw.split()
    for s, n in Counter(raw.translate(_CLASS).split()).items():
        shapes[_RUN.sub(rb"\1", s)] += n
    total = len(tokens)
    if again := sum(map(operator.eq, tokens, tokens[1:])):
        shapes[b"\0again"] = again
    at = np.array(words + [zlib.crc32(s, 1) & mask for s in shapes], np.int64)
    value = np.ones(len(at), np.float32)
    if total:
        value[len(words) :] = SCALE * np.sqrt(np.fromiter(shapes.values(), np.float32, len(shapes)) / total)
    return at, value


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ordered; empty if nothing was rated

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) for each row of scores."""
        low = _sigmoid(self.thresholds[None, :] - score[:, None])
        edge = np.ones((len(score), 1))
        return np.diff(np.hstack([0 * edge, low, edge]), axis=1)


def fit(at: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, least_docs: int = LEAST_DOCS, rate: float = 0.1, penalty: float = 0.1, seed: int = 7) -> Model:
    """Maximum likelihood with an L1 penalty, by proximal AdaGrad over small batches. Features of few documents get no weight."""
    if not len(grade):
        return Model(np.zeros(1 << bits, np.float32), np.zeros(0))
    k = int(grade.max()) + 1
    held = np.bincount(np.concatenate([np.unique(a) for a in at]) if len(at) else [], minlength=1 << bits)
    at, value = zip(*((a[m], v[m]) for a, v in zip(at, value, strict=True) for m in (held[a] >= least_docs,)), strict=True)
    w, seen = np.zeros(1 << bits, np.float32), np.full(1 << bits, 1e-6, np.float32)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=k))[:-1] / len(grade), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # The first threshold and the logarithms of the gaps: ordered whatever the steps.
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))]) if k > 1 else np.zeros(0)
    gone = np.full(len(free), 1e-6)
    rng = np.random.default_rng(seed)
    cut = lambda: np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])) if k > 1 else np.zeros(0)
    for _ in range(epochs if k > 1 else 0):
        order = rng.permutation(len(grade))
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            a, v = np.concatenate([at[j] for j in part]), np.concatenate([value[j] for j in part])
            row = np.repeat(np.arange(len(part)), [len(at[j]) for j in part])
            f = np.bincount(row, weights=w[a] * v, minlength=len(part))
            t = np.concatenate([[-np.inf], cut(), [np.inf]])
            y = grade[part]
            hi, lo = _sigmoid(t[y + 1] - f), _sigmoid(t[y] - f)
            slope = hi + lo - 1  # of the log likelihood by f
            u, inv = np.unique(a, return_inverse=True)
            g = np.bincount(inv, weights=slope[row] * v)
            seen[u] += g * g
            step = rate / np.sqrt(seen[u])
            x = w[u] + step * g
            w[u] = np.sign(x) * np.maximum(0, np.abs(x) - step * penalty)
            p = np.maximum(hi - lo, 1e-9)
            dt = np.zeros(k + 1)
            np.add.at(dt, y + 1, hi * (1 - hi) / p)
            np.add.at(dt, y, -lo * (1 - lo) / p)
            dt = dt[1:k]
            g = np.array([dt.sum(), *(dt[j:].sum() * np.exp(free[j]) for j in range(1, k - 1))])
            gone += g * g
            free = free + rate * g / np.sqrt(gone)
    return Model(w, cut())


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """ratings: doc_id and grade (0, 1, ...; null ratings are left out). At most sample documents' features come to the driver."""
    chosen = ratings.where("grade is not null and doc_id is not null").groupBy(F.col("doc_id").alias("r_id")).agg(F.min("grade").cast("int").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("r_id"), "r_id").limit(sample)
    rows = docs.select(F.col("doc_id").alias("d_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), F.col("d_id") == F.col("r_id")).select("d_id", "grade", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 500):
            found = [features(t, bits) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["d_id", "grade", "a", "v"])

    got = rows.mapInArrow(work, f"d_id {rows.schema['d_id'].dataType.simpleString()}, grade int, a binary, v binary").toArrow().sort_by("d_id")
    at = [np.frombuffer(x, "<u4").astype(np.int64) for x in got["a"].to_pylist()]
    return fit(at, [np.frombuffer(x, np.float32) for x in got["v"].to_pylist()], got["grade"].to_numpy().astype(np.int64), bits)


def grade(docs: DataFrame, model: Model, cut: int = CUT) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade, tail_probability (of a grade of cut or more).

    docs needs doc_id and text; other columns are ignored. A null text is an empty one, which has no features: it gets what
    the thresholds alone say. Without any ratings both are null. An empty table gives an empty result.
    """
    at = scratch_dir(docs.sparkSession, "quality") + "/weights"
    save_bytes(at, [model.weights.astype("<f4").tobytes()])
    thresholds = model.thresholds
    bits = int(len(model.weights)).bit_length() - 1
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_or_empty().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(np.frombuffer(mapped(at), "<f4"), thresholds)
        for b in rows_of(batches, 500):
            score = np.array([float(m.weights[a].astype(np.float64) @ v) for a, v in (features(t, bits) for t in b.column(1).to_pylist())])
            if len(thresholds):
                p = m.probabilities(score)
                out = [pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, cut:].sum(axis=1))]
            else:
                out = [pa.nulls(b.num_rows, pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=["doc_id", "expected_grade", "tail_probability"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double")


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from the table labels: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def kept(tail):
    """Whether a document stays, by its tail probability; without ratings all stay."""
    return F.coalesce(tail >= 0.5, F.lit(True))


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rejected rows, with all its columns. The text is classified where it lies: no join, no shuffle.

    A null text is an empty one. Equal texts have one fate, whatever their doc_ids; without ratings all rows stay. An empty
    table gives an empty result.
    """
    at = scratch_dir(docs.sparkSession, "quality") + "/weights"
    save_bytes(at, [model.weights.astype("<f4").tobytes()])
    thresholds = model.thresholds
    bits = int(len(model.weights)).bit_length() - 1
    if not len(thresholds):
        return docs
    place = [c.lower() for c in docs.columns].index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(np.frombuffer(mapped(at), "<f4"), thresholds)
        for b in rows_of(batches, 500):
            score = np.array([float(m.weights[a].astype(np.float64) @ v) for a, v in (features(t or "", bits) for t in b.column(place).to_pylist())])
            yield b.filter(pa.array(m.probabilities(score)[:, CUT:].sum(axis=1) >= 0.5))

    return docs.mapInArrow(work, docs.schema)
