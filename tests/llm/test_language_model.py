"""Elias-Fano against sorted arrays; the model against a plain dictionary of counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cellmart.llm import elias_fano, language_model


@pytest.mark.parametrize("n,u", [(0, 1), (1, 1), (1, 10**12), (5, 5), (1000, 1001), (5000, 10**9), (70_000, 10**6), (3000, 2**62)])
def test_elias_fano(n, u):
    rng = np.random.default_rng(n)
    x = np.sort(np.unique(rng.integers(0, u, n, dtype=np.uint64))) if n else np.zeros(0, np.uint64)
    if n > 100:
        x = np.unique(np.concatenate([x, np.arange(u // 2, min(u // 2 + 300, u), dtype=np.uint64)]))  # a dense run
    s = elias_fano.Sequence(memoryview(elias_fano.encode(x, u)))
    assert s.n == len(x)
    assert (s.get(np.arange(len(x))) == x).all()
    q = np.concatenate([x, rng.integers(0, u, 500, dtype=np.uint64)])
    want = np.searchsorted(x, q)
    ok = (want < len(x)) & (x[np.minimum(want, len(x) - 1)] == q) if len(x) else np.zeros(len(q), bool)
    assert (s.find(q) == np.where(ok, want, -1)).all()


def test_elias_fano_repeats():
    x = np.array([0, 0, 0, 3, 3, 9], np.uint64)
    s = elias_fano.Sequence(memoryview(elias_fano.encode(x, 10)))
    assert s.get(np.arange(6)).tolist() == x.tolist()


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_scores(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    train = [[*words_of(t), ""] for i, t in docs if not held[i]]
    uni = Counter(w for t in train for w in t)
    big = Counter((a, b) for t in train for a, b in zip(["", *t], t))
    tri = Counter((a, b, c) for t in train for a, b, c in zip(["", *t], t, t[1:]))
    n, v = sum(uni.values()), len(uni)
    n1, n2 = (sum(c == k for c in uni.values()) for k in (1, 2))
    d1 = min(0.99, max(0.01, n1 / (n1 + 2 * n2)))
    keep2, keep3 = big, tri  # every n-gram, however rare
    q = lambda p: float(language_model._VALUES[language_model._quantised(np.array([p]))[0]])
    left2, left3 = Counter(), Counter()
    for (a, b), c in keep2.items():
        left2[a] += q((c - 0.75) / uni[a])
    for (a, b, c), k in keep3.items():
        left3[a, b] += q((k - 0.75) / big[a, b])
    scale = lambda x: max(1, math.floor((1 - x) * 65535)) / 65535

    def p1(w):
        return (uni[w] - d1 if w in uni else d1 * v) / n

    def p2(a, w):
        return (q((keep2[a, w] - 0.75) / uni[a]) if (a, w) in keep2 else 0) + scale(left2[a]) * p1(w)

    def p3(a, b, w):
        if (a, b) not in keep2:
            return p2(b, w)
        return (q((keep3[a, b, w] - 0.75) / big[a, b]) if (a, b, w) in keep3 else 0) + scale(left3[a, b]) * p2(b, w)

    out = {}
    for i, t in docs:
        t = [*words_of(t), ""]
        base = sum(math.log10((uni[w] + 1) / (n + 1 * (v + 1))) for w in t)
        full = math.log10(p2("", t[0])) + sum(math.log10(p3(a, b, w)) for a, b, w in zip(["", *t], t, t[1:]))
        out[i] = (held[i], len(t), sum(w in uni for w in t), n, round(base, 6), round(full, 6))
    mass = [sum(p3(a, b, w) for w in uni) + p3(a, b, "no such word") for a, b in [("", ""), *list(keep2)[:5]]]
    return out, mass


@pytest.mark.parametrize("shard_tokens", [10**9, 300, 7])
def test_scores(spark, monkeypatch, shard_tokens):
    """Also with shards so small that frequent words and pairs are split by their successors."""
    monkeypatch.setattr(language_model, "BATCH_TOKENS", 5000)
    rng = random.Random(4)
    common = [" ".join(rng.choice("aa Bb cc dd ee".split()) for _ in range(30)) for _ in range(5)]
    docs = [(i, "\n".join([*(rng.choice(common) for _ in range(rng.randrange(3))), *(f"w{int(rng.expovariate(0.02))}" for _ in range(20))])) for i in range(80)]
    docs += [(80, None), (81, ""), (82, " \x0b\t"), (83, "É é ß x" * 2000), (90, "q " * 30_000)]
    want, mass = slow_scores(docs)
    assert np.allclose(mass, 1, atol=1e-3)
    frame = spark.createDataFrame([(i, t, 0.0, 1) for i, t in docs], "doc_id long, text string, score double, n int")
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in language_model.score(frame, shard_tokens=shard_tokens).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4] and np.allclose(got[i][4:], want[i][4:], atol=1e-4), i


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = language_model.score(spark.createDataFrame([(held, "a b"), (held, "a b")], none.schema)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * 2
    got = language_model.score(spark.createDataFrame([(None, "a b"), (held, "a")], none.schema)).collect()
    assert sorted((r.held_out, r.n_tokens, r.n_known) for r in got) == [(False, 3, 3), (True, 2, 2)]


def test_query(spark, monkeypatch):
    from cellmart.llm import queries

    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(12))) + f" w{i} v{i % 30}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    got = {r.doc_id: r.score for r in queries.op2_language_model(spark, "").collect()}
    want = {i: x[-1] for i, x in slow_scores(docs)[0].items()}
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_equal_first_halves_of_word_hashes(tmp_path):
    """Words are told apart by all 128 bits."""
    h = np.array([[5, 1], [5, 2], [5, 9], [7, 0]], np.uint64)
    (tmp_path / "words-0").write_bytes(b"".join(c.astype("<u8").tobytes() for c in (h[:, 0], h[:, 1], np.array([3, 4, 5, 6], np.uint64))))
    m = language_model.Model(language_model.Shape(str(tmp_path), 0, np.array([0, 4]), 18, 0, 0))
    assert m.ids(np.concatenate([h[::-1], np.array([[5, 3], [6, 1], [9, 9]], np.uint64)])).tolist() == [3, 2, 1, 0, 4, 4, 4]
    assert m.counts(np.array([0, 3, 4])).tolist() == [3, 6, 0]


def test_cuts():
    at, parts = language_model._cut(np.array([1, 1, 50, 2, 3, 9, 9]), 10)
    assert dict(zip(at.tolist(), parts.tolist()))[2] == 5 and at[0] == 0 and {2, 3} <= set(at.tolist())
    c = language_model.Cuts("x", np.array([0, 2, 2, 2, 3]), np.array([0, 0, 4, 8, 0]), 9, 12, split=np.array([2]))
    assert c.shard(np.array([0, 1, 2, 2, 2, 2, 3, 8]), np.array([5, 11, 0, 4, 7, 11, 0, 3])).tolist() == [0, 0, 1, 2, 2, 3, 4, 4]
    assert c.shard(np.array([0, 2, 3])).tolist() == [0, 1, 4]
