"""The pipeline's stages, each on its own input, against brute force on the smallest tables."""

import re
import sys

import numpy as np
import pytest

import corpus_pipeline as p
from cellmart.llm import pii, quality, queries
from cellmart.llm.common import written
from tests.conftest import SF
from tests.llm.test_dedup import slow_shingles
from tests.llm.test_tokens import library


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in p.STAGES:
        done = written(f(spark, docs, SF), name)
        out.append((docs.toPandas(), done.toPandas()))
        docs = done
    return out


def test_columns_and_whole_texts(stages):
    for (a, b), (name, _) in zip(stages[:-1], p.STAGES):
        assert list(a.columns) == list(b.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
        if name != "pii":
            kept = a[a.doc_id.isin(b.doc_id)].sort_values("doc_id").reset_index(drop=True)
            assert kept.equals(b.sort_values("doc_id").reset_index(drop=True))


def test_quality_stage(spark, stages):
    a, b = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), quality.ratings(spark.read.parquet(f"{SF}/labels.parquet")))
    score = np.array([float(model.weights[i].astype(float) @ v) for i, v in map(quality.features, a.text)])
    assert set(b.doc_id) == set(a.doc_id[model.probabilities(score)[:, 2:].sum(axis=1) >= 0.5])
    clean = set(labels.doc_id[(labels.quality == 1) & (labels.toxic == 0)])
    assert len(clean & set(b.doc_id)) > 0.95 * len(clean)


def test_exact_stage(stages):
    a, b = stages[1]
    first = {}
    for i, t in sorted(zip(a.doc_id, a.text)):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), i)
    assert set(b.doc_id) == set(first.values())


def test_near_stage(stages):
    """One document of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    a, b = stages[2]
    ids, sets = a.doc_id.tolist(), [slow_shingles(t) for t in a.text]
    root = {i: i for i in ids}
    for i, x in zip(ids, sets):
        for j, y in zip(ids, sets):
            if i < j and (len(x & y) / len(x | y) if x | y else 1) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert set(b.doc_id) == set(root.values())


def test_pii_stage(spark, stages):
    a, b = stages[3]
    field = pii.train(spark.createDataFrame(a))
    want = {i: pii.masked(t, pii.all_spans(t, field)[1]) for i, t in zip(a.doc_id, a.text)}
    assert dict(zip(b.doc_id, b.text)) == want and dict(zip(b.doc_id, b.n_chars)) == {i: len(t) for i, t in want.items()}
    assert any(x != y for x, y in zip(a.sort_values("doc_id").text, b.sort_values("doc_id").text)) and not b.text.str.contains("@").any()


def test_packing_stage(stages):
    a, b = stages[4]
    whole = library("byte_bpe_50k.json")
    by = {i: b"".join(g.sort_values("start").ids) for i, g in b.groupby("doc_id")}
    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in by.items()} == {i: [*whole(t), 0] for i, t in zip(a.doc_id, a.text)}


def test_run_equals_the_stages(spark, stages):
    got = p.run(spark, SF).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, stages[-1][1][key].values.tolist()))


def test_queries_have_the_contracts_columns(spark):
    want = {
        "op1_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"}, "op2_language_model": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op3_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op5_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
        "op6_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op7_nearest": {"query_id", "rank", "vec_id", "score"},
        "op8_token_store": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op9_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, SF)
        assert columns <= set(df.columns), name
        rows = df.count()
        assert rows >= 200 or name == "op7_nearest" and rows == 25 * 20


def test_held_out_texts_score_above_the_base(spark):
    got = queries.op2_language_model(spark, SF).where("held_out").toPandas()
    assert len(got) > 10 and got.score.sum() > got.base_score.sum()


def test_entry_without_this_package(monkeypatch):
    import __spark_entry__ as entry

    full = set(entry.queries())
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("cellmart.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "cellmart.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert {n for n in full if not n.startswith("op") and n != "pipeline"} == set(entry.queries())
