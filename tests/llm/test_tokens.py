"""Packing, the token store and SentencePiece against their libraries; exact round trips."""

import functools
import io
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellmart.llm import packing, pieces, queries, token_memo, token_store
from tests.conftest import SF

SCHEMA = "doc_id long, text string, start string, ids int"
rng = random.Random(8)
ALPHABET = "abcdefghijklmnopqrstuvwxyz    \n\tABC12.,!'sé日本ΣяΩ▁\xa0 \x1c\x0b<|endoftext|> "
TEXTS = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80))) for _ in range(800)]
TEXTS += ["", " ", "\n", "  \n x", "x \n", "don't  won't\r\n\r\n'll", "é ́x", "a" * 5000, "ab " * 20_000, "<|endoftext|> <s> </s> <unk> <0x0A>", "İSTANBUL ﬁ ẞ"]


MORE = [*TEXTS, None, "x <|endoftext|>", "\n <|endoftext|> \n", "a<|startoftext|>b  <|endoftext|>\n" * 300]


@functools.cache
def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_equals_library(name, monkeypatch):
    monkeypatch.setattr(token_memo, "MEMO_CHUNKS", 1500)
    whole = library(name)
    m = token_memo.coder(public_tokenizers.path(name))
    for i in range(0, len(MORE), 100):
        some = MORE[i : i + 100]
        for size in (1 << 20, 50):
            monkeypatch.setattr(token_memo, "SLICE", size)
            ids, at = m.encode(pa.array(some, pa.string()))
            ends, stop = m.encode(pa.array(some, pa.string()), 7)
            for k, t in enumerate(some):
                assert ids[at[k] : at[k + 1]].tolist() == whole(t or ""), t
                assert ends[stop[k] : stop[k + 1]].tolist() == [*whole(t or ""), 7]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0\u180e\u2003\u2028\u200b\u3000'a1.é\u0301<|Σ日"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_any_text(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ids, at = token_memo.coder(public_tokenizers.path(name)).encode(pa.array(texts, pa.string()))
        whole = library(name)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [whole(t) for t in texts]


def test_folded_chunks_and_joined_words():
    """One chunk for a word in any case and place; far fewer calls; ids as before, also where lower-casing and composing meet."""
    texts = ["Word word WORD wOrd", " word\nword  Word\tword", "H\u0331 h\u0331 T\u0308x I\u0307 \u0130x \u1e96 Stra\u00dfe STRASSE \u01c5 \u2126 \u212a K", "a1b2 '' don't DON'T 'S x's \u02b0\u0301 \u0e33 ª º", ""]
    texts += [" ".join("".join(rng.choice("aBcdEfghiß") for _ in range(6)) for _ in range(500))]
    whole = library("word_bpe_49k.json")
    made = token_memo.coder(public_tokenizers.path("word_bpe_49k.json"))
    calls = []
    c = token_memo.Coder(lambda xs: [calls.append(x) or y for x, y in zip(xs, made.encode_many(xs))], made.special, made.ends)
    ids, at = c.encode(pa.array(texts))
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [whole(t) for t in texts]
    assert "word" in c.memo.known and not {"Word", " word", "WORD"} & set(c.memo.known)
    calls.clear()
    c.encode(pa.array([" ".join("".join(rng.choice("abcdefghi") for _ in range(8)) for _ in range(500))]))
    assert len(calls) < 10
    assert token_memo.coder(public_tokenizers.path("byte_bpe_50k.json")).ends is None


def test_special_tokens_are_the_librarys():
    for name, want in (("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", 49407)):
        ids, _ = token_memo.coder(public_tokenizers.path(name)).encode(pa.array(["a <|endoftext|> b"]))
        assert want in ids.tolist() and ids.tolist() == library(name)("a <|endoftext|> b")


def test_slices():
    for t in TEXTS:
        raw = t.encode()
        assert b"".join(token_memo.slices(raw, 7)) == raw
    assert len(list(token_memo.slices(b"ab " * 20_000, 100))) > 100


def test_pieces_of_a_length():
    for n in [1, 2, 3, 1023, 1024, 1025, 5000]:
        p = packing.pieces(n)
        assert sum(k for _, k in p) == n and all(k & (k - 1) == 0 and k <= 1024 for _, k in p)
        assert [s for s, _ in p] == np.cumsum([0, *(k for _, k in p[:-1])]).tolist()


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 2, t, "x", 1) for i, t in enumerate(texts)] + [(3, None, "x", 1), (3, None, "x", 1), (None, "null id", "x", 1)], SCHEMA)


def test_pack(spark):
    whole = library("byte_bpe_50k.json")
    got = packing.pack(rows(spark)).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and len(r.ids) == 4 * r.length for r in got)
    by = {}
    for r in sorted(got, key=lambda r: r.start):
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        want = [*whole(t), 0]
        assert np.frombuffer(b"".join(r.ids for r in by[2 * i]), "<u4").tolist() == want and {r.doc_tokens for r in by[2 * i]} == {len(want)}
    assert len(by[3]) == 2 and len(by[None]) >= 1
    assert packing.pack(rows(spark).limit(0)).count() == 0


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_BYTES", 1 << 10)
    whole = library("word_bpe_49k.json")
    files = token_store.write_tokens(rows(spark))
    got = sorted(token_store.read_tokens(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted([3, 3, *(2 * i for i in range(len(TEXTS)))])]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    by = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got}
    assert all(by[2 * i] == [*whole(t), 2] for i, t in enumerate(TEXTS)) and by[3] == [2]
    some = token_store.read_tokens(spark, files, wanted=[3, 10, 10**9]).collect()
    assert sorted(r.doc_id for r in some) == [3, 3, 10]
    with pytest.raises(ValueError):
        token_store.write_tokens(spark.createDataFrame([("x", "y")], "doc_id string, text string"))
    assert token_store.write_tokens(rows(spark).limit(0)) == [] and token_store.read_tokens(spark, []).count() == 0


def test_file_format():
    docs = [(1, np.arange(10, dtype="<u4").tobytes()), (2, b""), (2, np.arange(3000, dtype="<u4").tobytes()), (9, np.arange(5, dtype="<u4").tobytes())]
    raw = b"".join(token_store.encode_file(docs, frame_bytes=2048))
    r = token_store.Reader(io.BytesIO(raw))
    assert [r.document(i) for i in range(4)] == [d for _, d in docs] and r.find(2) == [1, 2] and r.find(5) == []
    one = token_store.Reader(io.BytesIO(raw))
    assert one.document(3) == docs[3][1] and one.frames_read == 1 < len(one.table)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(d for _, d in docs)
    place = int(r.at[0]) + int(r.table[0, 0]) // 2
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_store.Reader(io.BytesIO(raw[:place] + bytes([raw[place] ^ 255]) + raw[place + 1 :])).document(0)
    with pytest.raises(ValueError):
        token_store.Reader(io.BytesIO(raw[:-1] + b"x"))


def test_sentencepiece_equals_library(spark, monkeypatch):
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    c = pieces.coder("piece_bpe_32k.model")
    some = [*TEXTS, "aabab" * 300, " " * 200, "日本語のテキスト" * 300, None]
    for size in (1 << 20, 60):
        monkeypatch.setattr(token_memo, "SLICE", size)
        ids, at = c.encode(pa.array(some, pa.string()))
        back = c.decode(ids, at).to_pylist()
        for k, t in enumerate(some):
            assert ids[at[k] : at[k + 1]].tolist() == p.encode(t or ""), t[:80]
            assert back[k] == p.decode(p.encode(t or ""))
    got = {r.doc_id: (r.ids, r.text) for r in pieces.decode(pieces.encode(rows(spark))).collect()}
    assert all(got[2 * i][1] == t for i, t in enumerate(TEXTS) if "▁" not in t and "\x1c" not in t and t[:1] != " ") and got[3] == (b"", "")
    assert pieces.decode(pieces.encode(rows(spark).limit(0))).count() == 0


def test_round_trip_in_one_worker(spark):
    """The same rows as encoding and then decoding, with one Python pass a task; the query takes that way."""
    docs = rows(spark, [*TEXTS, "日本語のテキスト" * 300])
    both = pieces.round_trip(docs)
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, pieces.decode(pieces.encode(docs)).collect()), key=str)
    assert pieces.round_trip(docs.limit(0)).count() == 0
    for df in (both, queries.op10_sentencepiece(spark, SF)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def slow_unigram(v, text):
    best = [(0.0, [])]
    for j in range(1, len(text) + 1):
        ways = []
        for k in range(1, min(v.longest, j) + 1):
            s = text[j - k : j]
            if s in v.ids or k == 1:
                ways.append((best[j - k][0] + (v.score[v.ids[s]] if s in v.ids else v.least), best[j - k][1] + [s]))
        best.append(max(ways, key=lambda w: w[0]))
    return best[-1]


def streamed(v, text, step=1):
    """(pieces, how many came before the end, the most places that waited)."""
    s, out, most = pieces.Stream(v), [], 0
    for i in range(0, len(text), step):
        out += s.feed(text[i : i + step])
        most = max(most, len(s.before))
    early = len(out)
    return out + s.finish(), early, most


def test_streaming_commits_early_and_stays_bounded():
    v = pieces.Vocabulary({s: i for i, s in enumerate(["a", "b", "ab", "ba", "aba", "bab", "▁"])}, dict(enumerate([-3.1, -3.3, -4.0, -4.2, -5.0, -5.7, -2.0])), merges=False)
    text = "".join(rng.choice("ab▁x") for _ in range(4000))
    out, early, most = streamed(v, text)
    score = sum(v.score[v.ids[p]] if p in v.ids else v.least for p in out)
    assert "".join(out) == text and abs(score - slow_unigram(v, text)[0]) < 1e-6
    assert most < 60 and early > len(out) - 60


def test_one_stream_over_whole_texts_of_the_public_model():
    """Without any cut: the ids are the library's, they come early, and few places wait."""
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    v = pieces.coder("piece_bpe_32k.model").v
    long = [" ".join(TEXTS[:300]), "".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "日本語のテキスト" * 2000, "aabab" * 3000, "ab " * 5000]
    for t in long:
        for step in (1, 1000):
            out, early, most = streamed(v, "▁" + t.replace(" ", "▁"), step)
            ids = [i for x in out for i in ([v.ids[x]] if x in v.ids else [v.byte_ids[b] for b in x.encode()])]
            assert ids == p.encode(t)
            assert early > len(out) - 6 * v.longest and most < 8 * v.longest
