"""SimHash components, exact duplicates and line deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from cellmart.llm import exact_dedup, line_dedup, simhash

DOCS = "doc_id long, text string, kept string, fp int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))}


TEXTS = ["", None, " \t", "one", "A b C d", "a b c d e f g", "Ünï ß Ä ä x", "word " * 5000, "a" * 100_000, "x\ny\x0bz w"]


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t or "") % 2**64 == slow_fingerprint(t)


def test_components_of_near_copies(spark):
    rng = random.Random(1)
    texts = list(TEXTS)
    for _ in range(6):
        base = [rng.choice("the of and to in that is was for on".split()) + str(rng.randrange(500)) for _ in range(120)]
        for _ in range(8):
            w = list(base)
            w[rng.randrange(120)] = "changed"
            texts.append(" ".join(w))
        texts.append(" ".join(base))
    ids = [i * 3 for i in range(len(texts))]
    docs = frame(spark, list(zip(ids, texts)))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(ids, fps)
    assert got == {i: (f, want[i]) for i, f in zip(ids, fps)}
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values())) and kept[0].__fields__ == ["doc_id", "text", "kept", "fp"]


def test_dense_buckets(spark, monkeypatch):
    """Thousands of fingerprints around one centre and chains that leave it: the dense path links as all pairs would."""
    monkeypatch.setattr(simhash, "LIGHT", 8)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = random.Random(2)
    fps = {0}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f, 1) for f in signed], "fp long, n long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(table)).collect()}
    want = slow_components(signed, fps)
    assert {f: roots.get(f, f) for f in signed} == want


def test_spanning_forest():
    near = np.array([1, 2, 4, 1 << 40], np.uint64)
    edges = simhash.spanning(np.array([3], np.uint64), near, 4)
    assert sorted((int(a), int(b)) for a, b in edges) == [(3, 1), (3, 2), (3, 4), (3, 1 << 40)]
    assert simhash.spanning(np.array([], np.uint64), near, 4) == []


def test_near_stage_links_by_simhash_blocks(spark, monkeypatch):
    """Without the bands' keys, similar() links what lies within MAX_BITS, and only where the sets are similar enough."""
    monkeypatch.setattr(simhash, "bands", lambda found, mixers: ([], []))
    rng = random.Random(5)
    texts = ["", None, "one two"]
    for _ in range(8):
        base = [rng.choice("the of and to in that".split()) + str(rng.randrange(900)) for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(4):
            w = list(base)
            w[rng.randrange(400)] = "changed"
            texts.append(" ".join(w))
    docs = frame(spark, list(enumerate(texts)))
    sets = [simhash.shingles(t or "", 5) for t in texts]
    fps = [simhash.set_fingerprint(x) % 2**64 for x in sets]
    assert fps[3:] == [simhash.fingerprint(t, 5) % 2**64 for t in texts[3:]] and fps[0] == 0
    want = slow_components(list(range(len(texts))), fps)
    assert len(set(want.values())) < len(texts) - 8  # the blocks have links to find
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == want
    kept = {r.component_id for r in simhash.similar(docs, least=0.999).collect()}
    assert len(kept) == len({x.tobytes() for x in sets})  # equal sets only


def test_near_duplicates_edge_rows(spark):
    docs = frame(spark, [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "")])
    rows = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert len(simhash.drop_near_duplicates(docs).collect()) == 2


def test_rows_of_one_doc_id_and_of_none_are_told_apart_by_text(spark):
    """Each function keeps one row of each different text, and nothing else, whatever the ids."""
    words = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue cyan black white grey", "north south east west up down left"]
    a, b, c, d = words
    docs = frame(spark, [(7, a), (7, b), (None, c), (None, d), (None, c), (7, a), (3, b), (9, None), (None, "")])
    want = [(3, b), (7, a), (9, None), (None, c), (None, d)]
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, simhash.drop_similar):
        assert sorted(((r.doc_id, r.text) for r in drop(docs).collect()), key=str) == sorted(want, key=str), drop
    marked = exact_dedup.exact_duplicates(docs).where("kept").select("doc_id", "text_sha256").collect()
    assert sorted(map(tuple, marked), key=str) == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in want), key=str)


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x", 7), (2, "a b c d e f", 6, "y", 8), (2, "other words", 6, "y", 8)], "doc_id long, text string, h1 int, first string, _key int")
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, simhash.drop_similar):
        assert sorted(map(tuple, drop(docs).collect())) == [(1, "a b c d e f", 5, "x", 7), (2, "other words", 6, "y", 8)]


def test_blocks_grow_with_the_corpus():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [6, 6, 7, 8, 9]


def test_dense_buckets_of_similar_texts(spark, monkeypatch):
    """Buckets over LIGHT: chains whose ends are far apart link as all pairs would, and texts with a common passage don't."""
    monkeypatch.setattr(simhash, "LIGHT", 4)
    rng, texts = random.Random(9), []
    passage = [f"p{i}" for i in range(60)]
    for k in range(12):
        w = passage + [f"q{k}-{i}" for i in range(40)]
        for _ in range(6):
            texts.append(" ".join(w))
            for i in rng.sample(range(60, 100), 2):
                w[i] = f"r{rng.randrange(10**6)}"
    sets, root = [slow_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: root.index(r) for i, r in enumerate(root)} and 12 <= len(set(root)) < len(texts)


def test_exact_duplicates(spark):
    long = "ab " * 3000
    texts = [(5, "a  b"), (3, "a\t\nb"), (4, " a b"), (9, long), (8, long + " "), (10, long.replace(" ", "\n")), (1, None), (2, ""), (7, "x" * 50), (6, "x" * 50), (6, "x" * 50), (None, "a b")]
    got = exact_dedup.exact_duplicates(frame(spark, texts), block_bytes=16).collect()
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in texts]
    want = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        keep = min(j for j in same if j is not None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    want[10] = (*want[10][:3], False, want[10][4])
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    kept = exact_dedup.drop_exact_duplicates(frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4, 6, 8] and kept[0].__fields__ == ["doc_id", "text", "kept", "fp"]


def test_exact_duplicates_empty_and_null(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    (a, b) = exact_dedup.exact_duplicates(frame(spark, [(None, "x"), (None, "x")])).collect()
    assert (a.keep_id, a.group_size, a.kept + b.kept) == (None, 2, 1)


def test_exact_duplicates_normalise_a_text_once_a_pass(spark, monkeypatch):
    """No plan holds the pattern twice: in a filter inferred for the explode it would run once for each block of the text."""
    plans, real = [], exact_dedup.written

    def seen(df, tag):
        plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")))
        return real(df, tag)

    monkeypatch.setattr(exact_dedup, "written", seen)
    docs = frame(spark, [(1, "ab  c " * 9), (2, "ab c " * 9), (3, None)])
    got = sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_duplicates(docs, block_bytes=16).collect())
    assert got == [(1, 1), (2, 1), (3, 3)]
    assert plans[:2] == [("blocks", 1), ("level", 1)] and max(n for _, n in plans) == 1


def slow_lines(texts, min_chars=20, min_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda s: s.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(low)
    held = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and i != max(held[key(x)], key=lambda v: (v is not None, v or 0)))]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def test_lines(spark):
    a, b = "This line stands in many documents", "Another line, quite as common as that"
    texts = [(1, f"{a}\nown\n{b}"), (2, f"  {a.upper()} \n{a}"), (3, f"{b}\n{b}\nü"), (4, f"{a}\n{b}\n{a}"), (5, None), (6, ""), (7, f"short\n\n{a}x"), (8, "\n"), (9, f"{a}\t\x0b"), (9, f"{a}\t\x0b"), (None, f"q\n{a}"), (12, "x" * 200_000)]
    got = line_dedup.dedup_lines(frame(spark, texts)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, slow_lines(texts)))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def slow_shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_drops_pairs_at_jaccard_0_8(spark):
    rng, texts = random.Random(5), ["", " ", None, "a B c", "A b c", "a b d"]
    for n in (80, 200, 600):
        for _ in range(4):
            base = [f"w{rng.randrange(3000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for changed in (1, n // 60, n // 45, n // 20):
                w = list(base)
                for i in rng.sample(range(n), changed):
                    w[i] = "changed"
                texts.append(" ".join(w))
    sets, root = [slow_shingles(t) for t in texts], list(range(len(texts)))
    bits = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) / len(a | b) if a | b else 1) >= 0.8:
                bits.append((slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[j])).bit_count())
                root = [root[j] if r == root[i] else r for r in root]
    assert max(bits) > simhash.MAX_BITS
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    docs = frame(spark, list(enumerate(texts)))
    assert {r.doc_id for r in simhash.drop_similar(docs).collect()} == set(first.values())
    assert simhash.drop_similar(docs.limit(0)).count() == 0
