"""Base spans against the plain patterns, the field against exact inference, masking."""

import itertools
import random
import re

import numpy as np

from cellmart.llm import pii


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x@y", ".com", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111-1111 1111", "+33 6 12 34 56 78", "é", "\n", "٣", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "007.008.009.0000010"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.base_spans(t) == slow_base(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " (" * 150_000, "a@" * 100_000, "@" * 200_000, "1 " * 200_000):
        pii.base_spans(t)
        pii.nodes(t + " a@b.co", [("email", len(t) + 1, len(t) + 7)])


def exact_marginals(field, found):
    k, n = len(pii.LABELS), len(found)
    chain, skip = pii.edges(found)
    total = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        if any(x.kind and x.kind != l for x, l in zip(found, y)):
            continue
        s = sum(0 if x.kind else field.node[l] @ x.shape for x, l in zip(found, y))
        s += sum(field.chain[y[i], y[j]] for i, j in chain) + sum(field.skip[y[i], y[j]] for i, j in skip)
        for i, l in enumerate(y):
            total[i, l] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def sample_field():
    """Agreement is learned: base spans that come again, and numbers that come again and are none."""
    texts = ["mail joe.42@x.com or 42.1.2.3 now, joe.42@x.com, 42.1.2.3", "call +33 612345678 ok 123456789 and not +33 612345678", "card 4111111111111111 id 99887766 and 99887766, 4111111111111111"] * 20
    shapes, kinds, skip = [], [], np.zeros((len(pii.LABELS),) * 2)
    for t in texts:
        found, _, pairs = pii.counted(pii.nodes(t, pii.base_spans(t)))
        shapes += [x.shape for x in found]
        kinds += [x.kind for x in found]
        for i, j in pairs:
            skip[i, j] += 1
    return pii.fit(np.array(shapes), np.array(kinds), np.ones_like(skip), skip)


def test_skip_potential_is_learned():
    k = len(pii.LABELS)
    shapes, kinds = np.array([pii._shape("+33612345678", "", "")] * 2), np.array([4, 4])
    agree, differ = np.eye(k) * 50, np.ones((k, k)) * 50
    differ[4, 4] = 0
    assert pii.fit(shapes, kinds, agree, agree).skip[4, 4] > 1 > 0 > pii.fit(shapes, kinds, agree, differ).skip[4, 4]


def test_unknown_labels_take_no_part():
    t = "Call +33 612345678, later 0612345678 and 612345678; id 99887766, 99887766."
    found = pii.nodes(t, pii.base_spans(t))
    sure, chain, skip = pii.counted(found)
    assert [t[x.start : x.end] for x in sure] == ["+33 612345678", "99887766", "99887766"] and skip == [(0, 0)]


def test_field_adds_consistent_mentions_only():
    f = sample_field()
    t = "Call +33 612345678 today. Later 0612345678 again, not 55512345999. Joe is joe.42@x.com, so write joe.42 soon; word joe stays."
    base, spans = pii.all_spans(t, f)
    assert base == slow_base(t) and set(base) <= set(spans)
    assert [(k, t[a:b]) for k, a, b in spans if (k, a, b) not in base] == [("email", "joe.42"), ("phone", "0612345678")]
    found = pii.nodes(t, base)
    assert np.abs(f.marginals(found, 200) - exact_marginals(f, found)).max() < 0.05
    assert pii.masked(t, spans) == "Call [PHONE] today. Later [PHONE] again, not 55512345999. Joe is [EMAIL], so write [EMAIL] soon; word joe stays."


def test_find_and_mask(spark):
    rows = [(1, "x@y.com é", "en", 9), (2, None, "en", 0), (3, "", None, 0), (3, "", None, 0), (None, "1.2.3.4", "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    f = pii.train(docs)
    assert sorted((str(r.doc_id), r.base, r.spans) for r in pii.find(docs, f).collect()) == [("1", "email:0:7", "email:0:7"), ("2", "", ""), ("3", "", ""), ("3", "", ""), ("None", "ip:0:7", "ip:0:7")]
    got = pii.mask(docs, f).collect()
    assert [tuple(r) for r in got][0] == (1, "[EMAIL] é", "en", 9) and got[1].text is None and got[4].text == "[IP]" and got[4].n_chars == 4
    assert pii.find(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_mentions_without_a_base_span():
    f = sample_field()
    f.node[pii.LABELS.index("phone")] += 20
    base, spans = pii.all_spans("call 0612345678 or 0612345678", f)
    assert base == [] and spans == [("phone", 5, 15), ("phone", 19, 29)]
    assert pii.all_spans("no mention, 12 of them", f) == ([], [])


def test_counts_weigh_in_whole(spark):
    text = ", ".join(f"{i}" for i in range(10_000_000, 10_003_000)) + " a@b.co"
    docs = spark.createDataFrame([(1, text), (None, "mail x@y.com or 99887766"), (2, "+33 612345678")], "doc_id long, text string")
    shapes, kinds, chain, skip = [], [], np.zeros((5, 5)), np.zeros((5, 5))
    for _, t in docs.collect():
        found, *pairs = pii.counted(pii.nodes(t, pii.base_spans(t)))
        shapes += [x.shape for x in found]
        kinds += [x.kind for x in found]
        for count, some in zip((chain, skip), pairs):
            for i, j in some:
                count[i, j] += 1
    want, got = pii.fit(np.array(shapes), np.array(kinds), chain, skip), pii.train(docs)
    assert len(kinds) > 3000 and np.allclose(got.node, want.node) and np.allclose(got.chain, want.chain) and np.allclose(got.skip, want.skip)
