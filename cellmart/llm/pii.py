"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns (emails, IP addresses, cards, phones) give the base spans, which always stay. The field's nodes are the base
spans and the mentions between them that might be personal data: numbers of seven digits or more, tokens with an @, and
words that are an email's local part. Each node has potentials from its shape; neighbours in the text share a chain
potential; mentions that repeat or resemble each other (the same digits, the same last digits, the same local part), however
far apart, share a skip potential. Loopy belief propagation gives marginals; a mention whose marginal of some kind reaches
ADD becomes a span. So a number that is a phone in one place is one in every place of the document.

The potentials are fitted piecewise on the nodes of all documents whose labels are known: base spans have their kind, and
mentions that resemble no base span, nor anything that does, are none. What a mention is that resembles a base span is what
the field is there to find, so it has no label in the fit. Both kinds of edges are learned from pairs of known labels.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmart.llm.common import rows_of, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
ADD = 0.5
ROUNDS = 20
NEAR = 40  # neighbours more characters apart share no chain potential

_MAY = re.compile("[0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Possessive, and never begun inside a run of digits: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[\x20().-]{0,3}[0-9]){6,}+")
_AT = re.compile(r"(?<![^\s@])[^\s@]*+@[^\s@]*+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9]")
_DIGITS = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From @ to @: an address begins where the run of local characters before its @ begins, or where the last address ended."""
    done = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = a < at and _DOMAIN.match(text, at)
        if m:
            yield a, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; end exclusive, in code points."""
    if not _MAY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


@dataclass
class Node:
    start: int
    end: int
    kind: int  # of LABELS; 0 for a mention that is no base span
    shape: np.ndarray
    keys: tuple[str, ...]


def _shape(s: str, before: str, after: str) -> np.ndarray:
    n = len(_DIGITS.findall(s))
    return np.array([1, "@" in s, "." in s.rpartition("@")[2] and "@" in s, s[:1] == "+" or before == "+", s.count(".") == 3, n >= 16, 8 <= n <= 15, n < 8, n > 19, " " in s or "-" in s, "(" in s, before.isalnum() or after.isalnum()], float)


def _keys(s: str) -> tuple[str, ...]:
    if "@" in s:
        return tuple(f"a:{x}" for x in (s.rpartition("@")[0].strip(".,;:()<>[]\"'").casefold(), s.strip(".,;:()<>[]\"'").casefold()) if len(x) > 3)
    d = "".join(_DIGITS.findall(s))
    if len(d) >= 7:
        return (f"d:{d}", f"s:{d[-7:]}")
    return (f"a:{s.strip('.,;:()<>[]').casefold()}",) if len(s) > 3 else ()


def nodes(text: str, base: list[tuple[str, int, int]]) -> list[Node]:
    """The field's nodes, in order of place. Base spans that overlap are separate nodes; mentions overlap none."""
    made = sorted((a, b, LABELS.index(k)) for k, a, b in base)
    gaps, at = [], 0
    for a, b, _ in made:
        if a > at:
            gaps.append((at, a))
        at = max(at, b)
    gaps.append((at, len(text)))
    names = {text[a:b].rpartition("@")[0].casefold() for k, a, b in base if k == "email"}
    # A local part counts as a repeated mention only if it could not be an ordinary word.
    names = {x for x in names if len(x) > 4 and re.search(r"[0-9._+-]", x)}
    for a, b in gaps:
        taken = 0
        found = [m.span() for p in (_AT, _NUMBER) for m in p.finditer(text, a, b) if len(m[0]) > 4]
        if names:
            found += [m.span() for m in _LOCAL_RUN.finditer(text, a, b) if m[0].casefold() in names]
        for x, y in sorted(found, key=lambda s: (s[0], -s[1])):
            if x >= taken:
                made.append((x, y, 0))
                taken = y
    return [Node(a, b, k, _shape(text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]), _keys(text[a:b])) for a, b, k in sorted(made)]


def edges(found: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours, skip edges from each mention to the next one that shares a key."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if 0 <= found[i + 1].start - found[i].end <= NEAR]
    last, skip = {}, set()
    for i, x in enumerate(found):
        for k in x.keys:
            if k in last and last[k] != i:
                skip.add((last[k], i))
            last[k] = i
    return chain, sorted(skip)


def known(found: list[Node], skip: list[tuple[int, int]]) -> list[bool]:
    """Whether each node's label is known: it is a base span, or no chain of skip edges leads from it to one."""
    root = list(range(len(found)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in skip:
        root[top(i)] = top(j)
    based = {top(i) for i, x in enumerate(found) if x.kind}
    return [bool(x.kind) or top(i) not in based for i, x in enumerate(found)]


def counted(found: list[Node]) -> tuple[list[Node], list[tuple[int, int]], list[tuple[int, int]]]:
    """The nodes of known labels, and the pairs of labels at both kinds of edges between them."""
    chain, skip = edges(found)
    sure = known(found, skip)
    pairs = ([(found[i].kind, found[j].kind) for i, j in some if sure[i] and sure[j]] for some in (chain, skip))
    return [x for x, ok in zip(found, sure, strict=True) if ok], *pairs


@dataclass
class Field:
    """Log potentials: of a shape (labels x shape), of neighbours and of resembling mentions (labels x labels)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, found: list[Node], rounds: int = ROUNDS) -> np.ndarray:
        """By loopy belief propagation; a base span is held to its kind."""
        n, k = len(found), len(LABELS)
        own = np.array([x.shape for x in found]) @ self.node.T
        for i, x in enumerate(found):
            if x.kind:
                own[i] = -50.0
                own[i, x.kind] = 0.0
        chain, skip = edges(found)
        pairs = np.array(chain + skip, int).reshape(-1, 2)
        if len(pairs):
            potential = np.concatenate([np.broadcast_to(self.chain, (len(chain), k, k)), np.broadcast_to(self.skip, (len(skip), k, k))])
            src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            table = np.concatenate([potential, potential.transpose(0, 2, 1)])  # by label of src, of dst
            back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
            message = np.zeros((len(src), k))
            for _ in range(rounds):
                belief = own.copy()
                np.add.at(belief, dst, message)
                out = np.logaddexp.reduce((belief[src] - message[back])[:, :, None] + table, axis=1)
                out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
                change = np.abs(out - message).max()
                message = 0.5 * message + 0.5 * out
                if change < 1e-4:
                    break
            own = own.copy()
            np.add.at(own, dst, message)
        return np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True)) if n else own

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans that the field adds; they overlap no base span."""
        if not base and not _MAY.search(text):
            return []
        found = nodes(text, base)
        if all(x.kind for x in found):
            return []
        p = self.marginals(found)
        best = p.argmax(axis=1)
        return [(LABELS[b], x.start, x.end) for x, b, q in zip(found, best, p, strict=True) if not x.kind and b and q[b] >= ADD]


def fit(shapes: np.ndarray, kinds: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300, weights: np.ndarray | None = None) -> Field:
    """Piecewise: a multinomial regression for the shapes, smoothed log odds of counted label pairs for the two kinds of edges.

    weights has how often each row of shapes and kinds occurs; once, where it is None."""
    k, d = len(LABELS), len(_shape("", "", ""))
    w = np.zeros((k, d))
    if len(kinds):
        y = np.eye(k)[kinds]
        share = np.ones(len(kinds)) if weights is None else np.asarray(weights, float)
        share = (share / share.sum())[:, None]
        for _ in range(steps):
            z = shapes @ w.T
            p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
            w += 1.0 * (((y - p) * share).T @ shapes - 1e-3 * w)

    def odds(count: np.ndarray) -> np.ndarray:
        joint = count + count.T + 1 / k**2  # one pair, spread over all cells
        joint /= joint.sum()
        return np.log(joint / np.outer(joint.sum(1), joint.sum(0)))

    return Field(w, odds(chain), odds(skip))


def train(docs: DataFrame) -> Field:
    """Fitted on the nodes of all documents; only shapes and label pairs with their counts come to the driver."""
    rows = docs.select(text_or_empty().alias("text")).where(F.col("text").rlike("[0-9@]"))
    k, d = len(LABELS), len(_shape("", "", ""))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 500):
            seen: dict[tuple, int] = defaultdict(int)
            chain, skip = np.zeros((k, k)), np.zeros((k, k))
            for t in b.column(0).to_pylist():
                found, *pairs = counted(nodes(t, base_spans(t)))
                for x in found:
                    seen[(x.kind, tuple(x.shape.astype(int).tolist()))] += 1
                for count, some in zip((chain, skip), pairs, strict=True):
                    for i, j in some:
                        count[i, j] += 1
            out = [("node", [key[0], *key[1]], n) for key, n in seen.items()]
            out += [(name, [i, j], int(m[i, j])) for name, m in (("chain", chain), ("skip", skip)) for i in range(k) for j in range(k) if m[i, j]]
            yield pa.RecordBatch.from_pydict({"what": [x[0] for x in out], "key": pa.array([x[1] for x in out], pa.list_(pa.int64())), "n": pa.array([x[2] for x in out], pa.int64())})

    got = rows.mapInArrow(work, "what string, key array<long>, n long").groupBy("what", "key").agg(F.sum("n").alias("n")).orderBy("what", "key").collect()
    chain, skip, shapes, kinds, weights = np.zeros((k, k)), np.zeros((k, k)), [], [], []
    for what, key, n in got:
        if what == "node":
            shapes.append(key[1:])
            kinds.append(key[0])
            weights.append(n)
        else:
            (chain if what == "chain" else skip)[key[0], key[1]] += n
    return fit(np.array(shapes, float).reshape(-1, d), np.array(kinds, int), chain, skip, weights=np.array(weights, float))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and these with what the field adds, in the same order."""
    base = base_spans(text)
    more = field.added(text, base)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of docs: doc_id, base (the patterns' spans, as kind:start:end, comma-joined), spans (all spans).

    docs needs doc_id and text; other columns are ignored. A null text is empty and has no spans. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_or_empty().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 500):
            found = [all_spans(t, field) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_joined(x) for x, _ in found], pa.string()), pa.array([_joined(x) for _, x in found], pa.string())], names=["doc_id", "base", "spans"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in capitals; of overlapping spans the union goes under the first one's name."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span of its texts masked; n_chars, where there is one, follows. Null texts stay null, empty ones empty.

    Each row of docs gives one row, repeated rows too, whatever its doc_id. An empty table gives an empty result.
    """
    names = [c.lower() for c in docs.columns]
    place = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 500):
            texts = b.column(place).to_pylist()
            new = [t and masked(t, all_spans(t, field)[1]) for t in texts]
            columns = list(b.columns)
            columns[place] = pa.array(new, b.schema.field(place).type)
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([len(y) if x != y else n for x, y, n in zip(texts, new, old, strict=True)], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(work, docs.schema)
