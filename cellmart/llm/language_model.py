"""Language-model scores from an n-gram trie in Elias-Fano levels.

Training counts words, then pairs, then triples over all training documents; every n-gram is kept. Words are known by 128-bit
hashes, whose ranks are the word ids. Levels, memory-mapped from the shared folder:
  1  sorted word hashes and counts
  2  pairs, as context * V + id (Elias-Fano), with monotone pointers from each context to its successors (Elias-Fano),
     quantised discounted probabilities and back-off weights
  3  triples, as place of the pair * R + rank, where rank is the last word's place among the successors of the word before
     it, so the ids are relative to the shorter context; the rest as in 2
A query goes to its context's part of a level and searches the successor there.

The probability is interpolated: p(c|ab) = d(ab,c) + b(ab) * p(c|b), p(c|b) = d(b,c) + b(b) * p(c), p(c) = (n(c) - D) / N, and
D * V / N for the one class of all unknown words. d is (n - DISCOUNT) / n(context), rounded down to one of 255 levels; b is
what the rounded d of a context leave of 1, so the probabilities after each context sum to 1.

A level is cut into shards, each a range of (context, successor) that holds about SHARD_TOKENS occurrences: many contexts, or,
where one context alone has more, a range of its successors. So no frequent word makes a large task. Between the passes the
texts live as ids; the n-grams of a batch travel as one sorted, delta-coded block for each shard, and meet there only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmart.llm.common import mapped, remove, rows_of, save_bytes, scratch_dir, text_or_empty
from cellmart.llm.elias_fano import Sequence, encode

DISCOUNT = 0.75
SHARD_TOKENS = 3_000_000
BATCH_TOKENS = 500_000
FOLDS, HELD_OUT = 7, 2
_LEVELS = 255
_FLOOR = 1e-9
_U = np.uint64


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(dictionary index of each token, dictionary, tokens of each text) of lower-cased words; the dictionary's last entry, '', is the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    owner = pc.list_parent_indices(lists).to_numpy()
    if not pc.all(some).as_py():
        flat, owner = flat.filter(some), owner[some.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    count = np.bincount(owner, minlength=len(texts)) + 1
    ends = np.cumsum(count) - 1
    index = np.full(int(count.sum()), len(coded.dictionary), np.int64)
    body = np.ones(len(index), bool)
    body[ends] = False
    index[body] = coded.indices.to_numpy()
    return index, coded.dictionary, count


def _hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit halves of each word's hash, in rows; the last row is the end's."""
    import xxhash

    return np.frombuffer(b"".join([*map(xxhash.xxh3_128_digest, words), xxhash.xxh3_128_digest(b"")]), ">u8").reshape(-1, 2).astype(np.uint64)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts: differences, byte by byte, compressed."""
    import zstandard

    step = np.diff(keys, prepend=_U(0))
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(keys), -1).T).tobytes() for a in (step, counts.astype("<u4"))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n = len(planes) // 12
    step = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(step, dtype=np.uint64), np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _sorted_pairs(c: np.ndarray, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, x, first) of the pairs (c, x) in order, repeats too; x is below width, and first marks the first of equal pairs."""
    if (int(c.max(initial=0)) + 1) * width < 1 << 63:
        key = np.sort(c * width + x)
        c, x = np.divmod(key, width)
    else:
        order = np.lexsort((x, c))
        c, x = c[order], x[order]
    first = np.ones(len(c), bool)
    first[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1])
    return c, x, np.flatnonzero(first)


def _quantised(p: np.ndarray) -> np.ndarray:
    """The level at or below p, from 1; 0 stands for less than _FLOOR."""
    step = -np.log(_FLOOR) / (_LEVELS - 1)
    return np.clip(np.floor(np.log(np.maximum(p, 1e-300)) / step + _LEVELS - 1) + 1, 0, _LEVELS).astype(np.uint8)


_VALUES = np.concatenate([[0.0], np.exp(-np.log(_FLOOR) / (_LEVELS - 1) * (np.arange(1, _LEVELS + 1) - _LEVELS))])
#: An even scale for the back-off weights, rounded down; 0 would forget everything unseen.
_WEIGHT = 65535.0


def _weights(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    left = 1 - np.bincount(owner, weights=values, minlength=n)
    return np.maximum(np.floor(left * _WEIGHT), 1).astype("<u2")


@dataclass(frozen=True, eq=False)
class Cuts:
    """A level's shards: shard s begins at (c[s], x[s]); first[s] n-grams come before it. Only contexts with more occurrences
    than a shard takes are cut at an x above 0; their back-off weights stand here."""

    name: str
    c: np.ndarray
    x: np.ndarray
    contexts: int
    width: int  # successors are below it
    first: np.ndarray | None = None
    split: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    fan: int = 1  # the most successors of a context
    large: dict[int, int] = field(default_factory=dict)  # occurrences of the n-grams that are too many for a shard of the next level

    def spans(self, s: int) -> tuple[int, int]:
        """The first context of a shard and how many it may hold, the next shard's first one among them."""
        c0 = int(self.c[s])
        return c0, (int(self.c[s + 1]) if s + 1 < len(self.c) else self.contexts) - c0 + 1

    def shard(self, c: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        """The shard of each (c, x), or of (c, 0)."""
        s = np.searchsorted(self.c, c, "right") - 1
        if len(self.split):
            low = np.searchsorted(self.c, c, "left")
            several = np.flatnonzero(self.x[s] > 0)
            if x is None:
                s[several] = low[several] - (self.x[low[several]] > 0)
            else:
                for at in np.unique(low[several]):  # a context that is split
                    here = several[low[several] == at]
                    s[here] = at - 1 + np.searchsorted(self.x[at : s[here[0]] + 1], x[here], "right")
        return s


@dataclass(frozen=True, eq=False)
class Shape:
    """What a task needs to open the model: where it lies, how many words each shard of words holds, and the levels."""

    at: str
    shard_bits: int
    first_id: np.ndarray  # of each shard of words, and the number of words
    tokens: int
    ones: int
    twos: int
    levels: tuple[Cuts, ...] = ()

    @property
    def words(self) -> int:
        return int(self.first_id[-1])

    @property
    def discount(self) -> float:
        n = self.ones + 2 * self.twos
        return min(0.99, max(0.01, self.ones / n)) if n else 0.5


def _groups(s: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """(shard, where) of an array of shards."""
    if not len(s):
        return
    step = np.diff(s)
    order = None
    if (step < 0).any():
        order = np.argsort(s.astype(np.int16) if s.max() < 1 << 15 else s, kind="stable")
        step = np.diff(s[order])
    edges = [0, *(np.flatnonzero(step) + 1).tolist(), len(s)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(s[a] if order is None else s[order[a]]), slice(a, b) if order is None else order[a:b]


class Level:
    """The memory-mapped shards of pairs or triples, opened when first asked for."""

    def __init__(self, at: str, cuts: Cuts):
        self.at, self.cuts, self.open = at, cuts, {}

    def _shard(self, s: int) -> tuple[Sequence, Sequence, np.ndarray, np.ndarray]:
        if s not in self.open:
            raw = mapped(f"{self.at}/{self.cuts.name}-{s}")
            _, contexts = self.cuts.spans(s)
            pointers = Sequence(raw)
            at = pointers.size + -pointers.size % 8
            keys = Sequence(raw[at:])
            at += keys.size + -keys.size % 8
            self.open[s] = pointers, keys, np.frombuffer(raw, "<u2", contexts, at), np.frombuffer(raw, "u1", keys.n, at + 2 * contexts)
        return self.open[s]

    def place(self, c: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The places of the n-grams (c, x), or -1; quickest in order."""
        out = np.full(len(c), -1, np.int64)
        for s, here in _groups(self.cuts.shard(c, x)):
            key = (c[here] - self.cuts.c[s]).astype(np.uint64) * _U(self.cuts.width) + x[here].astype(np.uint64)
            found = self._shard(s)[1].find(key)
            out[here] = np.where(found >= 0, found + self.cuts.first[s], -1)
        return out

    def start(self, c: np.ndarray) -> np.ndarray:
        """The place of each context's first successor."""
        out = np.zeros(len(c), np.int64)
        for s, here in _groups(self.cuts.shard(c)):
            out[here] = self._shard(s)[0].get(c[here] - self.cuts.c[s]).astype(np.int64) + self.cuts.first[s]
        return out

    def weight(self, c: np.ndarray) -> np.ndarray:
        """The back-off weight of each context."""
        out = np.ones(len(c))
        for s, here in _groups(self.cuts.shard(c)):
            out[here] = self._shard(s)[2][c[here] - self.cuts.c[s]] / _WEIGHT
        if len(self.cuts.split):
            at = np.minimum(np.searchsorted(self.cuts.split, c), len(self.cuts.split) - 1)
            out = np.where(self.cuts.split[at] == c, self.cuts.weight[at] / _WEIGHT, out)
        return out

    def value(self, place: np.ndarray) -> np.ndarray:
        """The discounted probability of the n-gram at each place."""
        out = np.zeros(len(place))
        for s, here in _groups(np.searchsorted(self.cuts.first, place, "right") - 1):
            out[here] = _VALUES[self._shard(s)[3][place[here] - self.cuts.first[s]]]
        return out


class Model:
    """The memory-mapped levels."""

    def __init__(self, shape: Shape):
        self.shape, self.open = shape, {}
        self.levels = [Level(shape.at, x) for x in shape.levels]
        self._end = int(self.ids(_hashes([]))[0])

    @property
    def end(self) -> int:
        return self._end

    def _words(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if s not in self.open:
            n = int(self.shape.first_id[s + 1] - self.shape.first_id[s])
            raw = mapped(f"{self.shape.at}/words-{s}") if n else b""
            self.open[s] = tuple(np.frombuffer(raw, "<u8", n, 8 * n * i) if n else np.zeros(0, "<u8") for i in range(3))
        return self.open[s]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids; the number of words for an unknown one."""
        out = np.full(len(hashes), self.shape.words, np.int64)
        one, two = hashes[:, 0], hashes[:, 1]
        bits = self.shape.shard_bits
        for s, here in _groups((one >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)):
            h1, h2, _ = self._words(s)
            here = np.arange(len(one))[here]
            at = np.searchsorted(h1, one[here])
            while len(here):  # again where the first halves are equal and the second ones aren't
                ok = at < len(h1)
                here, at = here[ok], at[ok]
                ok = h1[at] == one[here]
                here, at = here[ok], at[ok]
                hit = h2[at] == two[here]
                out[here[hit]] = at[hit] + self.shape.first_id[s]
                here, at = here[~hit], at[~hit] + 1
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        known = np.flatnonzero(ids < self.shape.words)
        for s, here in _groups(np.searchsorted(self.shape.first_id, ids[known], "right") - 1):
            out[known[here]] = self._words(s)[2][ids[known[here]] - self.shape.first_id[s]]
        return out

    def places(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, place of the pair of context and token) of each token; before a text's first token stands the end."""
        before = self.before(ids, starts)
        width = self.shape.words + 1
        if width * width < 1 << 63:
            key, back = np.unique(before * width + ids, return_inverse=True)
            a, b = np.divmod(key, width)
        else:
            key, back = np.unique(np.stack([before, ids], 1), axis=0, return_inverse=True)
            a, b = key[:, 0], key[:, 1]
        found = np.full(len(a), -1, np.int64)
        known = np.flatnonzero((a < self.shape.words) & (b < self.shape.words))
        found[known] = self.levels[0].place(a[known], b[known])
        return before, found[back.ravel()]

    def before(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty_like(ids)
        out[1:] = ids[:-1]
        out[starts] = self.end
        return out

    def triples(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, place of its pair with the token, place of the pair before or -1, rank of the token) of each token."""
        before, place = self.places(ids, starts)
        prior = np.full(len(ids), -1, np.int64)
        prior[1:] = place[:-1]
        prior[starts] = -1
        rank = np.full(len(ids), -1, np.int64)
        both = np.flatnonzero((prior >= 0) & (place >= 0))
        contexts, back = np.unique(before[both], return_inverse=True)
        rank[both] = place[both] - self.levels[0].start(contexts)[back]
        return before, place, prior, rank

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: log10 of the base's and of the model's probability, and whether it is known."""
        n = self.counts(ids)
        size, words = self.shape.tokens, self.shape.words
        base = np.log10((n + 1) / (size + 1 * (words + 1)))
        if not size:
            return base, np.zeros(len(ids)), n > 0
        p = np.where(n > 0, n - self.shape.discount, self.shape.discount * words) / size
        before, place, prior, rank = self.triples(ids, starts)
        known = np.flatnonzero(before < words)
        contexts, back = np.unique(before[known], return_inverse=True)
        p[known] *= self.levels[0].weight(contexts)[back]
        hit = np.flatnonzero(place >= 0)
        p[hit] += self.levels[0].value(place[hit])
        inner = np.flatnonzero(prior >= 0)
        p[inner] *= self.levels[1].weight(prior[inner])
        both = np.flatnonzero(rank >= 0)
        width = self.levels[1].cuts.width
        both = both[np.argsort(prior[both] * width + rank[both]) if self.levels[1].cuts.contexts * width < 1 << 63 else np.lexsort((rank[both], prior[both]))]
        found = self.levels[1].place(prior[both], rank[both])
        p[both[found >= 0]] += self.levels[1].value(found[found >= 0])
        return base, np.log10(p), n > 0


_open: dict[tuple[str, int], Model] = {}


def opened(shape: Shape) -> Model:
    """The worker's view of a model; the last one opened is kept."""
    key = (shape.at, len(shape.levels))
    if key not in _open:
        _open.clear()
        _open[key] = Model(shape)
    return _open[key]


def _counted_words(train: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 4000, 4 << 20):
            index, words, _ = _words(b.column(0))
            h = _hashes(words.cast(pa.binary()).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.bincount(index, minlength=len(words) + 1))], names=["h1", "h2", "n"])

    return train.select("text").mapInArrow(work, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _id_batches(batches: Iterator[pa.RecordBatch], column: int, words: int, size: int = BATCH_TOKENS) -> Iterator[tuple[list[tuple[pa.RecordBatch, int]], np.ndarray, np.ndarray]]:
    """Groups of documents: (rows as (batch, row), ids of all, where each begins). Every document has a token, the end."""
    group, parts, held = [], [], 0
    for b in batches:
        for i in range(b.num_rows):
            ids = np.frombuffer(b.column(column)[i].as_buffer(), "<u4" if words < 1 << 32 else "<u8")
            if held and held + len(ids) > size:
                yield group, np.concatenate(parts).astype(np.int64), np.cumsum([0, *map(len, parts[:-1])])
                group, parts, held = [], [], 0
            group.append((b, i))
            parts.append(ids)
            held += len(ids)
    if group:
        yield group, np.concatenate(parts).astype(np.int64), np.cumsum([0, *map(len, parts[:-1])])


def _cut(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, parts) where shards begin, by the contexts' occurrences: about most each, a larger context in parts of its own."""
    if not len(n):
        return np.zeros(1, np.int64), np.ones(1, np.int64)
    parts = np.maximum(1, -(-n // most))
    step = (np.cumsum(n) - n) // most
    begin = np.ones(len(n), bool)
    begin[1:] = (step[1:] != step[:-1]) | (parts[1:] > 1) | (parts[:-1] > 1)
    at = np.flatnonzero(begin)
    return at, parts[at]


def score(docs: DataFrame, discount: float = DISCOUNT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs needs doc_id and text; other columns are ignored. A null text is empty: the end alone. The documents with
    crc32(doc_id as text) mod 7 = 2 are held out of training; a null doc_id counts as the empty text. Repeated rows count as
    often as they stand. With nothing to train on, every token is unknown and has probability 1. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    at = scratch_dir(spark, "ngrams")
    rows = docs.select(F.col("doc_id").alias("doc_id"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT).alias("held_out"), text_or_empty().alias("text"))
    _counted_words(rows.where("not held_out")).write.parquet(f"{at}/counted")
    counted = spark.read.parquet(f"{at}/counted")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).first()
    bits = max(0, (max(1, -(-total.tokens // shard_tokens)) - 1).bit_length())
    shard = F.shiftrightunsigned("h1", 64 - bits).cast("int") if bits else F.lit(0)

    def words(key: tuple, g: pa.Table) -> pa.Table:
        h1, h2, n = (g.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2", "n"))
        order = np.lexsort((h2, h1))
        save_bytes(f"{at}/words-{key[0].as_py()}", [x[order].astype("<u8").tobytes() for x in (h1, h2, n)])
        where, parts = _cut(n[order].astype(np.int64), shard_tokens)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": [len(h1)], "at": [where.tolist()], "parts": [parts.tolist()]})

    found = {r.shard: r for r in counted.select(shard.alias("shard"), "h1", "h2", "n").groupBy("shard").applyInArrow(words, "shard int, n long, at array<long>, parts array<long>").collect()}  # a row a shard
    remove(spark, f"{at}/counted")
    first = np.concatenate([[0], np.cumsum([found[s].n if s in found else 0 for s in range(1 << bits)])]).astype(np.int64)
    shape = Shape(at, bits, first, total.tokens, total.ones, total.twos)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shape)
        kind = "<u4" if shape.words < 1 << 32 else "<u8"
        for b in rows_of(batches, 4000, 4 << 20):
            index, dictionary, count = _words(b.column(2))
            flat = memoryview(m.ids(_hashes(dictionary.cast(pa.binary()).to_pylist()))[index].astype(kind)).cast("B")
            stop = (np.cumsum(count) * np.dtype(kind).itemsize).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([flat[x:y] for x, y in zip([0, *stop], stop, strict=False)], pa.binary())], names=["doc_id", "held_out", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows.mapInArrow(ids, f"doc_id {kind}, held_out boolean, ids binary").write.option("compression", "zstd").parquet(f"{at}/ids")
    coded = spark.read.parquet(f"{at}/ids")
    if total.tokens:
        cuts = [(int(first[s]) + c, j, k, shape.words) for s, r in sorted(found.items()) for c, k in zip(r.at, r.parts, strict=True) for j in range(k)]
        shape, more = _with_level(coded, shape, "pairs", cuts, shape.words, shape.words, discount, shard_tokens)
        # A split pair's successors are the ranks among those of its last word.
        pairs = opened(shape).levels[0]
        last = np.array([b for _, k, b in more if k > 1], np.int64)
        fan = dict(zip(last.tolist(), (pairs.start(last + 1) - pairs.start(last)).tolist(), strict=True)) if len(last) else {}
        cuts = [(c, j, k, fan.get(b, 1)) for c, k, b in more for j in range(k)]
        shape, _ = _with_level(coded, shape, "triples", cuts, int(pairs.cuts.first[-1]), pairs.cuts.fan, discount, shard_tokens)
    tokens, final = total.tokens, shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(final)
        for group, x, starts in _id_batches(batches, 2, final.words):
            base, full, known = m.scores(x, starts)
            size = np.diff(starts, append=len(x))
            columns = [pa.concat_arrays([b.column(c).slice(i, 1) for b, i in group]) for c in (0, 1)]
            sums = [np.add.reduceat(v, starts) for v in (known.astype(np.int64), base, full)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(group), tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _with_level(coded: DataFrame, shape: Shape, name: str, cuts: list[tuple[int, int, int, int]], contexts: int, width: int, discount: float, shard_tokens: int) -> tuple[Shape, list[tuple[int, int, int]]]:
    """Counts the n-grams of the training documents, writes the level's shards, and says where the next level's may begin.

    cuts: (context, part, parts, successors) in order of contexts: the shard begins at that part of the context's successors.
    Returned cuts are (place, parts, successor).
    """
    c, x = np.array([t[0] for t in cuts], np.int64), np.array([t[1] * t[3] // t[2] for t in cuts], np.int64)
    new = np.array([t[1] == 0 for t in cuts], bool)
    new[1:] |= (x[1:] > 0) & (x[1:] != x[:-1])  # a context of few successors has fewer parts
    c, x = c[new], x[new]
    if not len(c) or c[0] or x[0]:
        c, x = np.concatenate([[0], c]), np.concatenate([[0], x])
    level = Cuts(name, c, x, contexts, width, split=np.unique(c[x > 0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shape)
        for _, ids, starts in _id_batches(batches, 0, shape.words):
            if shape.levels:
                _, _, prior, rank = m.triples(ids, starts)
                use = np.flatnonzero(rank >= 0)
                a, b = prior[use], rank[use]
            else:
                a, b = m.before(ids, starts), ids
            a, b, first = _sorted_pairs(a, b, width)
            n = np.diff(first, append=len(a))
            a, b = a[first], b[first]
            out = []
            for s, here in _groups(level.shard(a, b)):
                out.append((s, _pack((a[here] - c[s]).astype(np.uint64) * _U(width) + b[here].astype(np.uint64), n[here])))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([r for _, r in out], pa.binary())], names=["shard", "block"])

    def build(key: tuple, g: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        wait, held = [], 0
        blocks = g.column("block")
        for i in range(len(blocks) + 1):
            if i < len(blocks):
                wait.append(_unpack(blocks[i].as_buffer()))
                held += len(wait[-1][0])
            if wait and (i == len(blocks) or held > 1_000_000):
                keys, n = _merged(np.concatenate([keys, *(k for k, _ in wait)]), np.concatenate([n, *(k for _, k in wait)]))
                wait, held = [], 0
        c0, size = level.spans(s)
        own, last = np.divmod(keys, _U(width))
        own, last = own.astype(np.int64), last.astype(np.int64)
        total = np.bincount(own, weights=n, minlength=size)
        parts = [i for i in sorted({0, size - 1}) if c0 + i in split]
        for i in parts:
            total[i] = split[c0 + i]
        d = _quantised((n - discount) / total[own])
        fan = np.bincount(own, minlength=size)
        sums = np.bincount(own, weights=_VALUES[d], minlength=size)
        weights = np.maximum(np.floor((1 - sums) * _WEIGHT), 1).astype("<u2")
        pointers = np.concatenate([[0], np.cumsum(fan)]).astype(np.uint64)
        save_bytes(f"{shape.at}/{name}-{s}", [encode(pointers, len(keys) + 1), encode(keys, size * width), weights.tobytes(), d.tobytes()])
        at, k = _cut(n, shard_tokens)
        return pa.table({
            "shard": pa.array([s], pa.int32()), "n": [len(keys)], "fan": [int(fan.max(initial=0))], "split": pa.array([[c0 + i for i in parts]], pa.list_(pa.int64())), "sums": pa.array([[float(sums[i]) for i in parts]], pa.list_(pa.float64())),
            "fans": pa.array([[int(fan[i]) for i in parts]], pa.list_(pa.int64())), "at": [at.tolist()], "parts": [k.tolist()], "successor": pa.array([last[at].tolist() if len(last) else [0]], pa.list_(pa.int64())),
            "held": pa.array([n[at].tolist() if len(n) else [0]], pa.list_(pa.int64())),
        })

    # The occurrences of the few contexts that lie in several shards.
    split = {}
    if len(level.split):
        m = opened(shape)
        split = dict(zip(level.split.tolist(), (m.counts(level.split) if not shape.levels else [shape.levels[0].large[p] for p in level.split.tolist()]), strict=True))
    counted = coded.where("not held_out").select("ids").mapInArrow(count, "shard int, block binary")
    kind = "shard int, n long, fan long, split array<long>, sums array<double>, fans array<long>, at array<long>, parts array<long>, successor array<long>, held array<long>"
    found = {r.shard: r for r in counted.groupBy("shard").applyInArrow(build, kind).collect()}  # a row a shard
    first = np.concatenate([[0], np.cumsum([found[s].n if s in found else 0 for s in range(len(c))])]).astype(np.int64)
    for s in range(len(c)):
        if s not in found:
            _, size = level.spans(s)
            save_bytes(f"{shape.at}/{name}-{s}", [encode(np.zeros(size + 1, np.uint64), 1), encode(np.zeros(0, np.uint64), 1), np.full(size, _WEIGHT, "<u2").tobytes()])
    sums, fans = dict.fromkeys(split, 0.0), dict.fromkeys(split, 0)
    for r in found.values():
        for i, v, f in zip(r.split, r.sums, r.fans, strict=True):
            sums[i] += v
            fans[i] += f
    weight = np.array([max(1, int((1 - sums[i]) * _WEIGHT)) for i in level.split.tolist()], np.int64)
    cuts = [(int(first[s]) + i, k, b, n) for s, r in sorted(found.items()) if r.n for i, k, b, n in zip(r.at, r.parts, r.successor, r.held, strict=True)]
    level = replace(level, first=first, weight=weight, fan=max([1, *(r.fan for r in found.values()), *fans.values()]), large={p: n for p, k, _, n in cuts if k > 1})
    return replace(shape, levels=(*shape.levels, level)), [t[:3] for t in cuts]
