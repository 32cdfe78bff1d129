"""SimHash near-deduplication: pigeonhole blocks, verified Hamming distance, connected components.

A fingerprint's 64 bits are cut into BLOCKS blocks. Two fingerprints at MAX_BITS or fewer differing bits share at least
BLOCKS - MAX_BITS whole blocks, so each choice of that many blocks is a table, and close pairs meet in a bucket of some
table. With 6 blocks a key has about 21 bits in 15 tables; there are more blocks where there are so many fingerprints that
buckets of unrelated ones would not stay small (8 blocks: 70 tables of 32 bits).

Exact copies fold into one fingerprint first. Buckets of up to LIGHT fingerprints compare all their pairs; a denser bucket
first links what lies near its most frequent fingerprint, and only the rest is compared, chunk by chunk, each chunk pair
giving a spanning forest and not its pairs. Nothing is capped: every link between two fingerprints is kept up to
connectivity.

The pipeline drops near copies at a Jaccard similarity of NEAR_JACCARD or more of five-word shingles. Its links come first from
the same steps, on fingerprints of the sets: pigeonhole blocks, verified Hamming distance, and then the sets themselves. Most pairs
at 0.8 lie more than MAX_BITS bits apart; for those, candidates share one of BANDS keys of BAND_ROWS least hashes (a pair at
0.8 shares no key with a chance of about 1.3e-7). Every link is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmart.llm.common import hash128, rows_of, text_or_empty, written

MAX_BITS = 4
BLOCKS = 6
LIGHT = 64
CHUNK = 2048
WORDS = 4
SEED = 42
NEAR_WORDS = 5
NEAR_JACCARD = 0.8
BANDS = 40
BAND_ROWS = 5
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The text's SimHash as a signed 64-bit integer; 0 without words."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    flat = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.cumsum(size + 1) - size - 1
    k = min(words, len(w))
    begin, stop = start[: len(w) - k + 1], (start + size)[k - 1 :]
    n, ones, digest = len(begin), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 17):
        pairs = zip(begin[at : at + (1 << 17)].tolist(), stop[at : at + (1 << 17)].tolist(), strict=True)
        h = np.array([digest(flat[a:b], seed) for a, b in pairs], np.uint64)
        ones += _ones(h)
    return _majority(ones, n)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, text): a row is told from others of its doc_id, or of none, by its text's 128-bit hash. Null texts are empty."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_or_empty().alias("text"))
    return rows.select("doc_id", *hash128(F.col("text"), 11), "text")


def _first() -> Column:
    """The row that stands for a group: of the smallest doc_id, a null one last; of equal doc_ids the smaller hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2"))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, h1, h2, fp) of each row of docs; a null text has no words."""
    rows = _texts(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1000):
            fp = pa.array([fingerprint(t, words) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], fp], names=["doc_id", "h1", "h2", "fp"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long, fp long")


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """How many blocks: the fewest, but BLOCKS, by whose keys n unrelated fingerprints fill buckets of LIGHT / 2 at most."""
    blocks = max(BLOCKS, max_bits + 1)
    while blocks < 64 and n > LIGHT / 2 * 2 ** (64 * (blocks - max_bits) / blocks):
        blocks += 1
    return blocks


def _masks(blocks: int, max_bits: int) -> list[int]:
    """For each choice of blocks - max_bits blocks the mask of their bits, as signed 64-bit integers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(one[i] for i in c) for c in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b), a > b, between fingerprints of fps (fp long, n long; distinct) that connect all that lie within max_bits."""
    masks = _masks(blocks, max_bits)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", "n", F.explode(keys).alias("x")).select("x.t", "x.k", "fp", "n")
    buckets = written(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    light = keyed.join(buckets.where(F.col("m") <= LIGHT), ["t", "k"]).groupBy("t", "k").agg(F.sort_array(F.collect_list("fp")).alias("f"))
    near = F.flatten(F.transform("f", lambda a, i: F.transform(F.filter(F.slice(F.col("f"), 1, i), lambda b: _distance(a, b) <= max_bits), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    edges = light.select(F.explode(near).alias("e")).select("e.a", "e.b")
    dense = buckets.where(F.col("m") > LIGHT)
    if not dense.isEmpty():
        inside = written(keyed.join(dense, ["t", "k"]), "dense")
        hubs = written(inside.groupBy("t", "k").agg(F.max_by("fp", F.struct("n", "fp")).alias("hub")), "hubs")
        inside = inside.join(hubs, ["t", "k"]).withColumn("far", _distance(F.col("fp"), F.col("hub")) > max_bits)
        edges = edges.unionByName(inside.where(~F.col("far") & (F.col("fp") != F.col("hub"))).select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")))
        rest = written(inside.where("far").groupBy("t", "k").agg(F.count(F.lit(1)).alias("r")), "rest")
        inside = inside.join(rest, ["t", "k"])
        chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
        mine = lambda n: F.pmod(F.xxhash64("fp"), chunks(n).cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
        left = inside.where("far").select("t", "k", mine("r").alias("i"), every("m").alias("j"), F.lit(True).alias("far"), "fp")
        right = inside.select("t", "k", every("r").alias("i"), mine("m").alias("j"), F.lit(False).alias("far"), "fp")

        def compare(g: pa.Table) -> pa.Table:
            far, fp = g.column("far").to_numpy(), g.column("fp").to_numpy().view(np.uint64)
            e = np.array(spanning(fp[far], fp[~far], max_bits), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.table({"a": e.max(axis=1) if len(e) else e[:, 0], "b": e.min(axis=1) if len(e) else e[:, 1]})

        edges = edges.unionByName(left.unionByName(right).groupBy("t", "k", "i", "j").applyInArrow(compare, "a long, b long"))
    return edges.distinct()


def spanning(rest: np.ndarray, near: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A forest of links: it connects two of the fingerprints just if links between rest and near do."""
    near = np.unique(near)
    owner = np.full(len(near), -1)  # the tree of each of near that has a link so far
    out, trees = [], 0
    for x in np.unique(rest):
        hit = np.flatnonzero((np.bitwise_count(near ^ x) <= max_bits) & (near != x))
        if not len(hit):
            continue
        fresh = hit[owner[hit] < 0]
        out += [(x, y) for y in near[fresh]]
        old, first = np.unique(owner[hit[owner[hit] >= 0]], return_index=True)
        out += [(x, y) for y in near[hit[owner[hit] >= 0]][first]]
        owner[fresh] = trees
        if len(old):
            owner[np.isin(owner, old)] = trees
        trees += 1
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each edge's ends with the smallest node that they reach. Large-star and small-star steps until nothing changes."""
    state = None
    edges = written(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(written(low, "low"), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = written(large, "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.greatest("b", "low").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(small.where("a > b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _near(docs: DataFrame, max_bits: int, blocks: int | None) -> DataFrame:
    """(doc_id, h1, h2, fp, first): first is the row that stands for the component."""
    rows = written(fingerprints(docs), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), _first().alias("least")), "distinct")
    roots = components(links(fps.select("fp", "n"), max_bits, blocks or blocks_for(fps.count(), max_bits)))
    of = written(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    # Written, so that both sides of the join are plain exchanges, which adaptive execution may split where a component is hot.
    first = written(of.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    of = written(of.join(first, "root").select("fp", "first"), "components")
    return rows.join(of, "fp").select("doc_id", "h1", "h2", "fp", "first")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed), component_id (smallest doc_id reachable through links).

    docs needs doc_id and text; other columns are ignored. Null and wordless texts have fingerprint 0, which links like any
    other. Null doc_ids are no component's smallest unless it has no other. Repeated rows give repeated rows. An empty table
    gives an empty result. blocks: by the number of fingerprints, if not given.
    """
    return _near(docs, max_bits, blocks).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def shingles(text: str, words: int) -> np.ndarray:
    """The XXH64 of the text's distinct word shingles, sorted; a shorter text is one shingle, a wordless one has none."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    flat = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.cumsum(size + 1) - size - 1
    k, digest = min(words, len(w)), xxhash.xxh64_intdigest
    pairs = zip(start[: len(w) - k + 1].tolist(), (start + size)[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(flat[a:b], SEED) for a, b in pairs), np.uint64, len(w) - k + 1))


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed 64-bit integer; 0 without shingles."""
    return _majority(sum((_ones(found[at : at + (1 << 17)]) for at in range(0, len(found), 1 << 17)), np.zeros(64, np.int64)), len(found))


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return tuple(rng.integers(1 << 32, size=(BANDS * BAND_ROWS, 1), dtype=np.uint32) | np.uint32(odd) for odd in (1, 0))


def bands(found: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> tuple[list[int], list[int]]:
    """One key a band, of the BAND_ROWS least mixed hashes, and the low bytes of all, eight in an integer; none without shingles."""
    import xxhash

    if not len(found):
        return [], []
    a, b = mixers
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    h = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(h), 1024):
        x = (h[at : at + 1024] ^ b) * a
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        np.minimum(low, x.min(axis=1), out=low)
    keys = [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(low.reshape(BANDS, BAND_ROWS))]
    return keys, np.ascontiguousarray(low.astype(np.uint8)).view("<i8").tolist()


def _most_differing(least: float) -> int:
    """As many of the least hashes of two sets of that similarity differ at most, but for a chance of about 1e-5."""
    n = BANDS * BAND_ROWS
    return int(n * (1 - least) + 4.3 * (n * least * (1 - least)) ** 0.5) + 1


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b; distinct) whose sets have that Jaccard similarity."""
    a, b = (sets.select(F.col("id").alias(n), F.col("s").alias(f"s_{n}")) for n in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    pairs = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("s_a") + F.size("s_b")).alias("sum"))
    return pairs.where(F.col("both") / (F.col("sum") - F.col("both")) >= least).select("a", "b")


def _similar(docs: DataFrame, words: int, least: float) -> DataFrame:
    """(doc_id, h1, h2, first): first is the row that stands for the component."""
    rows = _texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        mixers = _mixers()
        for b in rows_of(batches, 1000):
            found = [shingles(t, words) for t in b.column(3).to_pylist()]
            node, size = [xxhash.xxh3_128_digest(x.tobytes()) for x in found], [len(x) for x in found]
            marks = [bands(x, mixers) for x in found]
            keys, low = (pa.array(list(x), pa.list_(pa.int64())) for x in zip(*marks, strict=True))
            fp = pa.array(map(set_fingerprint, found), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(node, pa.binary()), pa.array(size, pa.int64()), fp, keys, low], names=["doc_id", "h1", "h2", "node", "size", "fp", "keys", "low"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1000, 1 << 20):
            found = [shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "s"])

    marked = written(rows.mapInArrow(signed, f"doc_id {kind}, h1 long, h2 long, node binary, size long, fp long, keys array<long>, low array<long>"), "signatures")
    nodes = marked.groupBy("node").agg(_first().alias("least"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("low").alias("low"), F.first("fp").alias("fp"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    close = written(_close(nodes), "close")
    keyed = nodes.select("id", F.explode("keys").alias("k"))
    buckets = written(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    member = written(keyed.join(buckets, "k").select("k", "id", "m"), "members")
    # The hub of a bucket is its node of most company in all buckets: of a group of near copies, that is the one in the middle.
    company = written(member.groupBy("id").agg(F.sum("m").alias("company")), "company")
    hubs = written(member.join(company, "id").groupBy("k").agg(F.max_by("id", F.struct("company", "id")).alias("hub")), "hubs")
    # Sets are made of candidates only, from the text of the row that stands for each.
    met = member.select("id").unionByName(close.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    some = nodes.join(met, "id", "left_semi").select("id", *[F.col(f"least.{c}").alias(f"l_{c}") for c in ("doc_id", "h1", "h2")])
    some = written(some, "candidates")
    text = rows.join(some, F.col("doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("h1") == F.col("l_h1")) & (F.col("h2") == F.col("l_h2")))
    sets = written(text.select("id", "text").mapInArrow(listed, "id long, s array<long>").groupBy("id").agg(F.first("s").alias("s")), "sets")
    ordered = lambda x, y: [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]
    pairs = close.unionByName(member.join(hubs, "k").where("id <> hub").select(*ordered("id", "hub"))).distinct()
    edges = written(_verified(pairs, sets, least), "links")
    roots = written(components(edges), "roots")
    member = member.join(roots, member["id"] == roots["node"], "left").select("k", "m", "id", F.coalesce("root", "id").alias("root"))
    apart = written(member.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("m").alias("m")).where("x <> y").select("k", "m"), "apart")
    member = member.drop("m").join(apart, "k").join(nodes.select("id", "size", "keys", "low"), "id")
    for part, found in ((written(member.where(F.col("m") <= LIGHT), "light"), _few), (written(member.where(F.col("m") > LIGHT), "dense"), _many)):
        if not part.isEmpty():
            # Nodes outside a bucket's largest component meet all others; those inside it needn't meet one another.
            major = part.groupBy("k", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max_by("root", F.struct("n", "root")).alias("major"), (F.sum("n") - F.max("n")).alias("out"))
            edges = edges.unionByName(written(found(part.join(written(major, "major"), "k"), sets, least), "links"))
    roots = written(components(edges), "roots")
    of = written(nodes.join(roots, nodes["id"] == roots["node"], "left").select(nodes["node"], "least", F.coalesce("root", "id").alias("root")), "of")
    first = written(of.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    of = of.join(first, "root").select("node", "first")
    return marked.select("doc_id", "h1", "h2", "node").join(of, "node").select("doc_id", "h1", "h2", "first")


def _close(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (id, fp), a > b: of each fingerprint the first node with its others, and with those that links() finds."""
    fps = written(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")), "distinct")
    found = links(fps.select("fp", "n"), MAX_BITS, blocks_for(fps.count()))
    a, b = (fps.select(F.col("fp").alias(n), F.col("head").alias(f"head_{n}")) for n in "ab")
    met = found.join(a, "a").join(b, "b").select(F.greatest("head_a", "head_b").alias("a"), F.least("head_a", "head_b").alias("b"))
    same = nodes.join(fps.where("n > 1"), "fp").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    return met.unionByName(same)


def _few(part: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links in small buckets, each pair looked at in the first bucket that it shares."""
    mine = part.where("root <> major").select("k", *[F.col(c).alias(f"my_{c}") for c in ("id", "size", "root", "keys")])
    near = F.least("size", "my_size") >= least * F.greatest("size", "my_size")  # else the similarity can't be reached
    once = F.get(F.array_intersect("my_keys", "keys"), F.lit(0)) == F.col("k")
    pairs = mine.join(part, "k").where("my_root <> root and (root = major or my_id > id)").where(near).where(once)
    return _verified(pairs.select(F.greatest("id", "my_id").alias("a"), F.least("id", "my_id").alias("b")), sets, least)


def _many(part: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links in large buckets, chunk by chunk: of each node outside the largest component one to each other component it touches.

    The least hashes rule out pairs that are far apart before sets are compared; of pairs at NEAR_JACCARD they lose about one
    in 1e5, of more similar ones far fewer.
    """
    part = part.join(sets, "id").select("k", "id", "size", "root", "keys", "low", "s", "major", "m", "out")
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("id"), chunks(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    left = part.where("root <> major").select("*", mine("out").alias("i"), every("m").alias("j"), F.lit(True).alias("left"))
    right = part.select("*", every("out").alias("i"), mine("m").alias("j"), F.lit(False).alias("left"))
    most = _most_differing(least)

    def compare(g: pa.Table) -> pa.Table:
        ids, size, root, left = (g.column(c).to_numpy() for c in ("id", "size", "root", "left"))
        keys, low = (g.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), -1) for c in ("keys", "low"))
        low, sets = np.ascontiguousarray(low).view(np.uint8), g.column("s").combine_chunks()
        k, major = g.column("k")[0].as_py(), g.column("major")[0].as_py()
        other, out = np.flatnonzero(~left), []
        for x in np.flatnonzero(left):
            y = other[(root[other] != root[x]) & ((root[other] == major) | (ids[other] < ids[x]))]
            y = y[np.minimum(size[y], size[x]) >= least * np.maximum(size[y], size[x])]
            y = y[np.count_nonzero(low[y] != low[x], axis=1) <= most]
            y = y[keys[x][(keys[y] == keys[x]).argmax(axis=1)] == k]  # a pair is looked at in the first bucket that it shares
            mine, linked = sets[int(x)].values.to_numpy() if len(y) else None, set()
            for i in y:
                if root[i] not in linked:
                    both = len(np.intersect1d(mine, sets[int(i)].values.to_numpy(), assume_unique=True))
                    if both / (size[x] + size[i] - both) >= least:
                        linked.add(root[i])
                        out.append((max(ids[x], ids[i]), min(ids[x], ids[i])))
        e = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    return left.unionByName(right).groupBy("k", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def similar(docs: DataFrame, words: int = NEAR_WORDS, least: float = NEAR_JACCARD) -> DataFrame:
    """One row per row of docs: doc_id, component_id; rows link where their sets of word shingles have that Jaccard similarity.

    Equal sets fold into one node. Nodes whose fingerprints lie within MAX_BITS are candidates, found by links(), and so are
    those that share a band's key, for pairs farther apart: first each with its bucket's hub, and then, in buckets that this has not connected, nodes of different components, in dense buckets chunk by chunk.
    Every link is verified on the sets. docs needs doc_id and text; other columns are ignored. Null texts are empty and link
    with each other and with wordless ones. Null doc_ids are no component's smallest unless it has no other. Repeated rows give
    repeated rows. An empty table gives an empty result.
    """
    return _similar(docs, words, least).select("doc_id", F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of near_duplicates(), with all its columns: that of the smallest doc_id.

    A component whose doc_ids are all null keeps one row as well, and of rows that share a doc_id only those of one component
    are one another's copies. Of rows that repeat in doc_id and text one stays. An empty table gives an empty result.
    """
    return _firsts(docs, _near(docs, max_bits, None))


def drop_similar(docs: DataFrame) -> DataFrame:
    """The same for the components of similar(), which is the pipeline's rule."""
    return _firsts(docs, _similar(docs, NEAR_WORDS, NEAR_JACCARD))


def _firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    mine = [F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in ("doc_id", "h1", "h2")]
    keep = written(found.where(mine[0] & mine[1] & mine[2]).select(F.col("doc_id").alias("_id"), F.col("h1").alias("_k1"), F.col("h2").alias("_k2")).distinct(), "kept")
    h1, h2 = hash128(text_or_empty(), 11)
    rows = docs.select(F.col("doc_id").alias("_key"), h1.alias("_h1"), h2.alias("_h2"), F.struct("*").alias("_row"))
    rows = rows.join(keep, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")), "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # only then can a row repeat
        rows = rows.dropDuplicates(["_key", "_h1", "_h2"])
    return rows.select("_row.*")
