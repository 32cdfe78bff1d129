"""Encoding and decoding with a SentencePiece model by a streaming Viterbi search.

Characters come in one by one. For each place the best way to it is kept as a back pointer, and only places within the
longest piece's length can begin a new piece, so older places live on only as ancestors of those. As soon as all paths from
the live places lead through one boundary, the ids before it are committed and forgotten.

A unigram model ranks ways by the sum of their scores. A model of byte-pair merges has no such sum: there a way is
admissible if merging would leave every two neighbouring pieces of it as they are, and exactly one way to each place is;
so the same search gives the merges' own result. Characters without a piece are given as bytes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmart.llm.common import rows_of, text_or_empty
from cellmart.llm.token_memo import Memo, distinct, flat, placed, public_path, texts_of

MODEL = "piece_bpe_32k.model"
GAP = "▁"
ROUND_TRIP_BYTES = 2 << 20  # of texts at once
STRETCHES = 200_000  # remembered at most, and pairs of pieces side by side: what a worker holds is bounded
BESIDE = 100_000


class Vocabulary:
    """pieces: the text of each usable piece and its id; score by id; merges: whether it is a model of merges."""

    def __init__(self, pieces: dict[str, int], score: dict[int, float], merges: bool, byte_ids: list[int] | None = None, unknown: int = 0):
        self.ids, self.score, self.merges, self.byte_ids, self.unknown = pieces, score, merges, byte_ids, unknown
        self.longest = max(map(len, pieces), default=1)
        self.least = min(score.values(), default=0.0) - 10.0  # an unknown character's score in a unigram model
        self.beside: dict[tuple[str, str], bool] = {}
        self.begun: dict[str, bool] = {}
        self.last: dict[str, tuple[str, str] | None] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text: always the best pair, of equals the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.ids.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or self.score[s] > best):
                    best, at = self.score[s], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces of the last merge that makes this piece of its own text; None for a character, or if merging never does."""
        got = self.last.get(piece, 0)
        if got == 0:
            parts = list(piece)
            got = None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = self.ids.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or self.score[s] > best):
                        best, at = self.score[s], i
                if at < 0:
                    got = None
                    break
                got = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.last[piece] = got
        return got

    def stands(self, piece: str) -> bool:
        """Whether merging ever makes this piece of its own text."""
        return len(piece) == 1 or self.halves(piece) is not None

    def beginnings(self) -> dict[str, bool]:
        """Every beginning of a piece, and whether it stands as a piece itself."""
        if not self.begun:
            for p in self.ids:
                for n in range(1, len(p)):
                    self.begun.setdefault(p[:n], False)
                self.begun[p] = self.stands(p)
        return self.begun

    def admits(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b side by side: no merge across the seam comes before the merges that make a and b.

        Those are undone from the last one back; at each step the parts at the seam must not make a better piece than the
        one undone just before. Of equal scores the left merge comes first.
        """
        key = (a, b)
        ok = self.beside.get(key)
        if ok is not None:
            return ok
        ids, score, least, came_right = self.ids, self.score, -float("inf"), False
        left, right, ok = a, b, True
        while True:
            # What the parts at the seam would make must not come before the merge undone last.
            both = ids.get(left + right)
            if both is not None and (score[both] > least or came_right and score[both] == least):
                ok = False
                break
            x = score[ids[left]] if len(left) > 1 else None
            y = score[ids[right]] if len(right) > 1 else None
            if x is None and y is None:
                break
            if y is None or x is not None and x < y:
                least, left, came_right = x, self.halves(left)[1], False
            else:
                least, right, came_right = y, self.halves(right)[0], True
        if len(self.beside) > BESIDE:
            self.beside.clear()
        self.beside[key] = ok
        return ok


class Stream:
    """feed(text) and finish() give pieces as soon as they are certain.

    A place is expanded once the longest piece from it has come in: each piece that begins there makes its end a live place,
    with a back pointer. Places wait from the last certain boundary on; whenever twice the longest piece waits, the back
    pointers of all live places are followed to the boundary where they meet, and the pieces before it are committed.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.kind = v, v.beginnings()
        self.text, self.at = "", 0  # what waits, and how many of its places are expanded
        # Of each place: the piece that leads to it, and the score of the way. The first one keeps the piece committed last.
        self.before: list[str | None] = [""]
        self.score = [0.0]

    def feed(self, text: str) -> list[str]:
        out, step = [], 2 * self.v.longest
        for k in range(0, len(text), step):
            self.text += text[k : k + step]
            self._expand(len(self.text) - self.v.longest)
            if self.at >= step:
                out += self._commit()
        return out

    def finish(self) -> list[str]:
        self._expand(len(self.text))
        return self._back(len(self.text), 0)

    def _expand(self, stop: int) -> None:
        v, kind, text, before, score = self.v, self.kind, self.text, self.before, self.score
        n, merges = len(text), v.merges
        before += [None] * (n + 1 - len(before))
        if not merges:
            score += [-float("inf")] * (n + 1 - len(score))
        for i in range(self.at, stop):
            a = before[i]
            if a is None:
                continue
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                stands = kind.get(piece)
                if merges:
                    if (stands or j == i + 1) and before[j] is None and (not a or v.admits(a, piece)):
                        before[j] = piece
                elif piece in v.ids or j == i + 1:
                    s = score[i] + (v.score[v.ids[piece]] if piece in v.ids else v.least)
                    if s >= score[j]:
                        before[j], score[j] = piece, s
                if stands is None:
                    break  # no longer piece begins so
        self.at = max(self.at, stop)

    def _back(self, place: int, to: int) -> list[str]:
        out = []
        while place > to:
            out.append(self.before[place])
            place -= len(self.before[place])
        return out[::-1]

    def _commit(self) -> list[str]:
        """The pieces up to the boundary that all live ways share."""
        live = {j for j in range(self.at, len(self.before)) if self.before[j] is not None}
        while len(live) > 1:
            j = max(live)
            live.remove(j)
            live.add(j - len(self.before[j]))
        (meet,) = live
        out = self._back(meet, 0)
        if out:
            self.text, self.at, self.before, self.score = self.text[meet:], self.at - meet, self.before[meet:], self.score[meet:]
            self.before[0] = out[-1]
        return out


class Coder:
    """Whole texts to ids and back.

    Where no piece holds the two characters at a seam next to each other, every way of the search has a boundary there: the
    ways converge, whatever comes. Texts are cut at those seams, found for a whole batch at once, and each different stretch
    between two of them goes through a Stream; its outcome is remembered.
    """

    def __init__(self, v: Vocabulary, dummy_prefix: bool = True):
        self.v, self.dummy_prefix = v, dummy_prefix
        self.memo = Memo(lambda stretches: placed([self._ids(s.replace(" ", GAP)) for s in stretches]), STRETCHES)
        # By code of the character, 128 for all beyond ASCII: whether some piece holds the two next to each other.
        self.joined = np.zeros((129, 129), bool)
        self.joined[128, 128] = True
        for p in v.ids:
            codes = [min(ord(c), 128) for c in p.replace(GAP, " ")]
            self.joined[codes[:-1], codes[1:]] = True
        back = [b""] * (1 + max([*v.score, *(v.byte_ids or []), v.unknown, -1]))
        for p, i in v.ids.items():
            back[i] = p.replace(GAP, " ").encode("utf-8", "surrogatepass")
        for b, i in enumerate(v.byte_ids or []):
            back[i] = bytes([b])
        back[v.unknown] = " ⁇ ".encode()
        self.back = pa.array(back, pa.large_binary())

    def _ids(self, stretch: str) -> array:
        out, v, s = array("I"), self.v, Stream(self.v)
        ways = [s.feed(stretch[k : k + 4096]) for k in range(0, len(stretch), 4096)]
        for way in (*ways, s.finish()):
            for p in way:
                i = v.ids.get(p)
                if i is not None:
                    out.append(i)
                elif v.byte_ids:
                    out.extend(v.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
                else:
                    out.append(v.unknown)
        return out

    def cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where stretches begin in texts that lie one behind the other and begin at starts."""
        if not len(raw):
            return np.zeros(0, np.int64)
        code = np.minimum(raw, 128).astype(np.int32)
        at = np.ones(len(raw), bool)
        at[1:] = ~self.joined.ravel()[code[:-1] * 129 + code[1:]]
        at[starts] = True
        return np.flatnonzero(at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, where each text's begin and the last one's end)."""
        parts, sizes, last = [], np.zeros(len(texts), np.int64), -1
        for run, rows in texts_of(texts):
            run = pc.replace_substring(run, GAP, " ")
            if self.dummy_prefix and rows[0] != last:
                run = pc.if_else(pc.equal(run, ""), run, pc.binary_join_element_wise("", run, " "))
            last = rows[-1]
            raw, bounds = flat(run)
            begins = self.cuts(raw, bounds[:-1][np.diff(bounds) > 0])
            ids, before = self.memo.gathered(*distinct(raw, begins))
            parts.append(ids)
            np.add.at(sizes, rows, np.diff(before[np.searchsorted(begins, bounds)]))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The texts of ids that lie one behind the other; bytes that are no UTF-8 become U+FFFD."""
        size = np.append(0, np.cumsum(pc.binary_length(self.back).to_numpy()[ids]))
        raw = self.back.take(pa.array(ids)).buffers()[2]
        raw = np.frombuffer(raw, np.uint8)[: size[-1]] if raw is not None else np.zeros(0, np.uint8)
        start, stop = size[edges[:-1]], size[edges[1:]]
        if self.dummy_prefix and len(raw):
            start = start + ((stop > start) & (raw[np.minimum(start, len(raw) - 1)] == 32))
        view = memoryview(raw)
        return pa.array([str(view[a:b], "utf-8", "replace") for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.string())


def load(path: str) -> Coder:
    """A coder for a SentencePiece model file whose normaliser changes nothing but spaces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    usable = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(p.is_byte, range(n))) else None
    probe = p.encode("  ﬁA  b ", out_type=str)
    text = "".join(probe)
    if text.lstrip(GAP) != f"ﬁA{GAP}{GAP}b{GAP}" and byte_ids is None or GAP * 2 not in text:
        raise ValueError("this model's normaliser changes texts")
    # Scores of merges are whole negative ranks, those of a unigram model logarithms.
    merges = all(float(p.get_score(i)).is_integer() for i in usable[:2000])
    return Coder(Vocabulary({p.id_to_piece(i): i for i in usable}, {i: p.get_score(i) for i in usable}, merges, byte_ids, p.unk_id()), text.startswith(GAP * 3))


_coders: dict[str, Coder] = {}


def coder(model: str) -> Coder:
    path = model if "/" in model else public_path(model)
    if path not in _coders:
        _coders[path] = load(path)
    return _coders[path]


def _encoded(c: Coder, texts: pa.Array) -> pa.Array:
    """The ids of texts, as bytes."""
    ids, edges = c.encode(texts)
    raw, at = memoryview(ids.astype("<u4")).cast("B"), (4 * edges).tolist()
    return pa.array([raw[x:y] for x, y in zip(at, at[1:], strict=False)], pa.binary())


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian unsigned 32-bit).

    docs needs doc_id and text; other columns are ignored. A null or empty text has no ids. model: a public model's name, or
    a path that exists on each executor. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_or_empty().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in rows_of(batches, 10_000, 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), _encoded(c, b.column(1))], names=["doc_id", "ids"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def _decoded(c: Coder, raw: pa.Array) -> pa.Array:
    """The texts of ids given as bytes; null ids give a null text."""
    raw_ids = raw.to_pylist()
    edges = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in raw_ids])]).astype(np.int64)
    texts = c.decode(np.frombuffer(b"".join(x or b"" for x in raw_ids), "<u4"), edges)
    return pc.if_else(raw.is_valid(), texts, pa.scalar(None, pa.string()))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (doc_id, ids, as encode() gives them) with the text of the ids; null ids give a null text."""
    rows = encoded.select(F.col("doc_id").alias("doc_id"), F.col("ids").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in rows_of(batches, 10_000, 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _decoded(c, b.column(1))], names=["doc_id", "ids", "text"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """decode(encode(docs)), where one worker does both: a task of two chained passes holds two workers, and the model twice."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_or_empty().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in rows_of(batches, 10_000, ROUND_TRIP_BYTES):
            ids = _encoded(c, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, _decoded(c, ids)], names=["doc_id", "ids", "text"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")
