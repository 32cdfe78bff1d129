"""Texts to token ids by the tokenizers library, where each distinct chunk of a batch is encoded once.

A chunk is cut only where the tokenizer's own splitting always cuts, so the chunks' ids, put together, are the text's ids.
The places are found over the batch's bytes at once, chunks are dictionary-encoded in Arrow, only distinct ones become Python
strings, and their ids are gathered back by position. A text that holds one of the tokenizer's special tokens, which the
library takes out before it splits, goes to the library as it is.

A tokenizer that lower-cases, drops white space and marks the end of each word (word_bpe_49k) gives "Word", " word" and "word"
the same ids, so such chunks count as one, and the library takes words JOINED at a time; the marks tell whose ids are whose.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

#: A place where any text may be cut: one space between two visible ASCII characters.
_SEAM = re.compile(rb"(?<=[!-~])\x20(?=[!-~])")

SLICE = 8 << 20
MEMO_CHUNKS = 500_000
MEMO_CHARS = 64
JOINED = 100
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_WHITE, _UNSURE = 1, 2
_LETTER, _DIGIT, _MARK = 1, 2, 3


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: whether it is white space or unsure; letter, digit or mark. An apostrophe may join letters, so it is none."""
    side, kind = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    side[:33] = side[127] = _UNSURE
    side[[9, 10, 11, 12, 13, 32]] = _WHITE
    for c in range(33, 127):
        kind[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK
    kind[ord("'")] = 0
    return side, kind


_SIDE, _KIND = _tables()


def _sides(raw: np.ndarray) -> np.ndarray:
    """0 for a byte that is surely part of no white space, _WHITE for ASCII white space, _UNSURE next to which nothing is cut."""
    side = _SIDE[raw]
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if len(lead):
        one = raw[np.minimum(lead + 1, len(raw) - 1)]
        first = raw[lead]
        two = lead[(first == 0xC2) & (one <= 0xA0)]  # controls and the hard space
        side[two] = side[two + 1] = _UNSURE
        # Blocks of 64 characters with white space in them.
        three = lead[((first == 0xE1) & ((one == 0x9A) | (one == 0xA0))) | ((first == 0xE2) & ((one == 0x80) | (one == 0x81))) | ((first == 0xE3) & (one == 0x80))]
        side[three] = side[three + 1] = side[three + 2] = _UNSURE
    return side


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that lie one behind the other and begin at starts; ascending.

    Both kinds of tokenizer split a run of white space from what stands before it, and its last character from the others if
    text follows; a space is glued to that text or dropped, other white space stands alone. Letters, digits and marks are split
    from each other.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    side, kind = _sides(raw), _KIND[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[starts] = True
    white, sure = side == _WHITE, side == 0
    at = np.zeros(len(raw), bool)
    at[1:] = white[1:] & sure[:-1]
    at[:-1] |= white[:-1] & sure[1:] & ~begins[1:-1]
    at[1:] |= sure[1:] & white[:-1] & (raw[:-1] != 32)
    at[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)
    return np.flatnonzero(at | begins[:-1])


def folded(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where chunks begin) with A-Z lower-cased and one space at the front dropped, in chunks of ASCII only.

    Beyond ASCII nothing is changed: composing characters comes before lower-casing there.
    """
    if not len(begins):
        return raw, begins
    plain = np.bitwise_or.reduceat(raw, begins) < 128
    low = _LOWER[raw]
    up = np.flatnonzero(low != raw)
    up = up[~plain[np.searchsorted(begins, up, "right") - 1]]
    low[up] = raw[up]
    space = plain & (raw[begins] == 32)
    keep = np.ones(len(raw), bool)
    keep[begins[space]] = False
    return low[keep], begins - (np.cumsum(space) - space)


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """The text in slices of about size bytes, cut at seams only."""
    at = 0
    while len(text) - at > 2 * size and (m := _SEAM.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def texts_of(column: pa.Array, size: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The column in runs of about size bytes: (texts without nulls, row of each); a longer text comes in slices."""
    size = size or SLICE
    column = column.fill_null("")
    ends = np.concatenate([[0], np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)).astype(np.int64))])
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        if j == i + 1 and ends[j] - ends[i] > 2 * size:
            for s in slices(column[i].as_buffer().to_pybytes(), size):
                yield pa.array([s], pa.binary()).cast(pa.string()), np.array([i])
        else:
            yield column.slice(i, j - i), np.arange(i, j)
        i = j


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins and the last one ends) of an array of strings without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(number of each chunk, the distinct chunks); chunks begin at begins, the last one ends with raw."""
    if not len(begins):
        return np.zeros(0, np.int64), []
    offsets = np.append(begins, len(raw)).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = chunks.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def placed(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each list begins, its length, all of them one behind the other)."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    return np.cumsum(size) - size, size, np.fromiter((x for ids in found for x in ids), np.uint32, int(size.sum()))


class Memo:
    """Ids of chunks, kept in one array; places(chunks) says where. Once most (MEMO_CHUNKS) are held, it begins anew."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int | None = None):
        self.encode_many, self.most = encode_many, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size, self.ids = (np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32))
        self.n = self.used = 0

    @staticmethod
    def _grown(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype)])

    def _add(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 20_000):
            some = chunks[i : i + 20_000]
            start, size, ids = self.encode_many(some)
            n, used = self.n, self.used
            self.n, self.used = n + len(some), used + len(ids)
            self.start, self.size, self.ids = self._grown(self.start, self.n), self._grown(self.size, self.n), self._grown(self.ids, self.used)
            self.size[n : self.n] = size
            self.start[n : self.n] = used + start
            self.ids[used : self.used] = ids
            self.known.update(zip(some, range(n, self.n), strict=True))

    def places(self, chunks: list[str]) -> np.ndarray:
        """The number of each distinct chunk, whose ids are ids[start[number]:][:size[number]] until the next call."""
        if self.n > (self.most or MEMO_CHUNKS):
            self._clear()
        at = list(map(self.known.get, chunks, repeat(-1)))
        if new := [c for c, i in zip(chunks, at, strict=True) if i < 0]:
            self._add(new)
            at = list(map(self.known.__getitem__, chunks))
            for c in new:
                if len(c) > MEMO_CHARS:
                    del self.known[c]
        return np.array(at, np.int64)

    def gathered(self, which: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks one behind the other, number of ids before each chunk and in all)."""
        place = self.places(chunks)
        size = self.size[place][which]
        before = np.concatenate([[0], np.cumsum(size)])
        from_ = np.repeat(self.start[place][which] - before[:-1], size)
        return self.ids[from_ + np.arange(before[-1])], before


class Coder:
    """Whole texts to ids as the library gives them."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], special: list[bytes], ends: np.ndarray | None = None):
        """ends: of each id whether it ends a word, for a tokenizer whose chunks may be folded and joined()."""
        self.memo, self.encode_many, self.special, self.ends = Memo(self.joined if ends is not None else lambda chunks: placed(encode_many(chunks))), encode_many, special, ends

    def joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks as placed() gives them; chunks of letters only go to the library with spaces between them."""
        letters = [c.removeprefix(" ").isalpha() for c in chunks]
        words, alone = [i for i, x in enumerate(letters) if x], [i for i, x in enumerate(letters) if not x]
        start, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        pool, used = [], 0
        for group, ids in zip(groups, self.encode_many([" ".join([chunks[i] for i in g]) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            # Each chunk ends one word at least, so as many ends as chunks are one each.
            if len(stop) != len(group):
                alone += group
                continue
            size[group] = n = np.diff(stop, prepend=0)
            start[group] = used + stop - n
            pool.append(ids)
            used += len(ids)
        start[alone], size[alone], ids = placed(self.encode_many([chunks[i] for i in alone]))
        start[alone] += used
        return start, size, np.concatenate([*pool, ids])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, where each text's begin and the last one's end); end, if given, closes each."""
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for run, rows in texts_of(texts):
            ids, size = self._run(run)
            parts.append((ids, size, rows))
            np.add.at(sizes, rows, size)
        if end is None:
            return np.concatenate([p for p, _, _ in parts]) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)])
        # The ids of row r move on by r, as that many ends stand before them.
        out = np.full(int(sizes.sum()) + len(texts), end, np.uint32)
        at = 0
        for ids, size, rows in parts:
            out[np.arange(at, at + len(ids)) + np.repeat(rows, size)] = ids
            at += len(ids)
        return out, np.concatenate([[0], np.cumsum(sizes + 1)])

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, bounds = flat(texts)
        body = memoryview(raw)
        if any(re.search(re.escape(s), body) for s in self.special):
            return self._with_special(texts)
        begins = cuts(raw, bounds[:-1][np.diff(bounds) > 0])
        ids, before = self.memo.gathered(*distinct(*(raw, begins) if self.ends is None else folded(raw, begins)))
        return ids, np.diff(before[np.searchsorted(begins, bounds)])

    def _with_special(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text by text: with a special token by the library alone."""
        found = []
        for i in range(len(texts)):
            one = texts.slice(i, 1)
            if any(s in one[0].as_buffer().to_pybytes() for s in self.special):
                found.append(np.array(self.encode_many([one[0].as_py()])[0], np.uint32))
            else:
                found.append(self._run(one)[0])
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)


def word_ends(state: dict) -> np.ndarray | None:
    """Of each id whether it ends a word, where the tokenizer (its file's content) lower-cases, drops white space and marks ends; else None."""
    kinds = [x["type"] for x in (state["normalizer"] or {}).get("normalizers", [])]
    steps = (state["pre_tokenizer"] or {}).get("pretokenizers", [])
    mark = state["model"].get("end_of_word_suffix")
    if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or not mark:
        return None
    split, level = steps
    if (split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"]) != ("Removed", True, False, False) or split["pattern"] != {"Regex": _WORDS}:
        return None
    out = np.zeros(1 + max([*state["model"]["vocab"].values(), *(x["id"] for x in state["added_tokens"])]), bool)
    out[[i for piece, i in state["model"]["vocab"].items() if piece.endswith(mark)]] = True
    return out


_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's own encoder for a tokenizer file; workers are used again, so what one task learned serves the next."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        special = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        _coders[path] = Coder(lambda xs: [e.ids for e in t.encode_batch_fast(xs, add_special_tokens=False)], special, word_ends(json.loads(t.to_str())))
    return _coders[path]


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies; looked up on the executor, where the file is read."""
    import public_tokenizers

    return public_tokenizers.path(name)
