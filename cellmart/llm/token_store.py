"""Token ids in independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds, in ascending doc_id order:
  frames      zstandard frames of little-endian unsigned 32-bit ids, about FRAME_BYTES each before compression; a document
              lies in one frame, or in several if it is longer than one
  documents   a skippable frame (magic 0x184D2A50): number of documents, then per document its id, whether the id is null,
              and its number of ids
  seek table  a skippable frame (magic 0x184D2A5E) in the layout of zstandard's seekable format: per frame compressed size,
              decompressed size and the low half of the XXH64 of its content; then the number of frames, a flag byte and the
              magic 0x8F92EAB1
Any zstandard decoder reads the ids; a reader that wants some documents decompresses only the frames that hold them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cellmart.llm.common import open_input, rows_of, save_bytes, scratch_dir, text_or_empty
from cellmart.llm.token_memo import coder, public_path

TOKENIZER = "word_bpe_49k.json"
END = 2
FRAME_BYTES = 1 << 18
FILE_BYTES = 1 << 27
LEVEL = 3
_INDEX, _SEEK, _MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def encode_file(docs: Iterable[tuple[int | None, bytes]], frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> Iterator[bytes]:
    """The file's bytes, frame by frame; at most one frame and one document are held."""
    import xxhash
    import zstandard

    coder = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    ids, nulls, sizes, table = [], [], [], []

    def frame(raw: bytes) -> bytes:
        out = coder.compress(raw)
        table.append((len(out), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return out

    wait: list[bytes] = []
    held = 0
    for doc_id, raw in docs:
        ids.append(0 if doc_id is None else doc_id)
        nulls.append(doc_id is None)
        sizes.append(len(raw) // 4)
        if held and held + len(raw) > frame_bytes:
            yield frame(b"".join(wait))
            wait, held = [], 0
        while len(raw) > frame_bytes:
            yield frame(raw[:frame_bytes])
            raw = raw[frame_bytes:]
        wait.append(raw)
        held += len(raw)
    if held:
        yield frame(b"".join(wait))
    body = struct.pack("<Q", len(ids)) + np.array(ids, "<i8").tobytes() + np.array(nulls, "u1").tobytes() + np.array(sizes, "<u8").tobytes()
    body = coder.compress(body)
    yield struct.pack("<II", _INDEX, len(body)) + body
    table.append((len(body) + 8, 0, 0))
    foot = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), 0x80, _MAGIC)
    yield struct.pack("<II", _SEEK, len(foot)) + foot


class Reader:
    """Random access to a file. frames_read counts what has been decompressed."""

    def __init__(self, f):
        import zstandard

        self.f, self.coder, self.frames_read = f, zstandard.ZstdDecompressor(), 0
        end = f.seek(0, 2)
        f.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != _MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        f.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        starts = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        f.seek(int(starts[-1]))
        magic, size = struct.unpack("<II", f.read(8))
        if magic != _INDEX:
            raise ValueError("no document index")
        body = self.coder.decompress(f.read(size))
        (count,) = struct.unpack_from("<Q", body)
        self.ids = np.frombuffer(body, "<i8", count, 8)
        self.nulls = np.frombuffer(body, "u1", count, 8 + 8 * count).astype(bool)
        self.sizes = np.frombuffer(body, "<u8", count, 8 + 9 * count).astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.at, self.table = starts[:-1], self.table[:-1]
        self.raw_at = np.cumsum(self.table[:, 1]) - self.table[:, 1]
        self.last = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.last[0] != k:
            self.f.seek(int(self.at[k]))
            raw = self.coder.decompress(self.f.read(int(self.table[k, 0])))
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self.last = (k, raw)
        return self.last[1]

    def document(self, i: int) -> bytes:
        """The ids of the i-th document, as bytes."""
        a, b = 4 * int(self.begins[i]), 4 * int(self.begins[i] + self.sizes[i])
        out, k = [], int(np.searchsorted(self.raw_at, a, "right")) - 1
        while a < b:
            raw, base = self.frame(k), int(self.raw_at[k])
            out.append(raw[a - base : b - base])
            a += len(out[-1])
            k += 1
        return b"".join(out)

    def find(self, doc_id: int) -> list[int]:
        """The places of the documents of this id; ids ascend behind the nulls."""
        n = int(self.nulls.sum())
        a, b = np.searchsorted(self.ids[n:], [doc_id, doc_id + 1])
        return list(range(n + int(a), n + int(b)))


def write_tokens(docs: DataFrame, to: str | None = None, tokenizer: str = TOKENIZER, end: int = END) -> list[tuple[str, int, int, int]]:
    """Encodes every text, appends end and writes the files; (path, ids before it, ids, documents) of each, in order.

    docs needs doc_id (whole numbers, else ValueError) and text; other columns are ignored. Null texts are empty; null doc_ids
    come first; rows of one doc_id are ordered by text. A special token's string in a text becomes that token's id, as the
    library does by itself. Only this list, one entry a file, comes to the driver. An empty table gives an empty list.
    """
    to = to or scratch_dir(docs.sparkSession, "tokens")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("the file format holds whole numbers as doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    by = F.col("doc_id").asc_nulls_first()
    # A file's documents are indexed in memory, so files grow in number and not in size.
    files = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // FILE_BYTES
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = files < 1 << 24  # Spark takes an unknown size for the largest number
    rows = rows.repartitionByRange(files, by) if known and files > usual else rows.repartitionByRange(by)
    rows = rows.sortWithinPartitions(by, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        to_ids = coder(tokenizer if "/" in tokenizer else public_path(tokenizer))
        count = [0, 0]

        def tokens() -> Iterator[tuple[int | None, bytes]]:
            for b in rows_of(batches, 10_000, 4 << 20):
                ids, edge = to_ids.encode(b.column(1), end)
                count[0] += len(ids)
                count[1] += b.num_rows
                raw, edge = memoryview(ids.astype("<u4")).cast("B"), (4 * edge).tolist()
                for k, x, y in zip(b.column(0).to_pylist(), edge, edge[1:], strict=False):
                    yield k, bytes(raw[x:y])

        at = f"{to}/tokens-{part:06d}.zst"
        save_bytes(at, encode_file(tokens()))
        if count[1]:
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [at], "n_ids": [count[0]], "n_docs": [count[1]]})

    files = sorted(tuple(r) for r in rows.mapInArrow(work, "part long, path string, n_ids long, n_docs long").collect())
    out, before = [], 0
    for _, path, n, k in files:
        out.append((path, before, n, k))
        before += n
    return out


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int, int]], wanted: list[int] | None = None) -> DataFrame:
    """One row per document of the files, or of those with the wanted ids: doc_id, start (ids before it), n_tokens, ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_input(path) as f:
                    r = Reader(f)
                    places = range(len(r.ids)) if wanted is None else [i for w in sorted(set(wanted)) for i in r.find(w)]
                    group, held = [], 0
                    for i in places:
                        group.append((i, r.document(i)))
                        held += len(group[-1][1])
                        if held > 4 << 20:
                            yield batch(r, before, group)
                            group, held = [], 0
                    if group:
                        yield batch(r, before, group)

    def batch(r: Reader, before: int, group: list[tuple[int, bytes]]) -> pa.RecordBatch:
        at = np.array([i for i, _ in group])
        return pa.RecordBatch.from_arrays([pa.array(r.ids[at], mask=r.nulls[at]), pa.array(r.begins[at] + before), pa.array(r.sizes[at]), pa.array([x for _, x in group], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    listed = spark.createDataFrame([(p, b) for p, b, _, _ in files], "path string, before long").repartition(max(1, len(files)))
    return listed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")
