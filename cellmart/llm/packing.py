"""Packing by power-of-two decomposition.

A document of n tokens becomes full sequences and one piece for each bit of the rest, longest first. Every piece fills a
sequence of its own whose length is a power of two, so nothing is padded and no sequence crosses documents; a trainer batches
sequences of one bucket (equal length). One narrow pass: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmart.llm.common import rows_of, text_or_empty
from cellmart.llm.token_memo import coder, public_path

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 1024
END = 0


def pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; length is a power of two."""
    out = [(i, length) for i in range(0, n - n % length, length)]
    at, size = n - n % length, length >> 1
    while size:
        if n & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, bucket, ids (little-endian unsigned 32-bit).

    docs needs doc_id and text; other columns are ignored. A null or empty text is the end id alone. Every row counts as a
    document, repeated rows too; doc_id may be null. A special token's string in a text becomes that token's id, as the
    library does by itself. sequence_id is unique in the result, and the same whenever the same
    input splits are read. tokenizer: a public tokenizer's name, or a path that exists on each executor. An empty table
    gives an empty result.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = coder(tokenizer if "/" in tokenizer else public_path(tokenizer))
        rest = [[k for _, k in pieces(n, length)] for n in range(length)]  # the pieces of what is left after the full ones
        for b in rows_of(batches, 10_000, 4 << 20):
            ids, at = to_ids.encode(b.column(1), end)
            total, size = np.diff(at), []
            for n in total.tolist():
                size += [length] * (n // length) + rest[n % length]
            size = np.array(size, np.int64)
            edge = np.concatenate([[0], np.cumsum(size)])
            owner = np.searchsorted(at, edge[:-1], "right") - 1
            for i in range(0, len(size), 8000):  # a very long text is not one batch
                j = min(len(size), i + 8000)
                part = edge[i : j + 1] - edge[i]
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(4 * part), pa.py_buffer(np.ascontiguousarray(ids[edge[i] : edge[j]]))])
                own = owner[i:j]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(edge[i:j] - at[own]), pa.array(size[i:j]), pa.array(total[own]), body.cast(pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    out = rows.mapInArrow(work, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")
    return out.select("doc_id", "start", "length", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"), "ids")
