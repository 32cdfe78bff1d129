"""What the operators share: the shared folder, written tables that cut lineage, and small Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The documents' white space, inside a character class of Java's, Python's and RE2's regular expressions.
ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one place."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cellmart-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one, deleted when the driver's JVM ends."""
    at = f"{shared_dir(spark)}/cellmart-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table written once to the shared folder: lost executors do not take it with them, and no plan repeats it."""
    at = scratch_dir(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder below the shared one that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str | None:
    """The path that open() takes, or None where the folder is in a store that needs a client."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def save_bytes(uri: str, chunks: Iterable[bytes]) -> None:
    """Writes a file under a name of its own first, so that a repeated or lost task never leaves half a file."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as out:
            for x in chunks:
                out.write(x)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as out:
        for x in chunks:
            out.write(x)
    store.move(part, path)


def open_input(uri: str):
    """A seekable reader of a file in the shared folder."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def mapped(uri: str) -> memoryview:
    """The file's bytes, memory-mapped; from a store without local paths, by way of a file that is unlinked at once."""
    import mmap

    path = local_path(uri)
    if path is None:
        with tempfile.TemporaryFile() as f, open_input(uri) as src:
            while chunk := src.read(1 << 24):
                f.write(chunk)
            f.flush()
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with open(path, "rb") as f:
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash128(value: Column, seed: int = 0) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(F.lit(seed), value).alias("h1"), F.xxhash64(F.lit(seed + 7919), value).alias("h2")]


def rows_of(batches: Iterator[pa.RecordBatch], size: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most size rows and, where they have more than one row, about max_bytes. At the end the worker, which
    lives on for other tasks, gives back the memory that Arrow holds unused."""
    for b in batches:
        step = size
        if b.num_rows and b.nbytes > max_bytes:
            step = max(1, min(size, int(b.num_rows * max_bytes / b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    pa.default_memory_pool().release_unused()
