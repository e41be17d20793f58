"""Helpers shared by the corpus operators: shared tables, ASCII words, hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from skein.session import shared_folder

#: Largest amount of raw text, in bytes, that a Python worker holds at once.
SLICE_BYTES = 4 << 20
#: Rows of a file where the number of rows is known beforehand.
FILE_ROWS = 200_000


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Where the caller knows a bound on the rows, they are dealt to as many files as they need,
    so that rounds over few rows do not write a small file for every shuffle partition.
    The files go when the driver's JVM ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(-(-rows // FILE_ROWS) or 1)
    path = f"{shared_folder(spark)}/skein-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, jpath = _fs(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``materialise`` that nothing reads any more."""
    fs, jpath = _fs(df.sparkSession, df._skein_path)
    fs.delete(jpath, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name a column name that ``df`` does not have, also when case is ignored."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_skein_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def as_lists(col: pa.Array) -> pa.Array:
    """Text as ``large_string`` with nulls as empty texts."""
    return pc.fill_null(col.cast(pa.large_string()), "")


@cache
def _trim():
    """glibc's malloc_trim, or nothing where there is none."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: None


def release() -> None:
    """Give freed memory back, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text each, or one row. Memory freed meanwhile is given back."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield start, i
            release()
            start, total = i, 0
        total += int(n)
    if len(size) > start:
        yield start, len(size)
        release()


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z lower-cased, and each text's offsets into them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), kept[offsets]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each word its number in the vocabulary of these words; the vocabulary's 64-bit hashes and words."""
    import xxhash

    d = words.dictionary_encode()
    vocab = d.dictionary
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab.cast(pa.large_binary()).to_pylist()), np.uint64, len(vocab))
    return d.indices.to_numpy(zero_copy_only=False), hashed, vocab
