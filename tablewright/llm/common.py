"""What several operators share: settled tables, word splitting, hashing in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: White space between words: the space and U+0009 to U+000D, nothing else.
SPACES = r"[\x20\x09-\x0D]+"

#: Text handled at once inside a task, so that the memory of a worker stays bounded.
BLOCK_BYTES = 6 << 20
#: Word hashes remembered by a worker before it starts anew.
REMEMBERED_WORDS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; on one machine else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_settled"
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it from there.

    Cuts lineage: what follows neither recomputes the table nor depends on the
    executors that made it.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables settled by this application; their results can't be read after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [text or b"" for text in column.cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    return _ranges([len(text) for text in texts], limit)


def _ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def sliced(batches: Iterator[pa.RecordBatch], at: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text in column ``at``; a longer text stands alone.

    A batch holds thousands of whole texts; what is made of them stays as small as a slice.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        for start, stop in _ranges(sizes, limit):
            yield batch.slice(start, stop - start)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of SplitMix64, a published constant set)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))
