"""Record batches in Python tasks: row numbers, 64-bit word hashes and output batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a row number that count rows within one task's partition; the rest is the partition.
ROW_BITS = 40

#: Rows, and bytes of their texts, handed on at a time; they bound the memory that a step takes in a task.
ROWS_PER_STEP = 512
BYTES_PER_STEP = 4 << 20


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per word while the table stays below ``most`` words.

    The bound limits memory only: beyond it a new word is hashed each time it is met.
    """

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` consecutive words; of the whole sequence if it is shorter."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for step in range(size):
            total = mixed(total + hashes[step : step + len(total)] + np.uint64(0x9E3779B97F4A7C15))
    return total


def first_row_number() -> int:
    """Number of the first row of this task's partition; rows count on from it.

    The numbers differ between partitions. They are stable once the table that holds them is written.
    """
    return TaskContext.get().partitionId() << ROW_BITS


def steps(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_STEP, size: int = BYTES_PER_STEP) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, whose texts and binaries take ``size`` bytes or are one row."""
    for batch in batches:
        taken = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                taken += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(taken)
        start = 0
        while start < batch.num_rows:
            before = ends[start] - taken[start]
            end = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The texts as UTF-8, as they are stored."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def lists_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per array."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


class Held:
    """A table under column names of its own, so that no operator column can clash with it."""

    def __init__(self, table: DataFrame):
        self.columns = table.columns
        self.names = [f"c{place}" for place in range(len(self.columns))]
        self.table = table.toDF(*self.names)

    def __getitem__(self, column: str) -> str:
        """The name that stands for a column here; the first one of that name, whatever its case."""
        return self.names[[name.lower() for name in self.columns].index(column.lower())]

    def schema(self, more: str) -> str:
        """The schema of the held columns followed by others."""
        return f"{self.table.schema.simpleString()[:-1]},{more}>"

    def restored(self, table: DataFrame, **replaced) -> DataFrame:
        """The held columns under their old names, some of them replaced."""
        inner = {self[name]: value for name, value in replaced.items()}
        return table.select(
            *(inner.get(held, F.col(held)).alias(name) for name, held in zip(self.columns, self.names, strict=True))
        )
