"""Token ids as flat binary files with 64-bit document offsets.

Documents are sorted by doc_id over all tasks; each task encodes its share, appends the closing id to every document and
writes one shard: ``.ids``, nothing but unsigned integers (little-endian, two bytes wide if the vocabulary allows it, else
four), and ``.docs``, the documents' 64-bit ids. How many documents and tokens a shard has is a row of a small table;
prefix sums over that table, one row per shard, are the shards' bases. A second pass adds the base to the running
count of each shard's documents and writes ``.offsets``: unsigned 64-bit positions in the whole corpus, one for each document
and one for the end. The manifest, a Parquet table written last, names the shards that count: files of a task that was
lost or ran twice are in no manifest. Files are read back through memory maps, one shard per task.

Defined cases: a null or empty text is its closing id alone. Documents without a doc_id come first; the manifest says how
many a shard has. Rows that repeat a doc_id are documents of their own, in the order of a hash of their texts; a doc_id or
a whole row that very many rows share is dealt over as many shards as it fills. Texts of any length are encoded whole.
An empty table has an empty manifest. Other columns are not read. ``documents`` should be read from files, whose rows a
task that runs again meets in the same order.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstone.llm.arrow import steps
from tillstone.llm.files import Mapped, made_folder, written
from tillstone.llm.token_ids import TokenIds
from tillstone.operators.storage import WorkTables

#: Tokens read at a time.
BLOCK = 1 << 20


@dataclass(frozen=True)
class TokenFormat:
    """``cached_pieces`` bounds the memory of a worker's table of encoded pieces of words."""

    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    closing_id: int = 2
    cached_pieces: int = 500_000


SHARDS = "part int, shard string, width int, documents bigint, without_id bigint, tokens bigint"


def width_of(table: TokenIds, closing_id: int) -> int:
    """Bytes of an id in the files."""
    return 2 if max(table.vocabulary - 1, closing_id) < 1 << 16 else 4


def _write(folder: str, options: TokenFormat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), None
        documents = without_id = tokens = 0
        for batch in steps(batches, 2048, 8 << 20):
            if shard is None:
                table = TokenIds.of_worker(options.tokenizer, options.cached_pieces)
                width = width_of(table, options.closing_id)
                shard = f"{folder}/part-{part:06}-{uuid.uuid4().hex[:12]}"
                to_ids, to_docs, to_counts = (written(f"{shard}.{kind}") for kind in ("ids", "docs", "counts"))
            ids, ends = table.ids([text or "" for text in batch.column("text").to_pylist()])
            to_ids.write(np.insert(ids, ends[1:], options.closing_id).astype(f"<u{width}").tobytes())
            to_counts.write((np.diff(ends) + 1).astype("<u8").tobytes())
            docs = batch.column("doc_id")
            to_docs.write(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            documents, without_id = documents + len(docs), without_id + docs.null_count
            tokens += len(ids) + len(docs)
        if shard is not None:
            for file in (to_ids, to_docs, to_counts):
                file.close()
            yield pa.RecordBatch.from_pylist(
                [dict(part=part, shard=shard, width=width, documents=documents, without_id=without_id, tokens=tokens)],
                pa.schema([("part", pa.int32()), ("shard", pa.string()), ("width", pa.int32())]
                          + [(name, pa.int64()) for name in ("documents", "without_id", "tokens")]),
            )

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = []
        for row in batch.to_pylist():
            names.append(f"{row['shard']}-{uuid.uuid4().hex[:12]}.offsets")
            counts, at = Mapped(f"{row['shard']}.counts", "<u8"), row["first_token"]
            with written(names[-1]) as file:
                for start in range(0, row["documents"], BLOCK):
                    ends = at + np.cumsum(counts[start : start + BLOCK])
                    file.write(np.concatenate([[at], ends[:-1]]).astype("<u8").tobytes())
                    at = int(ends[-1])
                file.write(np.array([at], "<u8").tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "offsets"])


def spread(shards: DataFrame) -> DataFrame:
    """A table of few rows, each of them the work of a task."""
    return shards.repartition(max(1, shards.count()))


def write_tokens(documents: DataFrame, tables: WorkTables, options: TokenFormat = TokenFormat()) -> DataFrame:
    """Write the files of all documents; the manifest, one row per shard with its bases and files."""
    folder = made_folder(documents.sparkSession, f"{tables.folder}/tokens-{uuid.uuid4().hex[:8]}")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumns(
        {"place": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    )
    # the row number deals out rows that are equal in all else; which of them goes where makes no difference
    dealt = texts.repartitionByRange("doc_id", "place", "row").sortWithinPartitions("doc_id", "place", "text")
    shards = tables.save(dealt.select("doc_id", "text").mapInArrow(_write(folder, options), schema=SHARDS), "shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = {
        "first_document": F.coalesce(F.sum("documents").over(before), F.lit(0)),
        "first_token": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
    }
    based = spread(shards.withColumns(bases))
    return tables.save(based.mapInArrow(_index, schema=f"{SHARDS}, first_document bigint, first_token bigint, offsets string"), "manifest")


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            ids = Mapped(f"{row['shard']}.ids", f"<u{row['width']}")
            docs, offsets, base = Mapped(f"{row['shard']}.docs", "<i8"), Mapped(row["offsets"], "<u8"), row["first_token"]
            first = 0
            while first < row["documents"]:
                ahead = offsets[first : first + BLOCK + 1].astype(np.int64)
                last = first + max(1, int(np.searchsorted(ahead, ahead[0] + BLOCK, "right")) - 1)
                last = min(last, first + len(ahead) - 1)
                ends = ahead[: last - first + 1]
                data = ids[ends[0] - base : ends[-1] - base].astype("<u4")
                view, cuts = memoryview(data.tobytes()), (4 * (ends - ends[0])).tolist()
                made = {
                    "doc_id": pa.array(docs[first:last], pa.int64(), mask=np.arange(first, last) < row["without_id"]),
                    "start": pa.array(ends[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(ends), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                }
                if with_ids:
                    made["ids"] = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(data.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*made.values()], names=[*made])
                first = last

    return run


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids) and, if asked for, the ids."""
    more = ", ids array<int>" if with_ids else ""
    schema = f"doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint{more}"
    return spread(manifest).mapInArrow(_read(with_ids), schema=schema)


class Corpus:
    """The files as one sequence of ids for a training process; keeps one manifest row per shard."""

    def __init__(self, manifest: DataFrame):
        self.shards = sorted(manifest.collect(), key=lambda row: row["part"])
        self.starts = [row["first_token"] for row in self.shards]
        self.size = self.starts[-1] + self.shards[-1]["tokens"] if self.shards else 0

    def __getitem__(self, span: slice) -> np.ndarray:
        """The ids from one position to another, across documents and shards."""
        start, stop, _ = span.indices(self.size)
        found = [np.zeros(0, "<u4")]
        at = bisect_right(self.starts, start) - 1
        while start < stop:
            shard, base = self.shards[at], self.starts[at]
            end = min(stop, base + shard["tokens"])
            found.append(Mapped(f"{shard['shard']}.ids", f"<u{shard['width']}")[start - base : end - base].astype("<u4"))
            start, at = end, at + 1
        return np.concatenate(found)
