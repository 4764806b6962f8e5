"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A text is cut after a word wherever the gear hash of the 16 bytes before falls below a limit, so that after an insertion
the cuts fall into step again a few words later; a longer stretch without a cut is cut every ``most_words`` words. What
is compared are windows: the shortest runs of consecutive chunks that hold at least ``least_words`` words, from every chunk
on and up to every chunk. Of all windows with one digest the first (by row number, then place) is kept, and the chunks of
the later ones are removed. So a chunk goes if and only if it lies in a run of at least ``least_words`` words that stood
before as a whole; chunks that stood before one by one stay, however common they are.

Digests of windows are computed from the written rows each time they are needed instead of being stored. They are counted
with partial sums before the shuffle and only windows whose digest occurs twice are carried on, so a passage that a third of
the documents share costs one row per partition there, and is then joined with a single row.

Defined cases: null and empty texts have no chunks and stay as they are. Repeated rows are documents of their own: all
but the first lose what they share. A character of three or four bytes from U+3000 on counts as a word, so texts without
spaces are cut as well; a word of any length is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm.arrow import Held, mixed, steps, texts_of
from tillstone.operators.storage import WorkTables

# an odd number and its inverse modulo 2**64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


@dataclass(frozen=True)
class Chunking:
    """Parameters: words in a chunk on average and at most, words in a window, seed of the gear table."""

    mean_words: int = 5
    most_words: int = 20
    least_words: int = 12
    seed: int = 3

    def gears(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 1 << 16, 256, np.uint16)


def gear_hashes(data: np.ndarray, gears: np.ndarray) -> np.ndarray:
    """The rolling hash ``h = (h << 1) + gear[byte]`` in 16 bits after every byte, by doubling the bytes it covers."""
    rolled = gears[data]
    for covered in (1, 2, 4, 8):
        rolled[covered:] = rolled[covered:] + (rolled[:-covered] << np.uint16(covered))
    return rolled


def chunk_ends(text: bytes, options: Chunking, gears: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of a text and the number of words in each."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACES[data]
    # a word ends before the first byte of the next one
    starts = (~space[1:] & space[:-1]) | (data[1:] >= 0xE3)
    word_ends = np.append(np.flatnonzero(starts) + 1, len(data))
    cut = gear_hashes(data, gears)[word_ends - 1] < (1 << 16) // options.mean_words
    cut[-1] = True
    chosen = np.flatnonzero(cut)
    sizes = np.diff(chosen, prepend=-1)
    if sizes.max() > options.most_words:
        forced = [np.arange(end - size + options.most_words, end, options.most_words) for end, size in zip(chosen, sizes, strict=True)]
        chosen = np.union1d(chosen, np.concatenate(forced))
        sizes = np.diff(chosen, prepend=-1)
    return word_ends[chosen], sizes


def digests(text: bytes, ends: np.ndarray) -> np.ndarray:
    """64-bit digest of every chunk, without the white space at its end."""
    bounds = [0, *ends.tolist()]
    pieces = (xxhash.xxh3_64_intdigest(text[start:end].rstrip()) for start, end in zip(bounds, bounds[1:], strict=False))
    return np.fromiter(pieces, np.uint64, len(ends)).view(np.int64)


def windows(sizes: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of every window of a text: those from each chunk on, then the others up to each chunk."""
    words, places = np.concatenate([[0], np.cumsum(sizes)]), np.arange(len(sizes))
    last = np.searchsorted(words, words[:-1] + least_words) - 1
    first = np.searchsorted(words, words[1:] - least_words, "right") - 1
    on, up = last < len(sizes), (first >= 0) & (last[first] != places)
    return np.concatenate([places[on], first[up]]), np.concatenate([last[on], places[up]])


def window_digests(chunks: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit digest of every window from those of its chunks."""
    powers = np.cumprod(np.full(len(chunks), _BASE, np.uint64))
    inverse = np.cumprod(np.full(len(chunks), _INVERSE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(chunks.view(np.uint64)) * powers)])
    return mixed((sums[last + 1] - sums[first]) * inverse[first]).view(np.int64)


def _windows(options: Chunking, text: str, placed: bool):
    """The digests of all windows; if ``placed``, with row and number of the window in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gears = options.gears()
        for batch in steps(batches):
            found = []
            for one in texts_of(batch, text):
                ends, sizes = chunk_ends(one or b"", options, gears)
                found.append(window_digests(digests(one or b"", ends), *windows(sizes, options.least_words)))
            columns = {"digest": pa.array(np.concatenate(found), pa.int64())}
            if placed:
                counts = [len(one) for one in found]
                columns["row"] = pa.array(np.repeat(batch.column("row").to_numpy(), counts), pa.int64())
                columns["at"] = pa.array(np.concatenate([np.arange(n) for n in counts]), pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def without(text: bytes, ends: np.ndarray, sizes: np.ndarray, copies: list[int], options: Chunking) -> tuple[bytes, int]:
    """The text without the windows of these numbers, and the number of runs removed."""
    first, last = windows(sizes, options.least_words)
    depth = np.zeros(len(ends) + 1, np.int64)
    np.add.at(depth, first[copies], 1)
    np.add.at(depth, last[copies] + 1, -1)
    step = np.diff((np.cumsum(depth) > 0).astype(np.int8), prepend=0)
    bounds = np.concatenate([[0], ends])
    runs = list(zip(bounds[step == 1].tolist(), bounds[step == -1].tolist(), strict=True))
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return b"".join(kept), len(runs)


def _cut(options: Chunking, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gears = options.gears()
        for batch in steps(batches):
            texts, chunks, removed, spans, sources = [], [], [], [], []
            for one, copies in zip(texts_of(batch, text), batch.column("copies").to_pylist(), strict=True):
                ends, sizes = chunk_ends(one or b"", options, gears)
                chunks.append(len(ends))
                if not copies:
                    texts.append(one), removed.append(0), spans.append(0), sources.append([])
                    continue
                left, runs = without(one, ends, sizes, [copy["at"] for copy in copies], options)
                texts.append(left)
                removed.append(len(one.decode()) - len(left.decode()))
                spans.append(runs)
                sources.append(sorted({copy["kept_in"] for copy in copies if copy["kept_in"] is not None}))
            columns = {name: batch.column(name) for name in batch.schema.names if name != "copies"}
            columns[text] = pa.array(texts, pa.binary()).cast(pa.string())
            columns |= {
                "n_chunks": pa.array(chunks, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_in": pa.array(sources, pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def without_repeats(documents: DataFrame, tables: WorkTables, options: Chunking = Chunking()) -> tuple[Held, DataFrame]:
    """The held columns with the text cut, and what went.

    ``n_chunks``; ``n_removed``: code points; ``n_spans``; ``kept_in``: doc_ids of the documents where the windows removed
    stand first (what such a document shares with an earlier one is cut there too).
    """
    held = Held(documents)
    text = held["text"]
    rows = tables.save(held.table.withColumn("row", F.monotonically_increasing_id()), "rows")
    texts = rows.select("row", text)
    digest = texts.mapInArrow(_windows(options, text, False), schema="digest bigint")
    repeated = tables.save(digest.groupBy("digest").count().filter("count > 1").select("digest"), "repeated")
    placed = texts.mapInArrow(_windows(options, text, True), schema="digest bigint, row bigint, at bigint")
    copies = tables.save(placed.join(repeated, "digest"), "copies")
    firsts = copies.groupBy("digest").agg(F.min(F.struct("row", "at")).alias("first"))
    owners = rows.select(F.col("row").alias("owner"), F.col(held["doc_id"]).cast("bigint").alias("kept_in"))
    firsts = firsts.join(owners, F.col("first.row") == F.col("owner")).drop("owner")
    later = copies.join(firsts, "digest").filter("row != first.row or at != first.at")
    per_row = later.groupBy("row").agg(F.collect_list(F.struct("at", "kept_in")).alias("copies"))
    marked = rows.join(tables.save(per_row, "per_row"), "row", "left").select(*held.names, "row", "copies")
    schema = held.schema("row:bigint,n_chunks:bigint,n_removed:bigint,n_spans:bigint,kept_in:array<bigint>")
    return held, marked.mapInArrow(_cut(options, text), schema=schema)


def repeats_report(documents: DataFrame, tables: WorkTables, options: Chunking = Chunking()) -> DataFrame:
    """Per document: what is left of its text, what went, and the documents that keep the first copies."""
    held, cut = without_repeats(documents.select("doc_id", "text"), tables, options)
    return cut.select(
        F.col(held["doc_id"]).alias("doc_id"),
        "n_chunks",
        "n_spans",
        "n_removed",
        (F.col("n_removed") > 0).alias("repeated"),
        "kept_in",
        F.col(held["text"]).alias("text"),
    )
