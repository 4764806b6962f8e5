"""Benchmark passages in documents: a distributed positional inverted index and offset-adjusted list intersection.

The index is a table of postings: per segment (a bounded batch of documents) and term one row with the documents'
places in the segment and the word positions, plus one row with the documents themselves. It is written once, without a
shuffle. A search takes the lists of the phrases' terms only. A phrase is looked for in a segment if its rarest term
occurs there; its lists, shifted by the terms' offsets, are intersected from the shortest on, so that the work follows
the rarest terms. What remains are exact occurrences. ``proximity`` asks instead for all terms within a span of words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A phrase is a window of ten consecutive words of an item;
an item with fewer, but not none, is one phrase.

Defined cases: null and empty texts have no words. Repeated documents are searched one by one, also under one doc_id or
none. Items without an id mark words as hit but are not counted or named; items under one id count once. Segments hold
a bounded number of bytes (at least one document), so neither a very long text nor a passage that a third of the
documents share gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm.arrow import first_row_number, lists_of, steps, texts_of
from tillstone.operators.storage import WorkTables

WINDOW = 10
SEGMENT_BYTES = 16 << 20
SEGMENT_ROWS = 1 << 16
#: A place in a segment: its row, then the position; the middle bit keeps shifted positions above zero.
ROW_SHIFT, ZERO = np.int64(40), np.int64(1 << 39)

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
WORD_BYTES = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

INDEX = "segment bigint, term binary, n bigint, rows binary, positions binary, keys array<bigint>, sizes array<bigint>"
#: The term of the row that lists a segment's documents.
DOCUMENTS = b""


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Numbering(dict):
    """Term -> its number, in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class Segment:
    """The documents of one segment while it is filled."""

    def __init__(self):
        self.terms, self.found, self.keys, self.size = Numbering(), [], [], 0

    def add(self, key: int | None, text: bytes | None) -> None:
        words = words_of(text)
        self.found.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
        self.keys.append(key)
        self.size += len(text or b"")

    def full(self) -> bool:
        return self.size >= SEGMENT_BYTES or len(self.keys) >= SEGMENT_ROWS

    def postings(self, number: int) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, self.found), np.int64, len(self.found))
        terms = np.concatenate(self.found)
        order = np.argsort(terms, kind="stable")
        rows = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order]
        positions = np.concatenate([np.arange(size, dtype=np.uint32) for size in sizes])[order]
        counts = np.bincount(terms, minlength=len(self.terms))
        ends = np.concatenate([[0], np.cumsum(counts)])
        listed = len(self.terms)
        none = [None] * listed

        def cut(values: np.ndarray) -> pa.Array:
            offsets = pa.py_buffer((ends * values.itemsize).astype(np.int32).tobytes())
            return pa.Array.from_buffers(pa.binary(), listed, [None, offsets, pa.py_buffer(values.tobytes())])

        lists = pa.list_(pa.int64())
        columns = [
            pa.concat_arrays([pa.array(list(self.terms), pa.binary()), pa.array([DOCUMENTS], pa.binary())]),
            pa.array(np.append(counts, len(sizes)), pa.int64()),
            pa.concat_arrays([cut(rows), pa.array([None], pa.binary())]),
            pa.concat_arrays([cut(positions), pa.array([None], pa.binary())]),
            pa.array([*none, self.keys], lists),
            pa.array([*none, sizes.tolist()], lists),
        ]
        segment = pa.array(np.full(listed + 1, number), pa.int64())
        return pa.RecordBatch.from_arrays([segment, *columns], names=[part.split()[0] for part in INDEX.split(", ")])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, segment = first_row_number(), Segment()
    for batch in steps(batches):
        for key, text in zip(batch.column("key").to_pylist(), texts_of(batch), strict=True):
            segment.add(key, text)
            if segment.full():
                yield segment.postings(number)
                number, segment = number + 1, Segment()
    if segment.keys:
        yield segment.postings(number)


def positional_index(documents: DataFrame, tables: WorkTables, key: str = "doc_id") -> DataFrame:
    """The written index over ``documents``; ``key`` names the bigint column that stands for a document."""
    texts = documents.select(F.col(key).cast("bigint").alias("key"), "text")
    return tables.save(texts.mapInArrow(_index, schema=INDEX), "postings")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        found = pa.array([words_of(text) for text in texts_of(batch)], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), found], names=["item_id", "words"])


def phrases_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of every item with words; item_id as text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(_words, schema="item_id string, words array<binary>").filter(F.size("words") > 0).distinct()


class Lists:
    """The places of terms in one segment, as sorted integers."""

    def __init__(self, postings: pa.Table):
        self.places = {}
        for term, rows, positions in zip(
            postings["term"].to_pylist(), postings["rows"].to_pylist(), postings["positions"].to_pylist(), strict=True
        ):
            if term != DOCUMENTS:
                row = np.frombuffer(rows, np.uint16).astype(np.int64)
                self.places[term] = (row << ROW_SHIFT) + ZERO + np.frombuffer(positions, np.uint32)

    def exact(self, words: list[bytes]) -> np.ndarray:
        """First places of all occurrences of the words in a row."""
        lists = [(self.places.get(word), offset) for offset, word in enumerate(words)]
        if any(places is None for places, _ in lists):
            return np.zeros(0, np.int64)
        lists.sort(key=lambda entry: len(entry[0]))
        starts = lists[0][0] - lists[0][1]
        for places, offset in lists[1:]:
            if not len(starts):
                break
            at = np.minimum(places.searchsorted(starts + offset), len(places) - 1)
            starts = starts[places[at] == starts + offset]
        return starts

    def near(self, words: list[bytes], span: int) -> np.ndarray:
        """First places of spans of that many words that hold all the words, in any order."""
        lists = [self.places.get(word) for word in set(words)]
        if any(places is None for places in lists):
            return np.zeros(0, np.int64)
        lists.sort(key=len)
        starts = np.unique(lists[0][:, None] - np.arange(span)).ravel()
        for places in lists[1:]:
            at = np.minimum(places.searchsorted(starts), len(places) - 1)
            starts = starts[(places[at] >= starts) & (places[at] < starts + span)]
        return starts


@dataclass(frozen=True)
class Search:
    """``span`` words that must hold a window's words in any order; None: the words must stand in a row."""

    window: int = WINDOW
    span: int | None = None

    def windows(self, words: list[bytes]) -> list[list[bytes]]:
        size = min(self.window, len(words))
        return [words[at : at + size] for at in range(len(words) - size + 1)]


RESULT = "key bigint, n_words bigint, n_hit bigint, items array<string>"


def _search(search: Search):
    def run(postings: pa.Table, phrases: pa.Table) -> pa.Table:
        documents = postings.filter(pa.array([term == DOCUMENTS for term in postings["term"].to_pylist()]))
        keys, sizes = documents["keys"][0].as_py(), np.array(documents["sizes"][0].as_py(), np.int64)
        lists, hits, items = Lists(postings), [], [set() for _ in keys]
        for item, words in zip(phrases["item_id"].to_pylist(), phrases["words"].to_pylist(), strict=True):
            for window in search.windows(words):
                starts = lists.exact(window) if search.span is None else lists.near(window, search.span)
                if len(starts):
                    hits.append(np.unique(starts[:, None] + np.arange(search.span or len(window))))
                    for row in np.unique(starts >> ROW_SHIFT) if item is not None else ():
                        items[row].add(item)
        n_hit = np.zeros(len(keys), np.int64)
        if hits:
            places = np.unique(np.concatenate(hits))
            rows = places >> ROW_SHIFT
            at = places - (rows << ROW_SHIFT) - ZERO
            rows = rows[(at >= 0) & (at < sizes[np.clip(rows, 0, len(sizes) - 1)])]
            n_hit = np.bincount(rows, minlength=len(keys))
        return pa.table(
            {
                "key": pa.array(keys, pa.int64()),
                "n_words": pa.array(sizes, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array([sorted(found) for found in items], pa.list_(pa.string())),
            }
        )

    return run


def searched(index: DataFrame, phrases: DataFrame, tables: WorkTables, search: Search = Search()) -> DataFrame:
    """(key, n_words, n_hit, items) of every indexed document, for ``phrases`` (item_id, words)."""
    phrases = tables.save(phrases, "phrases")
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    counts = index.select("segment", "term", "n").join(terms, "term", "left_semi")
    frequency = tables.save(terms.join(counts.groupBy("term").agg(F.sum("n").alias("n")), "term", "left"), "frequency")
    # the rarest term of every window; a window with a term that no document has cannot occur
    offsets = phrases.select("item_id", "words", F.posexplode("words").alias("offset", "term"))
    known = offsets.join(frequency, "term").withColumn("size", F.least(F.lit(search.window), F.size("words")))
    first = F.greatest(F.lit(0), F.col("offset") - F.col("size") + 1)
    last = F.least(F.col("offset"), F.size("words") - F.col("size"))
    windows = known.withColumn("window", F.explode(F.sequence(first, last))).groupBy("item_id", "words", "window")
    rarest = windows.agg(F.min_by("term", F.struct("n", "offset")).alias("term"), F.count_if(F.col("n").isNull()).alias("lost"))
    wanted = rarest.filter("lost = 0").select("item_id", "words", "term").distinct()
    present = index.select("segment", "term")
    looked_for = present.join(wanted, "term").select("segment", "item_id", "words").distinct()
    listed = frequency.select("term").union(frequency.sparkSession.range(1).select(F.lit(DOCUMENTS).alias("term")))
    needed = index.join(tables.save(listed, "terms"), "term", "left_semi")
    return (
        needed.groupBy("segment").cogroup(tables.save(looked_for, "wanted").groupBy("segment")).applyInArrow(_search(search), RESULT)
    )


def contamination(documents: DataFrame, benchmark: DataFrame, tables: WorkTables, key: str = "doc_id") -> DataFrame:
    """Exact matches of the benchmark's windows in every document, under ``key``."""
    return searched(positional_index(documents, tables, key), phrases_of(benchmark), tables)


def proximity(documents: DataFrame, benchmark: DataFrame, span: int, tables: WorkTables, key: str = "doc_id") -> DataFrame:
    """The same for windows whose words all lie within ``span`` words, in any order."""
    return searched(positional_index(documents, tables, key), phrases_of(benchmark), tables, Search(span=span))
