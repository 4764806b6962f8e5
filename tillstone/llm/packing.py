"""Sequence packing by non-negative least squares on the histogram of lengths.

A document's tokens are cut into pieces of one window and a shorter rest. The histogram of the pieces' lengths has at
most as many bins as the window has tokens. All combinations of at most ``depth`` lengths that fill a window exactly are
enumerated, and repeat counts are solved for, non-negative and with least squares against the histogram. The counts are
rounded down, then up as long as pieces are left; what no combination takes is packed greedily, longest first and cut at
window ends, and the last, partial window is cut into powers of two. So no sequence needs padding.

Pieces of one length are numbered (per partition of the written token table, then over partitions), and a piece's
number and length alone give its sequence and offset: combinations hold intervals of numbers, the greedy rest is one
stream of known lengths. Only the histogram reaches the driver; its size depends on the window, never on the data. No
length, however frequent, meets in one task.

Defined cases: a null text is an empty one, and an empty document is its closing token alone. Repeated rows are packed
one by one. Texts of any length are tokenized whole.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstone.llm.arrow import steps
from tillstone.llm.token_ids import TokenIds
from tillstone.operators.storage import WorkTables


@dataclass(frozen=True)
class Packing:
    """``cached_pieces`` bounds the memory of a worker's table of encoded pieces of words."""

    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    window: int = 2048
    closing_id: int = 1
    depth: int = 3
    steps: int = 150
    cached_pieces: int = 500_000


TOKENS = "doc_id bigint, start bigint, length int, doc_tokens bigint, part int, place bigint, ids_crc32 bigint, ids binary"


def closed(ids: np.ndarray, ends: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' ids in a row with the closing id after each, and where each begins and the last one ends."""
    return np.insert(ids, ends[1:], closing).astype("<u4"), ends + np.arange(len(ends))


def _tokenize(options: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenIds.of_worker(options.tokenizer, options.cached_pieces)
        part, size = TaskContext.get().partitionId(), options.window
        places = [0] * (size + 1)
        for batch in steps(batches, 2048, 8 << 20):
            ids, ends = closed(*table.ids([text or "" for text in batch.column("text").to_pylist()]), options.closing_id)
            totals = np.diff(ends)
            pieces = -(-totals // size)
            doc = np.repeat(np.arange(len(totals)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
            length = np.minimum(size, totals[doc] - start)
            bounds = np.append(ends[:-1][doc] + start, ends[-1])
            data, cuts = ids.tobytes(), (4 * bounds).tolist()
            view = memoryview(data)
            place = []
            for one in length.tolist():
                place.append(places[one])
                places[one] += 1
            columns = [
                batch.column("doc_id").take(pa.array(doc)),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int32()),
                pa.array(totals[doc], pa.int64()),
                pa.array(np.full(len(doc), part), pa.int32()),
                pa.array(place, pa.int64()),
                pa.array([zlib.crc32(view[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(4 * bounds), pa.py_buffer(data)]).cast(pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[column.split()[0] for column in TOKENS.split(", ")])

    return run


def tokens(documents: DataFrame, tables: WorkTables, options: Packing = Packing()) -> DataFrame:
    """The written table of pieces of at most a window, each with its place among its partition's pieces of that length."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return tables.save(texts.mapInArrow(_tokenize(options), schema=TOKENS), "tokens")


def combinations(lengths: np.ndarray, window: int, depth: int) -> np.ndarray:
    """All ascending combinations of at most ``depth`` of the lengths that add up to the window; zeros fill a row."""
    known = np.zeros(window + 1, bool)
    known[lengths] = True
    found = [[window, *[0] * (depth - 1)]] if known[window] else []
    for count in range(2, depth + 1):
        small = lengths[lengths <= window // count]
        for head in itertools.combinations_with_replacement(small.tolist(), count - 2):
            a = lengths[lengths >= (head[-1] if head else 1)]
            b = window - sum(head) - a
            good = (b >= a) & known[np.clip(b, 0, window)] & (b > 0)
            rows = np.zeros((int(good.sum()), depth), np.int64)
            rows[:, : len(head)] = head
            rows[:, len(head)], rows[:, len(head) + 1] = a[good], b[good]
            found.extend(rows.tolist())
    return np.array(found, np.int64).reshape(-1, depth)


def solved(combos: np.ndarray, histogram: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative repeat counts of the combinations with least squares against the histogram.

    Multiplicative steps: counts stay positive and the error never grows.
    """
    wanted = histogram.astype(float)
    wanted[0] = 0
    counts = np.ones(len(combos))
    gain = wanted[combos].sum(axis=1)
    for _ in range(rounds):
        used = np.bincount(combos.ravel(), np.repeat(counts, combos.shape[1]), len(wanted))
        used[0] = 0
        counts *= gain / np.maximum(used[combos].sum(axis=1), 1e-12)
    return counts


def rounded(combos: np.ndarray, counts: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole counts: rounded down, then raised for the largest remainders while all their lengths are left."""
    whole = np.floor(counts).astype(np.int64)
    while True:
        used = np.bincount(combos.ravel(), np.repeat(whole, combos.shape[1]), len(histogram)).astype(np.int64)
        over = np.flatnonzero((used > histogram) & (np.arange(len(used)) > 0))
        if not len(over):
            break
        whole[np.isin(combos, over).any(axis=1) & (whole > 0)] -= 1
    left = histogram - used
    for at in np.argsort(whole - counts, kind="stable"):
        lengths, needs = np.unique(combos[at][combos[at] > 0], return_counts=True)
        more = int((left[lengths] // needs).min())
        if more > 0:
            more = more if counts[at] >= 0.5 else 1
            whole[at] += more
            left[lengths] -= more * needs
    return whole


@dataclass(frozen=True)
class Plan:
    """Combinations and the stream.

    ``slots``: (length, first number, number after the last, sequence of the first, offset); ``used``: pieces of a length
    that combinations take; ``stream``: where the other pieces of a length begin in the stream; ``total``: tokens of the
    stream; ``first_sequence``: its first sequence.
    """

    slots: list[tuple[int, int, int, int, int]]
    used: dict[int, int]
    stream: dict[int, int]
    total: int
    first_sequence: int


def planned(histogram: dict[int, int], options: Packing) -> Plan:
    """Where the pieces of every length go, by their numbers."""
    bins = np.zeros(options.window + 1, np.int64)
    for length, count in histogram.items():
        bins[length] = count
    combos = combinations(np.flatnonzero(bins), options.window, options.depth)
    whole = rounded(combos, solved(combos, bins, options.steps), bins) if len(combos) else np.zeros(0, np.int64)
    used, slots, sequence = dict.fromkeys(histogram, 0), [], 0
    for combo, count in zip(combos[whole > 0].tolist(), whole[whole > 0].tolist(), strict=True):
        offset = 0
        for length in filter(None, combo):
            slots.append((length, used[length], used[length] + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    stream, total = {}, 0
    for length in sorted(histogram, reverse=True):
        stream[length] = total
        total += (histogram[length] - used[length]) * length
    return Plan(slots, used, stream, total, sequence)


def numbered(pieces: DataFrame, tables: WorkTables) -> tuple[DataFrame, dict[int, int]]:
    """``pieces`` without ids, with ``number`` among all pieces of a length; the histogram of lengths."""
    counts = tables.save(pieces.groupBy("part", "length").count(), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slim = pieces.drop("ids").join(bases, ["part", "length"])
    return slim.withColumn("number", F.col("base") + F.col("place")).drop("base"), histogram


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table whose size the window bounds."""
    return spark.createDataFrame(rows, schema)


def placed(pieces: DataFrame, plan: Plan, options: Packing) -> tuple[DataFrame, DataFrame]:
    """Pieces that a combination takes, with sequence and offset; the others, with their place in the stream."""
    spark = pieces.sparkSession
    by_length: dict[int, list[tuple]] = {length: [] for length in plan.used}
    for length, *slot in plan.slots:
        by_length[length].append(tuple(slot))
    rows = [(length, plan.used[length], plan.stream[length], by_length[length]) for length in by_length]
    kind = "array<struct<low:bigint,high:bigint,sequence:bigint,offset:bigint>>"
    lengths = literal(spark, rows, f"length int, used bigint, stream bigint, slots {kind}")
    joined = pieces.join(F.broadcast(lengths), "length")
    taken = joined.filter("number < used").withColumn(
        "slot", F.get(F.filter("slots", lambda s: (s["low"] <= F.col("number")) & (F.col("number") < s["high"])), F.lit(0))
    )
    taken = taken.withColumn("sequence_id", F.expr("slot.sequence + number - slot.low")).withColumn("offset", F.col("slot.offset"))
    rest = joined.filter("number >= used").withColumn("at", F.expr("stream + (number - used) * length"))
    return taken, rest


def ends_of_sequences(plan: Plan, options: Packing) -> list[tuple[int, int, int]]:
    """(sequence, from, to) of the partial window at the end of the stream, in powers of two."""
    at = plan.total // options.window * options.window
    sequence, tail = plan.first_sequence + plan.total // options.window, []
    while at < plan.total:
        size = 1 << ((plan.total - at).bit_length() - 1)
        tail.append((sequence, at, at + size))
        sequence, at = sequence + 1, at + size
    return tail


def cut_rest(rest: DataFrame, pieces: DataFrame, plan: Plan, options: Packing) -> DataFrame:
    """The pieces of the stream, cut at the ends of its sequences."""
    size, full = options.window, plan.total // options.window
    spans_kind = "array<struct<sequence:bigint,low:bigint,high:bigint>>"

    def span(sequence, low, high):
        return F.struct(sequence.alias("sequence"), low.alias("low"), high.alias("high"))

    whole = F.transform(
        F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + length - 1) div {size}")),
        lambda k: span(k + plan.first_sequence, k * size, (k + 1) * size),
    )
    whole = F.filter(whole, lambda s: s["high"] <= full * size)
    tail = F.array(*(span(*map(F.lit, one)) for one in ends_of_sequences(plan, options))).cast(spans_kind)
    spans = F.filter(
        F.concat(whole.cast(spans_kind), tail), lambda s: (s["low"] < F.expr("at + length")) & (F.col("at") < s["high"])
    )
    cut = rest.withColumn("span", F.explode(spans))
    cut = cut.withColumn("low", F.expr("greatest(at, span.low)")).withColumn("high", F.expr("least(at + length, span.high)"))
    # pieces of a whole window are sequences of their own, and are left out of the join
    ids = pieces.filter(F.col("length") < size).select("part", "length", "place", "ids")
    cut = cut.drop("ids_crc32").join(ids, ["part", "length", "place"])
    part = F.expr("substring(ids, cast(4 * (low - at) + 1 as int), cast(4 * (high - low) as int))")
    return cut.select(
        "doc_id",
        F.expr("start + low - at").alias("start"),
        F.expr("high - low").alias("length"),
        F.crc32(part).alias("ids_crc32"),
        "doc_tokens",
        F.col("span.sequence").alias("sequence_id"),
        F.expr("low - span.low").alias("offset"),
    )


def packed(documents: DataFrame, tables: WorkTables, options: Packing = Packing()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = tokens(documents, tables, options)
    slim, histogram = numbered(pieces, tables)
    plan = planned(histogram, options)
    taken, rest = placed(tables.save(slim, "numbered"), plan, options)
    columns = ["doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return taken.select(*columns).union(cut_rest(rest, pieces, plan, options))
