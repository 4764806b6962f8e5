"""Product codes of vectors by k-means with the adaptive bounds of Drake and Hamerly.

A component x becomes the integer ``floor(scale * x)``; vectors are cut into equal consecutive parts, and each part
position has a codebook of its own. It starts as that part of the vectors of the smallest vec_ids. A round assigns every
part to the nearest entry (squared Euclidean distance, ties to the lower index) and moves every entry to the floor of its
parts' mean; an entry without parts stays. After the rounds parts are assigned once more.

Between rounds each part keeps, in a written table beside its integers, its ``b`` closest other entries in the order of
lower bounds on their distances, and one outer bound on the distance of all the rest. When entries move, the bounds sink
by as much. A part whose own entry, measured anew, is nearer than all bounds stays where it is; otherwise the entries
whose bounds it has passed are measured, and only a part that has passed its outer bound is compared with the whole
codebook. After each round ``b`` shrinks to what all but a few parts needed. Bounds are 32-bit numbers rounded down, own
distances are rounded up; whatever they leave open is settled on integers, so that codes are exact.

Entries, their sums and counts are the only things that reach the driver; their number depends on the parameters alone.
Sums are taken per task before they are shuffled. Totals of frequent labels, whose number is bounded, are sent to all
tasks, those of the others are joined.

Defined cases: rows whose vector is null or holds null, NaN or an infinity are left out. A null vec_id is larger than all
others; rows that repeat one are vectors of their own, in the order of their bytes. With fewer vectors than entries
the codebook is as short. Empty tables give empty results. All vectors must have one length that the parts divide, and
squared distances must fit 64-bit integers; otherwise ``ValueError`` is raised. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm.arrow import Held
from tillstone.llm.skew import MOST_FREQUENT, with_totals
from tillstone.operators.storage import WorkTables


@dataclass(frozen=True)
class Codes:
    """``closest``: how many other entries a part keeps at first; ``least_closest``: how many it keeps in any case;
    ``spare``: share of parts that may have to look at the whole codebook when ``b`` shrinks."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    closest: int = 16
    least_closest: int = 4
    spare: float = 0.01


#: Vectors that a step works on, and vectors that are compared with a whole codebook at a time.
ROWS = 4096
KEPT = "vec_id bigint, label bigint, whole binary"
#: ``codes``: a part's entry; ``near``, ``low``: its closest other entries and bounds; ``outer``: the outer bound;
#: ``needed``: how many bounds it passed, more than there are if the outer one.
STATE = f"{KEPT}, codes binary, error bigint, near binary, low binary, outer binary, needed binary"


def kept(table: DataFrame, options: Codes) -> DataFrame:
    """(vec_id, label, whole): vectors of finite components as 32-bit integers, which hold all whose distances fit 64 bits."""
    held = Held(table)
    vector = F.col(held["embedding"])
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = held.table.select(
        F.col(held["vec_id"]).cast("bigint").alias("vec_id"),
        F.col(held["label"]).cast("bigint").alias("label"),
        vector.cast("array<double>").alias("vector"),
    ).filter(F.col("vector").isNotNull() & finite)
    return rows.mapInArrow(_whole(options.scale), schema=KEPT)


def _whole(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch for batch in batches if batch.num_rows):
            vectors = batch.column("vector")
            ends = 4 * (vectors.offsets.to_numpy() - vectors.offsets[0].as_py())
            scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale)
            if np.abs(scaled).max(initial=0) >= 1 << 31:
                raise ValueError("squared distances do not fit 64-bit integers")
            buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(scaled.astype("<i4").tobytes())]
            whole = pa.Array.from_buffers(pa.binary(), batch.num_rows, buffers)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), whole], names=["vec_id", "label", "whole"])

    return run


class Codebook:
    """Entries of all part positions, shaped (part, entry, place), as integers; how far each moved last."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries = entries
        self.moved = moved

    def moved_to(self, entries: np.ndarray) -> Codebook:
        gaps = (entries - self.entries).astype(np.float64)
        return Codebook(entries, np.sqrt((gaps * gaps).sum(axis=2)) * (1 + 1e-9))

    @property
    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def down(distances: np.ndarray) -> np.ndarray:
    """As 32-bit numbers that are no larger."""
    return np.maximum(distances * (1 - 1e-6), 0).astype(np.float32)


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every entry."""
    # |p|^2 - 2 p.e + |e|^2; products and sums of these sizes are exact as doubles, and larger ones as integers
    most = max((int(np.abs(one).max()) for one in (points, entries) if one.size), default=0)
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    found = (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]
    return found.astype(np.int64)


def compared(points: np.ndarray, entries: np.ndarray, closest: int) -> tuple[np.ndarray, ...]:
    """Codes, their squared distances, and the closest other entries with bounds and outer bound, from scratch."""
    all_squares = squares(points, entries)
    codes = all_squares.argmin(axis=1)  # the first of the least
    rows = np.arange(len(points))
    error = all_squares[rows, codes]
    others = all_squares.astype(np.float64)
    others[rows, codes] = np.inf
    count = min(closest + 1, len(entries))
    near = np.argpartition(others, count - 1, axis=1)[:, :count]
    low = np.take_along_axis(others, near, axis=1)
    order = np.argsort(low, axis=1, kind="stable")
    near, low = np.take_along_axis(near, order, axis=1), down(np.sqrt(np.take_along_axis(low, order, axis=1)))
    if count <= closest:  # the list holds the whole codebook; its last place is the code itself, infinitely far
        fill = closest + 1 - count
        near = np.pad(near, ((0, 0), (0, fill)))
        low = np.pad(low, ((0, 0), (0, fill)), constant_values=np.inf)
    return codes, error, near[:, :closest], low[:, :closest], low[:, closest]


def adapted(points, entries, moved, closest, codes, near, low, outer) -> tuple[np.ndarray, ...]:
    """The same from the bounds of the round before; the last array says how many bounds each point had passed."""
    width = min(closest, near.shape[1])
    if width < near.shape[1]:
        outer = np.minimum(outer, low[:, width])  # what is no longer listed is at least that far
    near, low = near[:, :width].copy(), low[:, :width]
    low = down(low.astype(np.float64) - moved[near])
    outer = down(outer.astype(np.float64) - moved.max(initial=0.0))
    # a bound holds for all that follow it, too, once they are no smaller
    bounds = np.minimum.accumulate(np.concatenate([low, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    gaps = points - entries[codes]
    error = (gaps * gaps).sum(axis=1)
    reach = np.sqrt(error.astype(np.float64)) * (1 + 1e-9)
    needed = (bounds <= reach[:, None]).sum(axis=1)  # an entry at the same distance may have the lower index
    codes, near, low, outer = codes.copy(), near.copy(), bounds[:, :width].copy(), bounds[:, width].copy()

    some = np.flatnonzero((needed > 0) & (needed <= width))
    if len(some):
        most = int(needed[some].max())
        listed = near[some, :most]
        gaps = points[some][:, None, :] - entries[listed]
        measured = (gaps * gaps).sum(axis=2)
        asked = np.arange(most)[None, :] < needed[some][:, None]
        # candidates: the point's own entry first, then those whose bounds it has passed
        ids = np.concatenate([codes[some][:, None], listed], axis=1)
        found = np.concatenate([error[some][:, None], measured], axis=1)
        open_ = np.concatenate([np.ones((len(some), 1), bool), asked], axis=1)
        least = np.where(open_, found, np.iinfo(np.int64).max).min(axis=1)
        winner = np.where(open_ & (found == least[:, None]), ids, len(entries)).min(axis=1)
        place = (ids == winner[:, None]).argmax(axis=1)
        rows = np.arange(len(some))
        # the own entry takes the winner's place in the list
        ids[rows, place], found[rows, place] = ids[:, 0], found[:, 0]
        bound = np.where(asked, down(np.sqrt(found[:, 1:].astype(np.float64))), low[some, :most])
        moved_in = place > 0
        bound[rows[moved_in], place[moved_in] - 1] = down(np.sqrt(error[some][moved_in].astype(np.float64)))
        codes[some], error[some] = winner, least
        every = np.concatenate([ids[:, 1:], near[some, most:]], axis=1)
        bound = np.concatenate([bound, low[some, most:]], axis=1)
        order = np.argsort(bound, axis=1, kind="stable")
        near[some], low[some] = np.take_along_axis(every, order, axis=1), np.take_along_axis(bound, order, axis=1)
    whole = np.flatnonzero(needed > width)
    if len(whole):
        codes[whole], error[whole], near[whole], low[whole], outer[whole] = compared(points[whole], entries, width)
    return codes, error, near, low, outer, needed


def _assign(book: Codebook, options: Codes, closest: int):
    parts, entries = book.entries.shape[:2]
    kind = np.dtype("u1" if entries <= 1 << 8 else "<u4")

    def split(batch: pa.RecordBatch, name: str, number: np.dtype | str, shape: tuple) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), number).reshape(batch.num_rows, *shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = book.entries.shape[2]
        limit = int(np.abs(book.entries).max(initial=0))
        for batch in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            whole = batch.column("whole").to_pylist()
            if any(len(one) != 4 * parts * size for one in whole):
                raise ValueError(f"vectors of other than {parts * size} components, the first one's")
            points = split(batch, "whole", "<i4", (parts, size)).astype(np.int64)
            if 4 * size * max(limit, int(np.abs(points).max(initial=0))) ** 2 >= 1 << 63:
                raise ValueError("squared distances do not fit 64-bit integers")
            first = "codes" not in batch.schema.names
            if not first:
                had = split(batch, "near", kind, (parts, -1)).shape[2]
                codes, near = split(batch, "codes", kind, (parts,)), split(batch, "near", kind, (parts, had))
                low, outer = split(batch, "low", "<f4", (parts, had)), split(batch, "outer", "<f4", (parts,))
            made = []
            for part in range(parts):
                own, table = points[:, part], book.entries[part]
                if first:
                    made.append((*compared(own, table, closest), np.full(len(own), closest + 1)))
                else:
                    made.append(adapted(own, table, book.moved[part], closest, codes[:, part].astype(np.int64),
                                        near[:, part].astype(np.int64), low[:, part], outer[:, part]))
            columns = [np.stack(one, axis=1) for one in zip(*made, strict=True)]
            now, error, near, low, outer, needed = columns
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("vec_id", "label", "whole")),
                    _binary(now.astype(kind)),
                    pa.array(error.sum(axis=1), pa.int64()),
                    _binary(near.astype(kind)),
                    _binary(low.astype("<f4")),
                    _binary(outer.astype("<f4")),
                    _binary(needed.astype("<u2")),
                ],
                names=[one.split()[0] for one in STATE.split(", ")],
            )

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    return pa.array([one.tobytes() for one in data], pa.binary())


SUMS = "part int, entry int, place int, total decimal(38,0), rows bigint"


def _sums(shape: tuple[int, int, int], closest: int):
    """Per task: sums and counts of every entry's parts; how many parts passed how many bounds (entry -1)."""
    parts, entries, size = shape
    kind = np.dtype("u1" if entries <= 1 << 8 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(shape, object), np.zeros((parts, entries), np.int64)
        passed = np.zeros(closest + 2, np.int64)
        for batch in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            whole, codes, needed = (b"".join(batch.column(name).to_pylist()) for name in ("whole", "codes", "needed"))
            points = np.frombuffer(whole, "<i4").reshape(batch.num_rows, parts, size).astype(np.int64)
            chosen = np.frombuffer(codes, kind).reshape(batch.num_rows, parts).astype(np.int64)
            for part in range(parts):
                step = np.zeros((entries, size), np.int64)
                np.add.at(step, chosen[:, part], points[:, part])
                totals[part] += step.astype(object)  # a task's sums may need more than 64 bits
                counts[part] += np.bincount(chosen[:, part], minlength=entries)
            passed += np.bincount(np.minimum(np.frombuffer(needed, "<u2"), closest + 1), minlength=closest + 2)
        rows = [
            (part, entry, place, int(totals[part, entry, place]), int(counts[part, entry]))
            for part, entry in np.argwhere(counts).tolist()
            for place in range(size)
        ]
        rows += [(0, -1, at, 0, int(count)) for at, count in enumerate(passed.tolist()) if count]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[one.split()[0] for one in SUMS.replace("(38,0)", "").split(", ")])

    return run


def updated(state: DataFrame, book: Codebook, options: Codes, closest: int) -> tuple[Codebook, int]:
    """The codebook moved to the means; how many closest entries to keep next."""
    sums = state.select("whole", "codes", "needed").mapInArrow(_sums(book.entries.shape, closest), schema=SUMS)
    added = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    entries, passed = book.entries.copy(), np.zeros(closest + 2, np.int64)
    for row in added.collect():  # as many as the codebooks have components
        if row["entry"] < 0:
            passed[row["place"]] = row["rows"]
        else:
            entries[row["part"], row["entry"], row["place"]] = int(row["total"]) // row["rows"]
    beyond = passed[::-1].cumsum()[::-1]  # parts that passed at least so many bounds
    wanted = int(np.argmax(np.append(beyond[1:], 0) <= options.spare * max(1, passed.sum())))
    return book.moved_to(entries), max(min(options.least_closest, closest), min(closest, wanted))


def first_codebook(rows: DataFrame, options: Codes) -> Codebook | None:
    """Parts of the vectors of the smallest ids; None without vectors."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "whole").limit(options.entries).collect()
    if not first:
        return None
    sizes = {len(row["whole"]) for row in first}
    if len(sizes) > 1 or min(sizes) // 4 % options.parts:
        raise ValueError(f"vectors must have one length that {options.parts} parts divide")
    vectors = np.stack([np.frombuffer(row["whole"], "<i4") for row in first]).astype(np.int64)
    return Codebook(np.ascontiguousarray(vectors.reshape(len(first), options.parts, -1).transpose(1, 0, 2)))


def with_label_totals(rows: DataFrame, most: int = MOST_FREQUENT) -> DataFrame:
    """Add ``label_error``, the sum of ``error`` over rows of one label."""
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return with_totals(rows, totals, "label", "n", most)


@dataclass(frozen=True)
class Coded:
    """``rows``: vec_id, label, code, error, label_error; ``codebook``: the final entries, None without vectors."""

    rows: DataFrame
    codebook: Codebook | None


def coded(table: DataFrame, tables: WorkTables, options: Codes = Codes()) -> Coded:
    """Codes of all vectors of (vec_id, embedding, label), and the codebooks they refer to."""
    state = tables.replace(kept(table, options), "vectors")
    book, closest = first_codebook(state, options), options.closest
    if book is None:
        empty = "vec_id bigint, label bigint, code string, error bigint, label_error bigint"
        return Coded(table.sparkSession.createDataFrame([], empty), None)
    for turn in range(options.rounds + 1):
        if turn:
            state = state.drop("error", "needed")
        state = tables.replace(state.mapInArrow(_assign(book, options, closest), schema=STATE), "state")
        if turn == 0:
            tables.discard("vectors")
        if turn < options.rounds:
            book, closest = updated(state, book, options, closest)
    done = state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    return Coded(with_label_totals(done), book)
