import hashlib
import math

import numpy as np
import pytest

from tillstone.llm import vector_codes
from tillstone.llm.vector_codes import Codes

FOLDER = "/root/testdata/sf0.01"


def expected(rows, options=Codes()):
    """The same by plain k-means: (vec_id, code, error, label_error) and the codebook's digest."""
    good = [
        (vec, [math.floor(options.scale * x) for x in vector], label)
        for vec, vector, label in rows
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    if not good:
        return [], None
    good.sort(key=lambda row: (row[0] is None, row[0] or 0, np.array(row[1], "<i4").tobytes()))
    points = np.array([one for _, one, _ in good], np.int64).reshape(len(good), options.parts, -1)
    codes, errors, books = [], [], []
    for part in range(options.parts):
        own = points[:, part]
        book = own[: options.entries].copy()

        def nearest(book, own=own):
            found = np.stack([((own - entry) ** 2).sum(axis=1) for entry in book], axis=1)
            return found.argmin(axis=1), found.min(axis=1)

        for _ in range(options.rounds):
            chosen, _ = nearest(book)
            for entry in set(chosen.tolist()):
                book[entry] = own[chosen == entry].sum(axis=0) // int((chosen == entry).sum())
        chosen, error = nearest(book)
        codes.append(chosen), errors.append(error), books.append(book)
    total = sum(errors).tolist()
    by_label = {}
    for (_, _, label), error in zip(good, total, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    return [
        (vec, "".join(f"{chosen[at]:02x}" for chosen in codes), total[at], by_label[label])
        for at, (vec, _, label) in enumerate(good)
    ], digest


def check(spark, tables, rows, options=Codes(), kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").repartition(3)
    found = vector_codes.coded(frame, tables, options)
    got = [tuple(row) for row in found.rows.select("vec_id", "code", "error", "label_error").collect()]
    wanted, digest = expected(rows, options)
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert (found.codebook and found.codebook.digest) == digest


def cloud(seed, count, size=16, centres=30):
    source = np.random.default_rng(seed)
    middles = source.normal(size=(centres, size))
    points = middles[source.integers(0, centres, count)] + 0.3 * source.normal(size=(count, size))
    return [(int(at) * 3, [float(np.float32(x)) for x in point], int(at) % 5 or None) for at, point in enumerate(points)]


@pytest.mark.parametrize("options", [Codes(), Codes(entries=40, rounds=9, closest=6, least_closest=2), Codes(parts=2, entries=7, closest=16)])
def test_equals_plain_k_means(spark, tables, options):
    check(spark, tables, cloud(1, 900), options)


def test_odd_vectors(spark, tables):
    nan, inf = float("nan"), float("inf")
    rows = cloud(2, 40, size=4)
    rows += [(1, None, 1), (2, [1.0, None, 2.0, 3.0], 1), (4, [nan, 1.0, 1.0, 1.0], 2), (5, [1.0, inf, 1.0, 1.0], 2), (7, [-inf] * 4, None)]
    rows += [(None, [0.5, -0.5, 0.25, -0.001], None), (None, [0.0, -0.0, 1e-9, -1e-9], 3)]
    rows += [(1000, [1.0, 1.0, 1.0, 1.0], 9)] * 30  # equal vectors: ties among entries
    check(spark, tables, rows, Codes(entries=20))
    check(spark, tables, rows, Codes(entries=250), "double")


def test_large_components(spark, tables):
    rows = [(at, [float((at * 7919 + place * 104729) % 400_000 - 200_000) for place in range(8)], at % 2) for at in range(200)]
    check(spark, tables, rows, Codes(entries=16), "double")
    with pytest.raises(Exception, match="64-bit"):
        check(spark, tables, [(1, [1e30] * 4, 1)], kind="double")


def test_lengths_must_agree(spark, tables):
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 5, 1)]):
        with pytest.raises(Exception, match="length|components"):
            check(spark, tables, rows)


def test_no_vectors(spark, tables):
    check(spark, tables, [])
    check(spark, tables, [(1, None, 1)])
    check(spark, tables, [(1, [], 1), (2, [], 2)])


def test_clashing_columns(spark, tables):
    rows = [(*row, "x", "y") for row in cloud(3, 30, size=4)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, whole string, CODES string")
    assert vector_codes.coded(frame, tables).rows.count() == 30


def test_labels_frequent_and_rare(spark):
    rows = [(at, 1 if at % 3 else at, at) for at in range(300)] + [(300, None, 5), (301, None, 6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, label bigint, error bigint")
    wanted = {}
    for _, label, error in rows:
        wanted[label] = wanted.get(label, 0) + error
    for most in (3, 20, 1 << 16):
        found = vector_codes.with_label_totals(frame, most).collect()
        assert len(found) == len(rows)
        assert all(row["label_error"] == wanted[row["label"]] for row in found)


def test_whole_table(spark, tables):
    rows = [tuple(row) for row in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(spark, tables, rows)


def test_bounds_spare_comparisons():
    """The bounds of a round hold for the entries that have moved, and most points need none measured."""
    source = np.random.default_rng(5)
    points = source.integers(-1000, 1000, (3000, 8))
    entries = points[:64].copy()
    codes, error, near, low, outer = vector_codes.compared(points, entries, 12)
    for _ in range(6):
        after = entries + source.integers(-20, 21, entries.shape)
        moved = np.sqrt(((after - entries) ** 2).sum(axis=1)) * (1 + 1e-9)
        entries = after
        codes, error, near, low, outer, needed = vector_codes.adapted(points, entries, moved, 12, codes, near, low, outer)
        squares = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (codes == squares.argmin(axis=1)).all() and (error == squares.min(axis=1)).all()
        distances = np.sqrt(squares)
        assert (np.take_along_axis(distances, near, axis=1) >= low).all()
        rest = np.ones(squares.shape, bool)
        np.put_along_axis(rest, near, False, axis=1)
        rest[np.arange(len(points)), codes] = False
        assert (np.where(rest, distances, np.inf) >= outer[:, None]).all()
        assert (np.diff(low, axis=1) >= 0).all()
    assert (needed <= 12).mean() > 0.9 and (needed == 0).any()
