"""Scaling, K-means and silhouettes over customer features."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
#: Coordinates are clustered as whole numbers of this unit, so that sums and means are exact in any order.
UNIT = 10**DIGITS
MOVEMENT = 1e-4
#: The same in square units.
SETTLED = round(MOVEMENT * UNIT**2)

#: Coordinates are below this, so that differences of two are exact in doubles. A z-score is at most the root of the number
#: of rows, so those of 1e19 rows are.
FARTHEST = 1 << 52

Centre = tuple[int, ...]


def standardize(table: DataFrame, features: Mapping[str, str], digits: int | None = DIGITS) -> DataFrame:
    """Add z-scores with the population deviation; ``features`` maps a column to its z-score column.

    They are rounded to ``digits`` places, if any. A constant column has no spread to divide by and is only centred.
    """
    measures = [
        measure
        for column in features
        for measure in (
            F.avg(F.col(column).cast("double")).alias(f"{column}_mean"),
            F.stddev_pop(F.col(column).cast("double")).alias(f"{column}_deviation"),
        )
    ]
    moments = table.agg(*measures).first()

    def score(column: str) -> Column:
        mean, deviation = F.lit(moments[f"{column}_mean"]), F.lit(moments[f"{column}_deviation"] or 1.0)
        z = (F.col(column).cast("double") - mean) / deviation
        return z if digits is None else F.round(z, digits)

    return table.withColumns({z: score(column) for column, z in features.items()})


def in_units(columns: Sequence[str]) -> list[Column]:
    """Coordinates as whole units."""
    return [F.round(F.col(column) * F.lit(float(UNIT))).cast("bigint") for column in columns]


def _square(values: Sequence[Column], centre: Sequence[Column]) -> Column:
    """Squared distance in doubles, added up in the order of the columns."""
    gaps = [(value - place).cast("double") for value, place in zip(values, centre, strict=True)]
    return reduce(lambda total, gap: total + gap, [gap * gap for gap in gaps])


def _first_least(squares: Sequence[Column]) -> Column:
    """Number of the smallest of some columns; the first of equal ones; nulls are passed over."""
    least = F.least(*squares) if len(squares) > 1 else squares[0]
    return F.coalesce(*[F.when(square == least, number) for number, square in enumerate(squares)])


def with_nearest(points: DataFrame, columns: Sequence[str], centres: Sequence[Centre], cluster: str = "cluster") -> DataFrame:
    """Add the index of the closest centre (in units); the lower index wins a tie.

    Units and distances are columns of their own first: each is needed several times and rounding is dear.
    """
    units = {f"_unit{place}": unit for place, unit in enumerate(in_units(columns))}
    squares = {
        f"_square{number}": _square([F.col(unit) for unit in units], [F.lit(place) for place in centre])
        for number, centre in enumerate(centres)
    }
    measured = points.withColumns(units).withColumns(squares)
    return measured.withColumn(cluster, _first_least([F.col(square) for square in squares])).drop(*units, *squares)


def nearest(columns: Sequence[str], centres: Sequence[Centre]) -> Column:
    """The same as one expression, which works everything out anew wherever it is needed."""
    values = in_units(columns)
    return _first_least([_square(values, [F.lit(place) for place in centre]) for centre in centres])


@dataclass(frozen=True)
class Fit:
    """Centres in units, the sum of squared distances to them in square units, and the number of steps taken."""

    centres: tuple[Centre, ...]
    cost: int
    steps: int

    @property
    def inertia(self) -> float:
        return self.cost / UNIT**2


Batches = Iterator[pa.RecordBatch]


def _coordinates(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of a batch in doubles, which hold them exactly."""
    values = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
    if any(len(value) and max(int(value.max()), -int(value.min())) >= FARTHEST for value in values):
        raise OverflowError("a coordinate is too large to be clustered")
    return [value.astype(np.float64) for value in values]


def _closest(values: Sequence[np.ndarray], centres: Sequence[Centre]) -> np.ndarray:
    """Index of the closest centre of every point, as ``nearest`` finds it."""
    cluster, least = np.zeros(len(values[0]), np.intp), None
    for number, centre in enumerate(centres):
        square = None
        for value, place in zip(values, centre, strict=True):
            gap = value - np.float64(place)
            gap *= gap
            square = gap if square is None else np.add(square, gap, out=square)
        if least is None:
            least = square
        else:
            cluster[square < least] = number
            np.minimum(least, square, out=least)
    return cluster


def _sums(cluster: np.ndarray, values: Sequence[np.ndarray], clusters: int) -> np.ndarray:
    """Number of points and exact sums of their coordinates, a row per cluster."""
    farthest = max((float(np.abs(value).max()) for value in values if len(value)), default=0.0)
    step = max(1, int(2**53 // max(farthest, 1.0)))  # a sum of so many points is exact in doubles
    total = np.zeros((clusters, 1 + len(values)), np.int64)
    for start in range(0, len(cluster), step):
        part = cluster[start : start + step]
        total[:, 0] += np.bincount(part, minlength=clusters)
        for place, value in enumerate(values, 1):
            total[:, place] += np.bincount(part, value[start : start + step], clusters).astype(np.int64)
    return total


def _rows_of(tables: Mapping[int, np.ndarray], names: Sequence[str]) -> pa.RecordBatch:
    """(run, cluster, columns of its row) of every row that has points."""
    found = [(run, cluster, *row) for run, table in tables.items() for cluster, row in enumerate(table.tolist()) if row[0]]
    columns = [*zip(*found)] or [()] * (2 + len(names))
    kinds = [pa.int32(), pa.int32(), *[pa.int64() if name != "q" else pa.float64() for name in names]]
    return pa.RecordBatch.from_arrays([pa.array(one, kind) for one, kind in zip(columns, kinds)], names=["run", "cluster", *names])


def _tally(centres: Mapping[int, Sequence[Centre]], squares: bool, names: Sequence[str]) -> Callable[[Batches], Batches]:
    """A task's partial sums per run and cluster; with ``squares`` the sum of squared norms, in square z-scores, too."""

    def run(batches: Batches) -> Batches:
        totals = {run: np.zeros((len(clusters), len(names) - squares), np.int64) for run, clusters in centres.items()}
        norms = {run: np.zeros(len(clusters)) for run, clusters in centres.items()}
        for batch in batches:
            values = _coordinates(batch)
            norm = _norm([value / float(UNIT) for value in values]) if squares else None
            for run, clusters in centres.items():
                cluster = _closest(values, clusters)
                totals[run] += _sums(cluster, values, len(clusters))
                if squares:
                    norms[run] += np.bincount(cluster, norm, len(clusters))
        if squares:
            # numbers stay whole beside the doubles
            totals = {run: np.column_stack([table.astype(object), norms[run]]) for run, table in totals.items()}
        yield _rows_of(totals, names)

    return run


def _tallied(points: DataFrame, names: Sequence[str], centres: Mapping[int, Sequence[Centre]], squares: bool = False) -> dict:
    """(n, sums, squared norms if wanted) per run and cluster; tasks add up their points, so a few rows are shuffled."""
    columns = ["n", *names, *(["q"] if squares else [])]
    kinds = [f"{name} {'double' if name == 'q' else 'bigint'}" for name in columns]
    found = points.mapInArrow(_tally(dict(centres), squares, columns), schema=", ".join(["run int", "cluster int", *kinds]))
    added = found.groupBy("run", "cluster").agg(*[F.sum(name).alias(name) for name in columns])
    return {(row["run"], row["cluster"]): row for row in added.collect()}


def lloyd_fits(
    points: DataFrame, columns: Sequence[str], starts: Mapping[Hashable, Sequence[Centre]], most_steps: int = 300
) -> dict[Hashable, Fit]:
    """Lloyd's algorithm from many starts at once, each until its centres settle.

    One scan moves the centres of all runs that still move: tasks take points in batches, assign each once per run and add
    them up in whole numbers; partial sums per run and cluster are all that is shuffled or reaches the driver. A run ends with the centres that its last assignment was made
    to, once a step would move them by no more than ``MOVEMENT`` in total (sum of squares), the usual rule for features of
    unit variance, or after ``most_steps``. A centre that lost all its points stays where it was.
    """
    keys = list(starts)
    centres = {run: [tuple(map(int, centre)) for centre in starts[key]] for run, key in enumerate(keys)}
    fits: dict[Hashable, Fit] = {}
    names = [f"x{place}" for place in range(len(columns))]
    points = points.select(*[unit.alias(name) for unit, name in zip(in_units(columns), names, strict=True)]).dropna().persist()
    try:
        wide = [F.col(name).cast("decimal(19,0)") for name in names]
        norm = reduce(lambda total, one: total + one, [F.sum(one * one) for one in wide])
        squares = int(points.agg(norm).first()[0] or 0)
        step = 0
        while centres:
            found = {place: (row["n"], [row[name] for name in names]) for place, row in _tallied(points, names, centres).items()}
            step += 1
            for run, before in [*centres.items()]:
                after, cost = [], squares
                for cluster, centre in enumerate(before):
                    n, sums = found.get((run, cluster), (0, []))
                    after.append(tuple((2 * total + n) // (2 * n) for total in sums) if n else centre)
                    cost -= sum(2 * place * total - n * place * place for place, total in zip(centre, sums))
                moved = sum((new - old) ** 2 for one, other in zip(after, before) for new, old in zip(one, other))
                if moved <= SETTLED or step >= most_steps:
                    fits[keys[run]] = Fit(tuple(before), cost, step)
                    del centres[run]
                else:
                    centres[run] = after
    finally:
        points.unpersist()
    return {key: fits[key] for key in keys}


def best_of(fits: Mapping[tuple[int, int], Fit]) -> dict[int, Fit]:
    """For each number of clusters the fit of least cost, of equal ones the first; keys are (clusters, start)."""
    best: dict[int, Fit] = {}
    for (clusters, _), fit in sorted(fits.items()):
        if clusters not in best or fit.cost < best[clusters].cost:
            best[clusters] = fit
    return best


def drawn_starts(
    points: DataFrame, key: str, columns: Sequence[str], sizes: Sequence[int], restarts: int
) -> dict[tuple[int, int], list[Centre]]:
    """For every number of clusters and restart, centres at points drawn by the MD5 of their key, the same each time.

    Only as many points as the largest run needs, times the restarts, are looked at by the driver. Of fewer points each
    run still starts at distinct ones.
    """
    largest = max(sizes)
    names = [f"x{place}" for place in range(len(columns))]
    units = [unit.alias(name) for unit, name in zip(in_units(columns), names, strict=True)]
    drawn = points.select(F.md5(F.col(key).cast("string")).alias("draw"), key, *units)
    rows = [tuple(row[name] for name in names) for row in drawn.orderBy("draw", key).limit(largest * restarts).collect()]
    if len(rows) < largest:
        raise ValueError(f"too few customers for {largest} clusters")
    return {
        (size, turn): [rows[(turn * largest + place) % len(rows)] for place in range(size)]
        for turn in range(restarts)
        for size in sizes
    }


def _silhouette(norm: Column, values: Sequence[Column], cluster: Column, summary: Sequence[tuple]) -> Column:
    """Silhouette from (number, n, mean squared norm, means) of every cluster.

    The mean squared distance of a point x to a cluster with n members, mean m and mean squared norm q is
    |x|^2 - 2 x.m + q, so no pair of points is formed.
    """
    own, others = F.lit(None).cast("double"), []
    for number, n, q, means in summary:
        dot = reduce(lambda total, one: total + one, [value * mean for value, mean in zip(values, means, strict=True)])
        gap = F.greatest(norm - F.lit(2.0) * dot + q, F.lit(0.0))
        inside = cluster == number
        # the point itself, at distance zero, is not one of its neighbours
        neighbours = F.when(n > 1, gap * (n.cast("double") / (n.cast("double") - F.lit(1.0))))
        own = F.when(inside, neighbours).otherwise(own)
        # ``greatest`` passes over the null of a cluster that a run does not have
        others.append(F.when((cluster != number) & q.isNotNull(), gap))
    closest = F.least(*others) if len(others) > 1 else others[0]
    spread = F.greatest(own, closest)
    return F.when(own.isNull() | closest.isNull() | (spread == 0), 0.0).otherwise((closest - own) / spread)


def _norm(values: Sequence[Column]) -> Column:
    return reduce(lambda total, one: total + one, [value * value for value in values])


def silhouettes(points: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """Add the squared-Euclidean ``silhouette`` of every point, from one summary row per cluster."""
    values = [F.col(column) for column in columns]
    means = [F.avg(column).alias(column) for column in columns]
    rows = points.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(_norm(values)).alias("q"), *means).collect()
    summary = [
        (F.lit(row[cluster]), F.lit(row["n"]), F.lit(row["q"]), [F.lit(row[column]) for column in columns]) for row in rows
    ]
    return points.withColumn("silhouette", _silhouette(_norm(values), values, F.col(cluster), summary))


def _scores(runs: Mapping[int, Sequence[tuple]], width: int) -> Callable[[Batches], Batches]:
    """A task's number of points and sum of silhouettes per run; ``runs`` has (*centre, n, q, *means) per cluster."""

    def run(batches: Batches) -> Batches:
        totals = {run: [0, 0.0] for run in runs}
        for batch in batches:
            units = _coordinates(batch)
            values = [unit / float(UNIT) for unit in units]
            norm = _norm(values)
            for run, clusters in runs.items():
                cluster = _closest(units, [one[:width] for one in clusters])
                own, closest = np.full(len(norm), np.nan), np.full(len(norm), np.inf)
                for number, (n, q, *means) in enumerate(one[width:] for one in clusters):
                    if n is None:
                        continue
                    dot = reduce(lambda total, one: total + one, [value * mean for value, mean in zip(values, means)])
                    gap = np.maximum(norm - 2.0 * dot + q, 0.0)
                    inside = cluster == number
                    if n > 1:  # the point itself, at distance zero, is not one of its neighbours
                        own[inside] = gap[inside] * (n / (n - 1.0))
                    gap[inside] = np.inf
                    np.minimum(closest, gap, out=closest)
                spread = np.maximum(own, closest)
                scored = np.isfinite(spread) & (spread > 0)
                totals[run][0] += len(norm)
                totals[run][1] += float(((closest[scored] - own[scored]) / spread[scored]).sum())
        columns = [[*totals], *zip(*totals.values())]
        kinds = [pa.int32(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(one, kind) for one, kind in zip(columns, kinds)], names=["run", "n", "total"])

    return run


def silhouette_means(points: DataFrame, columns: Sequence[str], fits: Mapping[int, Fit]) -> dict[int, float]:
    """Mean silhouette of every fit: one scan for the summaries of all clusters, one for the points."""
    names = [f"x{place}" for place in range(len(columns))]
    points = points.select(*[unit.alias(name) for unit, name in zip(in_units(columns), names, strict=True)]).dropna()
    found = _tallied(points, names, {number: fit.centres for number, fit in fits.items()}, squares=True)
    summaries: dict[int, list[tuple]] = {}
    for number, fit in fits.items():
        for at, centre in enumerate(fit.centres):
            row = found.get((number, at))
            known = row and (row["n"], row["q"] / row["n"], *(row[name] / (row["n"] * UNIT) for name in names))
            summaries.setdefault(number, []).append((*centre, *(known or (None,) * (len(names) + 2))))
    scored = points.mapInArrow(_scores(summaries, len(names)), schema="run int, n bigint, total double")
    means = scored.groupBy("run").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return {row["run"]: row["mean"] for row in means.collect()}


def tier_labels(profile: DataFrame, cluster: str, spend: str, labels: Sequence[str]) -> DataFrame:
    """(cluster, segment) rows: labels in order of falling mean spend over a one-row-per-cluster table."""
    place = F.row_number().over(Window.orderBy(F.desc(spend), F.asc(cluster)))
    names = F.array(*[F.lit(label) for label in labels])
    return profile.select(cluster, F.element_at(names, place).alias("segment"))


def label_clusters(customers: DataFrame, labels: Sequence[str], clusters: int) -> DataFrame:
    """Name the clusters by falling mean ``monetary``."""
    if clusters > len(labels):
        raise ValueError(f"{clusters} clusters need as many labels, got {len(labels)}")
    profile = customers.groupBy("cluster").agg(F.avg(F.col("monetary").cast("double")).alias("spend"))
    named = tier_labels(profile, "cluster", "spend", labels).withColumnRenamed("cluster", "_cluster")
    # one row per cluster. A null-safe join asks for no filter on the cluster, which would work out all distances anew
    return customers.join(F.broadcast(named), F.col("cluster").eqNullSafe(F.col("_cluster"))).drop("_cluster")


def assemble(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(points)


def best_kmeans(
    vectors: DataFrame, clusters: Sequence[int], restarts: int = 10, seed: int = 42, parallelism: int = 8
) -> dict[int, KMeansModel]:
    """For each K MLlib's model with the lowest cost over several seeds; fits run as concurrent Spark jobs.

    A fit ends when its centres move by less than ``MOVEMENT`` in total (sum of squares), the usual rule for
    features of unit variance.
    """

    @inheritable_thread_target(vectors.sparkSession)
    def fit(task: tuple[int, int]) -> KMeansModel:
        k, offset = task
        return KMeans(k=k, seed=seed + offset, maxIter=300, tol=(MOVEMENT / k) ** 0.5).fit(vectors)

    tasks = [(k, offset) for k in clusters for offset in range(restarts)]
    best: dict[int, KMeansModel] = {}
    with ThreadPoolExecutor(parallelism) as pool:
        for (k, _), model in zip(tasks, pool.map(fit, tasks)):
            if k not in best or model.summary.trainingCost < best[k].summary.trainingCost:
                best[k] = model
    return best


def silhouette_score(model: KMeansModel, vectors: DataFrame) -> float:
    """Mean squared-Euclidean silhouette over all points."""
    assigned = model.transform(vectors)
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(assigned)
