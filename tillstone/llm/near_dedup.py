"""Near copies: circulant MinHash, banding, exact verification, connected components.

Documents are linked if ``100 * |A & B| >= 75 * |A | B|`` for their sets of distinct word shingles. Every signature
coordinate comes from two permutations: one deals the shingles out over a circle of positions, the other ranks the
positions, and coordinate ``k`` is the least rank met when the ranks are turned by ``k`` places. Bands of coordinates
propose pairs; those whose signatures differ too much for the wanted similarity (by six standard deviations of one bit per
coordinate) go no further, nor do those whose parities differ in more places than two similar sets can differ in shingles
(which holds without exception), and every link is confirmed on the full sets.

Equal texts (equal word sequences) form one class and take part once. Within a band's bucket no list of all pairs is
made: classes are compared with a few centres, links join classes to components, and only classes of different
components are compared further, with four times as many centres each time, until no bucket holds an untested pair of
different components. Before that, two turns compare each class with only one of the centres it meets, the same one in as
many buckets as can be. So a group of thousands of near copies costs a few comparisons for each of them, and no
candidate is ever dropped.

Defined cases: a null or empty text, or one without a word, has no shingles and is linked with nothing. Rows that
repeat a doc_id, and rows without one, are rows like any other; a component takes the smallest doc_id among its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.llm.arrow import Held, WordHashes, lists_of, mixed, steps, texts_of, window_hashes
from tillstone.llm.components import components, contracted, labelled
from tillstone.llm.skew import with_totals
from tillstone.operators.storage import WorkTables


@dataclass(frozen=True)
class NearDedup:
    """Parameters. With 60 bands of 6 coordinates a pair of similarity 0.75 is missed with probability 8e-6.

    The circle must have at most 2**16 positions (ranks are 16-bit numbers) and at least as many as there are coordinates.
    """

    shingle_words: int = 5
    percent: int = 75
    bands: int = 60
    rows_per_band: int = 6
    circle_bits: int = 16
    seed: int = 7

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows_per_band

    def ranks(self) -> np.ndarray:
        """The second permutation, laid out so that a window of it holds the rank under every turn."""
        size = 1 << self.circle_bits
        ranks = np.random.default_rng(self.seed).permutation(size).astype(np.uint16)
        return sliding_window_view(np.concatenate([ranks, ranks[: self.coordinates]]), self.coordinates)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashed shingles in order."""
    return np.unique(window_hashes(words, size))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or b"").lower().split()


def signature(found: np.ndarray, turned: np.ndarray, options: NearDedup) -> np.ndarray:
    """Circulant MinHash of a non-empty set of hashed shingles."""
    # the first permutation: a scrambling of the hashes, cut to the positions of the circle
    positions = (mixed(found + np.uint64(options.seed)) >> np.uint64(64 - options.circle_bits)).astype(np.int64)
    least = np.full(options.coordinates, np.iinfo(np.uint16).max, np.uint16)
    for start in range(0, len(positions), 4096):
        np.minimum(least, turned[positions[start : start + 4096]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, options: NearDedup) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = least.reshape(options.bands, options.rows_per_band).astype(np.uint64)
    key = np.arange(options.bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(options.rows_per_band):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, at])
    return key.view(np.int64)


def bits_of(least: np.ndarray) -> bytes:
    """One bit of every coordinate: of two sets of similarity s, a share (1 + s) / 2 of the bits agrees."""
    scrambled = least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.packbits((scrambled >> np.uint64(40)).astype(np.uint8) & 1).tobytes()


#: Parities of a set; each takes eight bytes for 64 of them in every bucket.
PARITIES = 512


def parities_of(found: np.ndarray) -> bytes:
    """For every slot whether an odd number of the hashed shingles falls into it.

    Shingles of both sets cancel out, so two sets differ in at least as many shingles as their parities do in slots.
    """
    slots = (mixed(found) >> np.uint64(32)) % np.uint64(PARITIES)
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).tobytes()


def far_apart(options: NearDedup) -> int:
    """More different bits than this mean, beyond six standard deviations, a similarity below the wanted one."""
    differs = (1 - options.percent / 100) / 2
    spread = (options.coordinates * differs * (1 - differs)) ** 0.5
    return int(options.coordinates * differs + 6 * spread)


SKETCH = "row bigint, digest binary, size bigint, bands array<bigint>, bits binary, parities binary"


def _sketch(options: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, turned = WordHashes(), options.ranks()
        for batch in steps(batches):
            digests, sizes, bands, bits, parities = [], [], [], [], []
            for words in map(words_of, texts_of(batch)):
                found = shingles(hashes.of(words), options.shingle_words)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(len(found))
                least = signature(found, turned, options) if words else None
                bands.append(band_keys(least, options) if words else found.view(np.int64))
                bits.append(bits_of(least) if words else None)
                parities.append(parities_of(found) if words else None)
            columns = [
                batch.column("row"),
                pa.array(digests, pa.binary()),
                pa.array(sizes, pa.int64()),
                lists_of(bands, pa.int64()),
                pa.array(bits, pa.binary()),
                pa.array(parities, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in SKETCH.split(", ")])

    return run


def sketches(rows: DataFrame, text: str, options: NearDedup) -> DataFrame:
    """For every row: the digest of its word sequence, the size of its shingle set, band keys, bits and parities."""
    return rows.select("row", F.col(text).alias("text")).mapInArrow(_sketch(options), schema=SKETCH)


def _sets(options: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in steps(batches):
            found = [
                shingles(hashes.of(words_of(text)), options.shingle_words).tobytes() for text in texts_of(batch)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "found"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            linked = []
            for sets in zip(batch.column("a_found").to_pylist(), batch.column("b_found").to_pylist(), strict=True):
                small, large = sorted((np.frombuffer(one, np.uint64) for one in sets), key=len)
                places = np.minimum(large.searchsorted(small), len(large) - 1)
                common = int(np.count_nonzero(large[places] == small))
                linked.append(100 * common >= percent * (len(small) + len(large) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


#: Rows of one key that a join gathers in a task.
SHARE = 1024

#: A bucket with more than one row in so many is frequent.
MOST_FREQUENT = 1 << 12

#: Turns in which a class is compared with one centre of all its buckets, and steps of contraction between two turns.
SCOUTS, STEPS = 2, 2


def verified(pairs: DataFrame, sets: DataFrame, tables: WorkTables, options: NearDedup) -> DataFrame:
    """Those pairs of nodes (a, b) whose full shingle sets are similar enough; ``sets`` has (node, found).

    Of each pair the node with more pairs is the hub. The other's set is fetched first, and the pairs of a hub are dealt
    out over as many copies of its set as they fill.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    counts = tables.replace(ends.groupBy("node").agg(F.count("*").alias("n")), "counts")
    both = pairs.join(counts.toDF("a", "a_n"), "a").join(counts.toDF("b", "b_n"), "b")
    turned = F.col("a_n") < F.col("b_n")
    hub, other = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    share = F.call_function("div", F.greatest("a_n", "b_n") - 1, F.lit(SHARE)) + 1
    links = both.select(hub.alias("a"), other.alias("b"), share.alias("shares"))
    links = tables.replace(links.withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares"))), "links")
    copies = sets.toDF("a", "a_found").join(links.groupBy("a").agg(F.max("shares").alias("shares")), "a")
    copies = copies.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))).drop("shares")
    found = links.drop("shares").join(sets.toDF("b", "b_found"), "b").join(copies, ["a", "share"])
    return found.select("a", "b", "a_found", "b_found").mapInArrow(_verify(options.percent), schema="a bigint, b bigint")


def words_of_bits(name: str, count: int) -> list[Column]:
    """``count`` bits as 64-bit integers ``name0``, ``name1``, ...; the last one is filled up with zeros."""
    parts = -(-count // 64)
    padded = F.rpad(F.hex(name), 16 * parts, "0")
    found = [F.conv(F.substring(padded, 1 + 16 * at, 16), 16, -10).cast("bigint") for at in range(parts)]
    return [part.alias(f"{name}{at}") for at, part in enumerate(found)]


def _turn(members: DataFrame, centres: int, tables: WorkTables) -> tuple[DataFrame, DataFrame]:
    """Pairs to compare in this turn, and what is left of the buckets after it.

    ``members``, a written table, has (key, node, size, label, bits0, ..., parities0, ...) of buckets. In a bucket with different labels the
    nodes of least hash become centres, about ``centres`` of them and at least one. A centre is compared with all nodes
    of other labels and then leaves its bucket, so that every pair of different labels has its turn. A large bucket is
    dealt out over several copies of its centres.
    """
    members = members.withColumn("place", F.xxhash64("node"))
    buckets = (
        members.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("place").alias("first"), F.min("label").alias("l"), F.max("label").alias("h"))
        .filter("l < h")
        .withColumn("last", F.col("first") + (centres - 1) / F.col("n") * 2.0**64)
        .select("key", "n", "first", "last", F.expr(f"(n - 1) div {SHARE} + 1").alias("shares"))
    )
    dealt = with_totals(members, tables.replace(buckets, "buckets"), "key", "n", MOST_FREQUENT, shuffled=True)
    dealt = dealt.withColumn("centre", F.expr("place = first or place < last"))
    bits = [name for name in members.columns if name.startswith(("bits", "parities"))]
    left = dealt.filter("centre").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    left = left.selectExpr("key", "share", "node a", "size a_size", "label a_label", "place a_place", *(f"{b} a_{b}" for b in bits))
    right = dealt.withColumn("share", F.pmod("place", "shares"))
    right = right.selectExpr("key", "share", "node b", "size b_size", "label b_label", "place b_place", "centre", *bits)
    # both sides grow with the data, so neither is sent to all tasks, however small it seems
    pairs = left.join(right.hint("merge"), ["key", "share"]).filter("a_label != b_label and (not centre or a_place < b_place)")
    for name, kind in {"differing": "bits", "odd": "parities"}.items():
        pairs = pairs.withColumn(name, F.expr(" + ".join(f"bit_count({b} ^ a_{b})" for b in bits if b.startswith(kind))))
    return pairs, dealt.filter("not centre").select("key", "node", "size", *bits)


def bucketed(own: DataFrame, tables: WorkTables, options: NearDedup) -> DataFrame:
    """(key, node, size, bits0, ..., parities0, ...) of every class in a bucket with another; ``own`` has a row per class.

    Keys and node numbers alone are shuffled for that; sizes and bits are looked up for what is left.
    """
    banded = own.select(F.explode("bands").alias("key"), "node")
    shared = tables.save(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    bits = [*words_of_bits("bits", options.coordinates), *words_of_bits("parities", PARITIES)]
    met = with_totals(banded, shared, "key", "n", MOST_FREQUENT, shuffled=True)
    return met.join(own.select("node", "size", *bits).hint("merge"), "node")


def linked_nodes(sketched: DataFrame, rows: DataFrame, text: str, tables: WorkTables, options: NearDedup) -> DataFrame | None:
    """(node, label) of every class that is linked with another, None if there is none.

    ``rows`` is a written table, ``sketched`` that of its sketches, saved as ``sketches`` and given up here; the node of a
    class is its smallest row number.
    """
    nodes = sketched.filter("size > 0").groupBy("digest").agg(F.min("row").alias("row")).select("row")
    own = sketched.join(nodes.hint("merge"), "row", "left_semi").select(F.col("row").alias("node"), "size", "bands", "bits", "parities")
    own = tables.save(own, "own")
    tables.discard("sketches")
    members = tables.save(bucketed(own, tables, options), "members")
    tables.discard("own", "shared")
    # grows with the data, so it is never sent to all tasks, however small it seems
    compared = members.select(F.col("node").alias("row")).distinct().hint("merge")
    texts = rows.select("row", F.col(text).alias("text")).join(compared, "row", "left_semi").withColumnRenamed("row", "node")
    sets = tables.save(texts.mapInArrow(_sets(options), schema="node bigint, found binary"), "sets")
    tables.reclaim()  # all texts went through that shuffle
    labels, edges, tested, centres, scouts = None, None, None, 1, SCOUTS
    while True:
        if labels is None:
            named = members.withColumn("label", F.col("node"))
        else:
            named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pairs, rest = _turn(tables.replace(named, "named"), centres, tables)
        alike = f"100 * least(a_size, b_size) >= {options.percent} * greatest(a_size, b_size)"
        # |A & B| and |A | B| from the sizes and the number of shingles that are in one set alone
        even = f"{100 + options.percent} * odd <= {100 - options.percent} * (a_size + b_size)"
        pairs = pairs.filter(f"{alike} and differing <= {far_apart(options)} and {even}")
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        pairs = pairs.groupBy(*ends).agg(F.min_by("b", "a_place").alias("node"), F.min("a_place").alias("place"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if scouts:
            pairs = pairs.groupBy("node").agg(F.min_by(F.struct("a", "b"), "place").alias("pair")).select("pair.*")
        pairs = tables.replace(pairs.select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            if not scouts and members.isEmpty():
                tables.discard("sets", "named", "buckets", "members", "pairs", "tested", "counts", "links", "linked")
                return None if edges is None else tables.replace(components(edges, tables), "labels")
        else:
            tested = tables.replace(pairs if tested is None else tested.union(pairs), "tested")
            links = tables.replace(verified(pairs, sets, tables, options), "linked")
            if not links.isEmpty():
                edges = contracted(links if edges is None else links.union(edges), tables, STEPS)
                labels = tables.replace(labelled(edges), "labels")
        if scouts:
            scouts -= 1
        else:
            members = tables.replace(rest, "members")
            centres *= 4


@dataclass(frozen=True)
class Found:
    """``rows``: every document (``held`` says under which names) with its row number; ``groups``: slim results."""

    held: Held
    rows: DataFrame
    groups: DataFrame


def near_duplicates(documents: DataFrame, tables: WorkTables, options: NearDedup = NearDedup()) -> Found:
    """``groups`` has (row, doc_id, n_shingles, label, component_id); rows of one label form a component."""
    held = Held(documents)
    rows = tables.save(held.table.withColumn("row", F.monotonically_increasing_id()), "rows")
    sketched = tables.save(sketches(rows, held["text"], options), "sketches")
    slim = rows.select("row", F.col(held["doc_id"]).alias("doc_id")).join(
        sketched.select("row", "digest", F.col("size").alias("n_shingles")), "row"
    )
    slim = tables.save(slim, "slim")
    labels = linked_nodes(sketched, rows, held["text"], tables, options)
    worded = slim.filter("n_shingles > 0")
    classes = worded.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    if labels is None:
        classes = classes.select("digest", "n", F.col("node").alias("label"), F.col("least").alias("component_id"))
    else:
        classes = tables.save(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "unnamed")
        smallest = classes.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
        named = with_totals(classes, tables.save(smallest, "smallest"), "label", "classes")
        classes = named.select("digest", "n", "label", "component_id")
    full = with_totals(worded, tables.save(classes, "classes"), "digest", "n").drop("digest")
    empty = slim.filter("n_shingles = 0").drop("digest")
    empty = empty.withColumn("label", F.col("row")).withColumn("component_id", F.col("doc_id"))
    tables.discard("unnamed", "smallest", "labels", "stars")
    return Found(held, rows, full.unionByName(empty))


def deduplicated(documents: DataFrame, tables: WorkTables, options: NearDedup = NearDedup()) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest doc_id, then of the first row."""
    found = near_duplicates(documents, tables, options)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    chosen = found.groups.groupBy("label").agg(F.min_by("row", order).alias("row")).select("row")
    # the list grows with the data, so it is never sent to all tasks, however small it seems
    return found.held.restored(found.rows.join(tables.save(chosen, "chosen").hint("merge"), "row", "left_semi"))
