"""Merkle manifest of a table: a digest per document, a tree per language, a tree over the languages, and proofs.

A leaf is H of the document's fields, H being lower-case hexadecimal SHA-256 of its inputs in a row. Within a language
leaves ascend by doc_id. A level's nodes are taken two by two, a last one alone, and H of each run is a node of the next
level, until one node is left, the language's subroot. The subroots, in the order of the languages, make up the root in
the same way.

Proofs are found by pointer jumping. Every node starts with the segment of its sibling towards its parent; a self-join
looks up the segment of the ancestor that a node's segment ends at and appends it, which doubles the distance, until
every leaf has reached the top. After a round whose distance is ``d`` only nodes on levels that ``d`` divides are looked
up again, so the rows hardly outnumber the leaves. A segment holds one byte per level (alone, sibling right, sibling left)
and the sibling's 32 bytes.

No key of a join is shared by more than ``1 << BLOCK_BITS`` rows, whatever the data: ancestors of more leaves than that, and
languages, are repeated once for each block of consecutive positions below them. Trees are built block by block too,
``BLOCK_BITS`` levels at a time. Texts are read once; what is sorted and shuffled are digests.

Defined cases: a null field is ``-``; documents without a lang form a tree of their own, the first one; those without a
doc_id come first in their tree. Rows that repeat a doc_id are leaves of their own, in the order of their digests; rows
equal in every field are interchangeable. An empty table has no rows and no root. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.llm.arrow import Held
from tillstone.operators.ordering import with_position
from tillstone.operators.storage import WorkTables

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels that are built at a time; a block holds at most ``1 << BLOCK_BITS`` consecutive nodes of a level.
BLOCK_BITS = 12

#: How a node stands to its sibling: it has none, it has one to the right, to the left.
ALONE, RIGHT, LEFT = b"\0", b"\1", b"\2"


def field(value: Column) -> Column:
    """A field as the leaf's input: ``-`` or the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def leaves(documents: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(doc_id, lang, leaf, other, row): ``other`` is the leaf with some values replaced, null where nothing is.

    Expressions of ``tampered`` and ``where`` are over the columns ``FIELDS``.
    """
    held = Held(documents)
    fields = held.table.select(*(F.col(held[name]).alias(name) for name in FIELDS))
    values = {name: F.col(name) for name in FIELDS}
    other = F.lit(None).cast("binary")
    if tampered:
        other = F.when(F.coalesce(where, F.lit(False)), leaf([*(values | tampered).values()]))
    return fields.select("doc_id", "lang", leaf([*values.values()]).alias("leaf"), other.alias("other"),
                         F.monotonically_increasing_id().alias("row"))


def placed(rows: DataFrame, tables: WorkTables) -> tuple[DataFrame, DataFrame]:
    """Leaves with their tree's number, their position in it from 0 and its size ``n``; the trees (lang, tree, n)."""
    rows = tables.save(rows, "leaves")  # the sort below looks at its input twice
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("row")]
    by_place = with_position(rows, order, tables, "sorted").withColumn("place", F.col("position") - 1)
    by_place = by_place.drop("position", "row_count", "row")
    sizes = by_place.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    trees = with_position(sizes, [F.col("first")], tables, "trees").withColumn("tree", F.col("position") - 1)
    trees = trees.select("lang", "tree", "first", "n")
    ranges = trees.select(
        F.col("lang").alias("tree_lang"), "tree", "first", "n",
        F.explode(F.sequence(block(F.col("first")), block(F.expr("first + n - 1")))).alias("part"),
    )
    same = F.col("lang").eqNullSafe(F.col("tree_lang")) & (block(F.col("place")) == F.col("part"))
    found = by_place.join(ranges, same).withColumn("pos", F.expr("place - first"))
    return tables.save(found.select("tree", "pos", "n", "doc_id", "leaf", "other"), "placed"), trees


def block(position: Column) -> Column:
    return F.shiftright(position, BLOCK_BITS)


def digest_of(children: bytes) -> bytes:
    """H of one or two digests in a row."""
    return sha256(children.hex().encode()).digest()


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(tree, block, n, digests) of every block; the rows come sorted by tree and position."""
    key, size, found = None, 0, []
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("tree", "pos", "n", "node"))
        for tree, pos, n, node in zip(*columns, strict=True):
            now = (tree, pos >> BLOCK_BITS)
            if now != key:
                if found:
                    yield *key, size, found
                key, size, found = now, n, []
            found.append(node)
    if found:
        yield *key, size, found


#: A hop leads from a node to its parent past its sibling; a row with ``node`` instead goes on to the next levels.
HOPS = "tree bigint, level int, pos bigint, n bigint, path binary, node binary"


def _climb(level: int):
    """All hops of ``BLOCK_BITS`` levels, and the node that each block ends in."""

    def rows(tree: int, part: int, n: int, nodes: list[bytes]) -> Iterator[tuple]:
        now = level
        while now < level + BLOCK_BITS and (n - 1) >> now:
            first = part << (BLOCK_BITS - now + level)
            for at, _ in enumerate(nodes):
                if at & 1:
                    path = LEFT + nodes[at - 1]
                else:
                    path = RIGHT + nodes[at + 1] if at + 1 < len(nodes) else ALONE
                yield tree, now, first + at, n, path, None
            nodes = [digest_of(b"".join(nodes[at : at + 2])) for at in range(0, len(nodes), 2)]
            now += 1
        yield tree, now, part, n, None, nodes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for one in runs(batches):
            made.extend(rows(*one))
            if len(made) > 1 << 14:
                yield _hops(made)
                made = []
        if made:
            yield _hops(made)

    return run


def _hops(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[one.split()[0] for one in HOPS.split(", ")])


def climbed(nodes: DataFrame, tables: WorkTables, height: int, name: str) -> tuple[DataFrame, DataFrame]:
    """All hops of the trees over ``nodes`` (tree, pos, n, node); their roots (tree, n, node)."""
    hops, roots, level = None, None, 0
    while True:
        dealt = nodes.repartition("tree", block(F.col("pos"))).sortWithinPartitions("tree", "pos")
        made = tables.save(dealt.select("tree", "pos", "n", "node").mapInArrow(_climb(level), schema=HOPS), f"{name}-hops")
        hop, end = made.filter("path is not null").drop("node"), made.filter("node is not null").drop("path")
        done = end.filter("shiftright(n - 1, level) = 0").select("tree", "n", "node")
        hops, roots = (hop, done) if hops is None else (hops.union(hop), roots.union(done))
        level += BLOCK_BITS
        if level >= height:
            return hops, roots
        nodes = end.filter("shiftright(n - 1, level) > 0").drop("level")


def paths(hops: DataFrame, tables: WorkTables, height: int, name: str) -> DataFrame:
    """(tree, pos, path) of every leaf of a tree of more than one: its siblings up to the tree's root."""
    jumps, distance = hops, 1
    while distance < height:
        near = jumps.filter(f"level % {2 * distance} = 0")
        far = jumps.filter(f"level % {2 * distance} = {distance}").select(
            F.col("tree").alias("far_tree"), (F.col("level") - distance).alias("far_level"), F.col("pos").alias("far_pos"),
            F.col("n").alias("far_n"), F.col("path").alias("far_path"),
        )
        if distance <= BLOCK_BITS:
            meet = F.shiftright("pos", distance) == F.col("far_pos")
        else:
            # one copy for each block of nodes below
            wide = distance - BLOCK_BITS
            last = F.expr(f"least(shiftleft(far_pos + 1, {wide}) - 1, shiftright(shiftright(far_n - 1, far_level), {BLOCK_BITS}))")
            far = far.withColumn("far_block", F.explode(F.sequence(F.shiftleft("far_pos", wide), last)))
            meet = block(F.col("pos")) == F.col("far_block")
        meet &= (F.col("tree") == F.col("far_tree")) & (F.col("level") == F.col("far_level"))
        joined = near.join(far, meet, "left").select(
            "tree", "level", "pos", "n", F.concat("path", F.coalesce("far_path", F.lit(b""))).alias("path")
        )
        jumps = tables.replace(joined, f"{name}-jumps")
        distance *= 2
    return jumps.filter("level = 0").select("tree", "pos", "path")


def _fold(root: bytes):
    def fold(node: bytes, path: bytes) -> tuple[bytes, bytes, list[bytes]]:
        """The nodes that the path leads to; its siblings."""
        at, siblings = 0, []
        while at < len(path):
            side, other = path[at : at + 1], path[at + 1 : at + 33]
            if side == ALONE:
                node, at = digest_of(node), at + 1
            else:
                node = digest_of(node + other if side == RIGHT else other + node)
                siblings.append(other)
                at += 33
        return node, siblings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("leaf", "other", "path", "top_path")
            proofs, folded = [], []
            for own, other, path, top in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                node, siblings = fold(own if other is None else other, (path or b"") + (top or b""))
                proofs.append(sha256(b"".join(siblings).hex().encode()).hexdigest())
                folded.append(node)
            made = {
                "doc_id": batch.column("doc_id"),
                "leaf": pa.array([own.hex() for own in batch.column("leaf").to_pylist()], pa.string()),
                "subroot": pa.array([node.hex() for node in batch.column("subroot").to_pylist()], pa.string()),
                "root": pa.array([root.hex()] * batch.num_rows, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array([node.hex() for node in folded], pa.string()),
                "verified": pa.array([node == root for node in folded], pa.bool_()),
                "lang_no": batch.column("tree"),
                "pos": batch.column("pos"),
                "siblings": pa.array([(path or b"") + (top or b"") for path, top in
                                      zip(batch.column("path").to_pylist(), batch.column("top_path").to_pylist(), strict=True)],
                                     pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([*made.values()], names=[*made])

    return run


@dataclass(frozen=True)
class Manifest:
    """``proofs``: a row per document, ``siblings`` being its whole proof; ``trees``: (lang, tree, n); ``root`` in hex."""

    proofs: DataFrame
    trees: DataFrame
    root: str | None


PROOFS = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "lang_no bigint, pos bigint, siblings binary"
)


def manifest(
    documents: DataFrame, tables: WorkTables, tampered: dict[str, Column] | None = None, where: Column | None = None
) -> Manifest:
    """Digests and proofs of all documents, each proof folded from the leaf that ``tampered`` makes of it, if any."""
    rows, trees = placed(leaves(documents, tampered, where), tables)
    most, count = trees.agg(F.max("n"), F.count("*")).first()
    if not count:
        return Manifest(rows.sparkSession.createDataFrame([], PROOFS), trees.select("lang", "tree", "n"), None)
    height, top_height = (int(most) - 1).bit_length(), (count - 1).bit_length()
    hops, subroots = climbed(rows.withColumnRenamed("leaf", "node"), tables, height, "tree")
    own = paths(hops, tables, height, "tree")
    crowns = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(count).alias("n"), "node")
    top_hops, top = climbed(crowns, tables, top_height, "top")
    root = bytes(top.first()["node"])
    up = paths(top_hops, tables, top_height, "top").select(F.col("pos").alias("tree"), F.col("path").alias("top_path"))
    ends = subroots.join(up, "tree", "left").select(
        "tree", F.col("node").alias("subroot"), "top_path",
        F.explode(F.sequence(F.lit(0).cast("bigint"), block(F.col("n") - 1))).alias("part"),
    )
    full = rows.drop("n").join(own, ["tree", "pos"], "left").withColumn("part", block(F.col("pos"))).join(ends, ["tree", "part"])
    return Manifest(full.drop("part").mapInArrow(_fold(root), schema=PROOFS), trees.select("lang", "tree", "n"), root.hex())
