"""Merkle manifest of a dataset: one hash tree over the rows of each part, one over the parts' roots.

A row's leaf digest covers its fields; the leaves of a part (here: a language) stand in the order
of their ids.  As long as a part has several nodes, every ``FANOUT`` consecutive ones become one.

*Slot pivot.*  Each parent's children are spread into ``FANOUT`` columns by conditional
aggregates, one per slot.  The columns one after the other are what the parent's digest covers; the
columns without the own slot are a child's siblings.  So one row per parent serves both ways: upwards
the digests, downwards the siblings, and each level is an eighth of the one below.  Leaves get
their proofs from the pivoted row itself: no join has a row per leaf.

Everything is DataFrame operations; each level is a written table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import ascii_lower
from tallyforge.session import known_size, materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<l:string,r:string>>"
_INDEX_BITS = 33  # of monotonically_increasing_id


def digest(value: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text."""
    return F.sha2(value, 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(F.concat(*[framed(f) for f in fields]))


@dataclass
class Tree:
    """A forest of trees, one per group ``g``.

    ``levels``, lowest first: ``g``, ``parent``, ``digest`` (the parent's) and the children's structs
    ``c0``, ``c1``, ...; ``lone``: ``g``, ``child`` of groups of one node; ``roots``: ``g``, ``digest``,
    ``height`` (levels below the root).
    """

    levels: list[DataFrame]
    lone: DataFrame
    roots: DataFrame


def _children() -> list[Column]:
    return [F.col(f"c{i}") for i in range(FANOUT)]


def _joined(columns: list[Column]) -> Column:
    """Digests of the children's columns one after the other; absent ones are skipped."""
    return F.concat_ws("", *[c["digest"] for c in columns])


def levels_of(most: int) -> int:
    """Levels above ``most`` nodes."""
    height = 0
    while most > 1:
        most, height = -(-most // FANOUT), height + 1
    return height


def grow(nodes: DataFrame, height: int, tag: str) -> Tree:
    """The trees over ``nodes``: ``g``, ``pos`` (from 0 without gaps), ``n`` (nodes of the group), ``digest`` and what else leaves carry.

    ``height`` is the number of levels of the largest group.  A group of one node is its own root.
    """
    def child(df: DataFrame) -> Column:
        return F.struct("digest", *[c for c in df.columns if c not in ("g", "pos", "n", "digest")])

    def tops(df: DataFrame, at: int) -> DataFrame:
        return df.filter("n = 1").select("g", "digest", F.lit(at).alias("height"))

    lone = nodes.filter("n = 1").select("g", child(nodes).alias("child"))
    levels, roots = [], tops(nodes, 0)
    for level in range(height):
        slots = [F.max(F.when(F.pmod("pos", F.lit(FANOUT)) == i, child(nodes))).alias(f"c{i}") for i in range(FANOUT)]
        pivoted = nodes.filter("n > 1").groupBy("g", F.floor(F.col("pos") / FANOUT).alias("parent")).agg(
            F.ceil(F.max("n") / FANOUT).alias("n"), *slots)
        levels.append(materialize(pivoted.withColumn("digest", digest(_joined(_children()))), f"{tag}-level-{level}"))
        nodes = levels[-1].select("g", F.col("parent").alias("pos"), "n", "digest")
        roots = roots.union(tops(nodes, level + 1))
    return Tree(levels, lone, known_size(roots, f"{tag}-roots"))


def with_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """The trees' leaves (``g``, ``child``) with ``path``: their siblings, level by level up to the top.

    A level of a path is what stands before (``l``) and behind (``r``) the own node; ``above`` has
    ``g`` and ``path``, the levels beyond each group's root.
    """
    starts = known_size(tree.roots.join(above, "g").select("g", "height", "path"), "paths-above")
    steps = [F.struct(_joined(_children()[:i]).alias("l"), _joined(_children()[i + 1:]).alias("r")) for i in range(FANOUT)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), c.alias("child"), s.alias("step"))
                               for i, (c, s) in enumerate(zip(_children(), steps, strict=True))])).alias("e")
    found = tree.lone.join(starts.select("g", "path"), "g")
    paths = None
    for level in reversed(range(len(tree.levels))):
        own = starts.filter(F.col("height") == level + 1).select("g", F.lit(0).cast("long").alias("parent"), "path")
        paths = own if paths is None else paths.union(own)
        rows = tree.levels[level].select("g", "parent", *_children()).join(paths, ["g", "parent"])
        down = rows.select("g", "parent", "path", each).filter("e.child is not null")
        path = F.concat(F.array("e.step"), F.col("path")).alias("path")
        if not level:
            return down.select("g", "e.child", path).union(found)
        paths = materialize(down.select("g", (F.col("parent") * FANOUT + F.col("e.slot")).alias("parent"), path), "paths")
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda own, step: digest(F.concat(step["l"], own, step["r"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def ordered_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, part: str = "lang", id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Leaves in their places, and the parts.

    Leaves: ``g`` (number of the part in order, null first), ``pos``, ``n``, ``digest``, ``doc_id``,
    ``changed`` (digest after tampering, null where nothing is tampered with).  Parts: ``g``, ``n``.
    Rows are dealt into ranges of (part, id) by sampled bounds and numbered where they lie; only one
    row per range and part is looked at to add the ranges up.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    lowered = [ascii_lower(c) if n == "text" else c for n, c in zip(fields, columns, strict=True)]
    picked = F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")), F.lit(3)) == 0
    leaves = docs.select(F.col(f"`{part}`").alias("part"), F.col(f"`{id_column}`").alias("doc_id"), leaf_digest(columns).alias("digest"),
                         F.when(picked, leaf_digest(lowered)).alias("changed"))
    leaves = materialize(leaves, "leaves")
    order = ["part", "doc_id", "digest"]
    at = F.monotonically_increasing_id()
    placed = materialize(leaves.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.shiftright(at, _INDEX_BITS).alias("range"), at.bitwiseAND((1 << _INDEX_BITS) - 1).alias("i")), "placed-leaves")
    cells = known_size(placed.groupBy("range", "part").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("rows")), "leaf-cells")
    whole = Window.partitionBy("part")
    cells = cells.select("range", "part", "first", F.sum("rows").over(whole).alias("n"),
                         F.coalesce(F.sum("rows").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
                         F.dense_rank().over(Window.orderBy("part")).cast("long").alias("g"))
    cells = known_size(cells.withColumn("g", F.col("g") - 1), "leaf-cells")
    here, there = placed.alias("p"), cells.alias("c")
    rows = here.join(there, (F.col("p.range") == F.col("c.range")) & F.col("p.part").eqNullSafe(F.col("c.part"))).select(
        "g", (F.col("i") - F.col("first") + F.col("base")).alias("pos"), "n", "digest", "doc_id", "changed")
    return rows, cells.select("g", "n").distinct()


@dataclass
class Manifest:
    """The trees of the parts, the tree over their roots, and the root of all (a table of one row, none without rows)."""

    parts: Tree
    top: Tree

    @property
    def root(self) -> DataFrame:
        return self.top.roots.select(F.col("digest").alias("root"))


def build(docs: DataFrame) -> Manifest:
    """The manifest of a table with the columns ``FIELDS``; other columns aren't covered.

    Rows of one part are ordered by id (null first), rows of one id by their digest; fully equal
    rows are leaves of their own.  Empty texts differ from null ones.
    """
    leaves, parts = ordered_leaves(docs)
    sizes = parts.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    trees = grow(leaves, levels_of(sizes[0]), "part")
    tops = trees.roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(sizes[1]).cast("long").alias("n"), "digest", F.col("g").alias("part"))
    return Manifest(trees, grow(tops, levels_of(sizes[1]), "top"))


def prove(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``changed`` and ``path`` (siblings up to the root)."""
    nothing = manifest.top.roots.select("g", F.array().cast(_STEP).alias("path"))
    tops = with_paths(manifest.top, nothing).select(F.col("g").alias("top"), F.col("child.part").alias("g"), F.col("child.digest").alias("subroot"), "path")
    tops = known_size(tops, "part-paths")
    rows = with_paths(manifest.parts, tops.select("g", "path"))
    heads = known_size(tops.select("top", "g", "subroot").join(manifest.top.roots.select(F.col("g").alias("top"), F.col("digest").alias("root")), "top"), "part-heads")
    return rows.join(heads.drop("top"), "g").select("child.doc_id", F.col("child.digest").alias("leaf"), "subroot", "root", "child.changed", "path")


def verify(docs: DataFrame) -> DataFrame:
    """Every row's proof, and whether it still holds after the planned tampering.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.  Rows whose id's CRC-32 is a
    multiple of 3 have A-Z of their text lower-cased; ids that are null are left alone.  A text without
    such letters (or null) verifies.  An empty table gives no rows.
    """
    found = prove(build(docs))
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
