"""Pairs of vectors within an angle, by a dual traversal of cover trees.

Unit vectors at cosine c are ``sqrt(2 - 2c)`` apart, a metric.  A cover tree nests levels of centres:
each level has half the radius of the one above, keeps its centres, and every vector lies within
the radius of a centre.  Two nodes whose centres are further apart than the threshold plus both covering
radii hold no link; nearer than the threshold less both, every pair is one.  Only what neither rules out is
opened further.  Bounds use the radii that members really have, so the result is exact however
the centres were chosen.

* *Top.*  Centres come from a bounded sample (``TOP_ROWS`` vectors).  Every vector falls to its nearest
  lowest centre (a cell), and cells follow each other in the tree's order.
* *Pieces.*  Neighbouring cells form pieces of bounded size, large cells are cut.  In each piece a
  tree is grown down to the radius ``NODE_RADIUS``; its lowest nodes, a centre with a covering radius and
  the number of vectors, stand for their members from then on.  A crowd of copies is one node per piece.
* *Traversal.*  Nodes go once more into pieces, now of nodes, and to each later piece that holds a cell
  within reach.  Each task runs the traversal on the piece and its visitors.  It returns numbers
  of linked vectors and a forest of links, never the pairs.
* *Undecided* node pairs, which the bounds leave open, meet with their members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_arrow
from tallyforge.llm.components import component_roots
from tallyforge.session import known_size, materialize

MIN_COSINE = 0.95
TOP_ROWS = 2048
PIECE_ROWS = 8192
_LEAST_ROWS = 512  # pieces are smaller than asked for, but not smaller than this, if there are fewer of them than cores
TOP_RADII = (1.0, 0.5)
NODE_RADIUS = 1 / 32
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625, NODE_RADIUS)
_CHUNK = 512
_SLACK = 1e-7  # bounds give way to rounding; cosines this close to the threshold are computed anew


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chord lengths between rows of unit vectors."""
    found = a @ b.T  # one matrix, changed in place
    found *= -2.0
    found += 2.0
    return np.sqrt(np.maximum(found, 0.0, out=found), out=found)


def reach_of(cosine: float) -> float:
    return float(np.sqrt(2.0 - 2.0 * cosine))


# ---- trees ----

def cover(vectors: np.ndarray, rows: np.ndarray, radius: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres among ``rows`` (the first one always) such that each row has one within ``radius``, and each row's number of it.

    Candidates are taken a block at a time; one that an earlier centre covers is none.  More than ``most`` centres are none at all.
    """
    owner = np.full(len(rows), -1)
    centres: list[int] = []
    left = np.arange(len(rows))
    while len(left):
        block = left[:256]
        gaps = distances(vectors[rows[block]], vectors[rows[left]])
        near = gaps <= radius
        open_ = np.ones(len(left), dtype=bool)
        for i in range(len(block)):  # block[i] is left[i]
            if open_[i]:
                hit = near[i] & open_
                hit[i] = True
                owner[left[hit]] = len(centres)
                centres.append(int(rows[block[i]]))
                open_ &= ~hit
        left = left[open_]
        if most is not None and len(centres) > most:
            return None
    return np.array(centres, dtype=np.int64), owner


@dataclass
class CoverTree:
    """Nested levels over unit ``vectors``, rows in tree order.

    ``centres[k]`` are rows of ``vectors``; ``owner[k]`` gives each vector's centre of level k as a number,
    never decreasing along ``order``; ``radius[k]`` is the largest distance of a member, its own ``radii`` included.
    """

    vectors: np.ndarray
    order: np.ndarray
    centres: list[np.ndarray]
    owner: list[np.ndarray]
    radius: list[np.ndarray]

    @staticmethod
    def grow(vectors: np.ndarray, radii: tuple[float, ...], own: np.ndarray | None = None, most: int | None = None) -> CoverTree:
        """With ``most``, the tree ends above the first level that has more centres."""
        own = np.zeros(len(vectors)) if own is None else own
        sets, centres, owner, reach = [np.arange(len(vectors))] if len(vectors) else [], [], [], []
        for radius in radii:
            next_sets, level = [], []
            for rows in sets:
                if len(rows) == 1:
                    next_sets.append(rows)
                    level.append(rows)
                    continue
                covered = cover(vectors, rows, radius, None if most is None else most - len(next_sets))
                if covered is None:
                    break
                found, part = covered
                by_part = np.split(rows[np.argsort(part, kind="stable")], np.cumsum(np.bincount(part, minlength=len(found)))[:-1])
                # The centre comes first, so it stays one on all levels below.
                next_sets += [np.concatenate(([c], r[r != c])) for c, r in zip(found, by_part, strict=True)]
                level.append(found)
            if sum(map(len, next_sets)) < len(vectors):
                break
            sets = next_sets
            centres.append(np.concatenate(level) if level else np.zeros(0, np.int64))
            mine = np.empty(len(vectors), dtype=np.int64)
            sizes = [len(s) for s in sets]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            mine[flat] = np.repeat(np.arange(len(sets)), sizes)
            owner.append(mine)
            gaps = vectors - vectors[centres[-1][mine]]
            far = np.zeros(len(sets))
            np.maximum.at(far, mine, np.sqrt(np.einsum("ij,ij->i", gaps, gaps)) + own)
            reach.append(far)
        order = np.concatenate(sets) if len(vectors) else np.zeros(0, np.int64)
        return CoverTree(vectors, order, centres, owner, reach)


def node_pairs(a: CoverTree, own_a: np.ndarray, b: CoverTree, own_b: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Dual traversal: pairs of vectors (rows of ``a``, rows of ``b``) that may be within ``reach`` plus their own radii, and their distance.

    Node pairs out of reach are dropped level by level, the pairs of a level's survivors' children
    are all that the next one looks at.  Levels that hardly have fewer centres than the next one are skipped.
    """
    alive, above = None, None
    for k in range(min(len(a.centres), len(b.centres))):
        small = 4 * max(len(a.centres[k]), len(b.centres[k]))
        if small > max(len(a.vectors), len(b.vectors)) or len(a.centres[k]) * len(b.centres[k]) > 1 << 22:
            break
        within = distances(a.vectors[a.centres[k]], b.vectors[b.centres[k]]) <= reach + a.radius[k][:, None] + b.radius[k][None, :] + _SLACK
        if alive is not None:
            within &= alive[np.ix_(a.owner[above][a.centres[k]], b.owner[above][b.centres[k]])]
        alive, above = within, k
    for start in range(0, len(a.order), _CHUNK):
        rows = a.order[start:start + _CHUNK]
        columns = b.order
        if alive is not None:
            columns = columns[alive[np.unique(a.owner[above][rows])].any(axis=0)[b.owner[above][columns]]]
        if not len(columns):
            continue
        gaps = distances(a.vectors[rows], b.vectors[columns])
        i, j = np.nonzero(gaps <= reach + own_a[rows].max() + own_b[columns].max() + _SLACK)
        gaps, i, j = gaps[i, j], rows[i], columns[j]
        near = gaps <= reach + own_a[i] + own_b[j] + _SLACK
        if near.any():
            yield i[near], j[near], gaps[near]


def _linked(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, gaps: np.ndarray, cosine: float) -> np.ndarray:
    """Whether rows i of ``u`` and j of ``v`` have the cosine; what is close to it is summed in one fixed way."""
    cos = 1.0 - gaps * gaps / 2.0
    found = cos >= cosine
    close = np.flatnonzero(np.abs(cos - cosine) < _SLACK)
    if len(close):
        found[close] = (u[i[close]] * v[j[close]]).sum(axis=1) >= cosine
    return found


class Forest:
    """Links that join what wasn't joined yet."""

    def __init__(self):
        self.top: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        top = self.top
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self._find(x), self._find(y)
            if i != j:
                self.top[i] = j
                self.links.append((x, y))


# ---- pieces ----

def _cut(cells: list, piece_rows: int) -> dict[int, tuple[int, int]]:
    """First piece and number of pieces of each cell, from (cell, rows) in tree order."""
    found, piece, held = {}, 0, 0
    for cell, n in cells:
        if held and held + n > piece_rows:
            piece, held = piece + 1, 0
        if n > piece_rows:
            parts = -(-n // piece_rows)
            found[cell] = (piece, parts)
            piece, held = piece + parts, 0
        else:
            found[cell] = (piece, 1)
            held += n
    return found


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Whole groups of sorted rows; a group may span batches.  With ``most``, those whose last key is false come in parts of at most so many rows."""
    held: list[pa.RecordBatch] = []
    last, size, step = None, 0, min(2048, most or 2048)
    for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
        values = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        edges = np.concatenate(([0], np.flatnonzero((np.diff(values, axis=0) != 0).any(axis=1)) + 1, [len(values)]))
        for s, e in zip(edges, edges[1:], strict=False):
            key = tuple(values[s])
            if held and (key != last or (most and not key[-1] and size + e - s > most)):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(s, e - s))
            last, size = key, size + e - s
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _nodes_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grow a tree in each piece: one row per vector with its node (the centre's class) and distance."""
    for rows in _groups(batches, ["dims", "piece"]):
        u = unit(_matrix(_column(rows, "v"), rows["dims"][0].as_py()))
        tree = CoverTree.grow(u, RADII)
        node = tree.centres[-1][tree.owner[-1]]
        ids = _column(rows, "class").to_numpy()
        gaps = u - u[node]
        yield pa.RecordBatch.from_arrays(
            [_column(rows, c) for c in ("dims", "cell", "fall", "class", "n", "v")]
            + [pa.array(ids[node]), pa.array(np.where(node == np.arange(len(u)), 0.0, np.sqrt(np.einsum("ij,ij->i", gaps, gaps))))],
            ["dims", "cell", "fall", "class", "n", "v", "node", "gap"])


def _traverse(reach: float, cosine: float, visitor_rows: int = PIECE_ROWS):
    """A piece's own nodes come first and stay; its visitors stream by, ``visitor_rows`` at a time, however many they are."""
    def decide(here: tuple, there: tuple, inside: bool) -> Iterator[pa.RecordBatch]:
        (tree, ids, own, n), (other, their_ids, their_own, their_n) = here, there
        u, v = tree.vectors, other.vectors
        forest, linked, open_pairs = Forest(), np.zeros(len(u), dtype=np.int64), []
        theirs = linked if inside else np.zeros(len(v), dtype=np.int64)
        for x, y, gaps in node_pairs(tree, own, other, their_own, reach):
            if inside:
                keep = x < y
                x, y, gaps = x[keep], y[keep], gaps[keep]
            spread = own[x] + their_own[y]
            single = spread == 0
            sure = gaps <= reach - spread - _SLACK
            if single.any():
                sure[single] = _linked(u, v, x[single], y[single], gaps[single], cosine)
            np.add.at(linked, x[sure], their_n[y[sure]])
            np.add.at(theirs, y[sure], n[x[sure]])
            forest.add(ids[x[sure]], their_ids[y[sure]])
            unsure = ~sure & ~single
            open_pairs.append(np.column_stack([ids[x[unsure]], their_ids[y[unsure]]]))
        sums = [(ids, linked)] if inside else [(ids, linked), (their_ids, theirs)]
        touched = np.concatenate([i[s > 0] for i, s in sums])
        a, b = (np.array(forest.links, dtype=np.int64).reshape(-1, 2)).T
        undecided = np.concatenate(open_pairs) if open_pairs else np.zeros((0, 2), np.int64)
        kinds = np.repeat(np.array([0, 1, 2], dtype=np.int32), [len(touched), len(a), len(undecided)])
        left = np.concatenate([touched, a, undecided[:, 0]])
        right = np.concatenate([*[s[s > 0] for _, s in sums], b, undecided[:, 1]])
        for s in range(0, len(kinds), 1 << 16):
            e = s + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[s:e]), pa.array(left[s:e]), pa.array(right[s:e])], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, piece = None, None
        for rows in _groups(batches, ["dims", "piece", "home"], visitor_rows):
            dims, key = rows["dims"][0].as_py(), (rows["dims"][0].as_py(), rows["piece"][0].as_py())
            inside = rows["home"][0].as_py()
            if not inside and key != piece:
                continue  # no node of its own
            u = unit(_matrix(_column(rows, "v"), dims))
            ids, own, n = (_column(rows, c).to_numpy(zero_copy_only=False) for c in ("node", "radius", "n"))
            # Levels with more centres than a quarter of the larger side's nodes aren't looked at.
            met = (CoverTree.grow(u, RADII, own, max(len(u), visitor_rows if inside else len(home[1])) // 4), ids, own, n)
            if inside:
                home, piece = met, key
            yield from decide(home, met, inside)

    return run


def _members(reach: float, cosine: float):
    """Groups of an undecided pair's members, ``left`` tells the node: numbers and links of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["a", "b"]):
            u = unit(_matrix(_column(rows, "v"), rows["dims"][0].as_py()))
            ids, n, left = (_column(rows, c).to_numpy(zero_copy_only=False) for c in ("class", "n", "left"))
            forest, linked = Forest(), np.zeros(len(u), dtype=np.int64)
            x, y = np.flatnonzero(left), np.flatnonzero(~left)
            for s in range(0, len(x), _CHUNK):
                gaps = distances(u[x[s:s + _CHUNK]], u[y])
                i, j = np.nonzero(gaps <= reach + _SLACK)
                p, q = x[s:s + _CHUNK][i], y[j]
                hit = _linked(u, u, p, q, gaps[i, j], cosine)
                np.add.at(linked, p[hit], n[q[hit]])
                np.add.at(linked, q[hit], n[p[hit]])
                forest.add(ids[p[hit]], ids[q[hit]])
            touched = np.flatnonzero(linked)
            a, b = (np.array(forest.links, dtype=np.int64).reshape(-1, 2)).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([0, 1], dtype=np.int32), [len(touched), len(a)])),
                 pa.array(np.concatenate([ids[touched], a])), pa.array(np.concatenate([linked[touched], b]))], ["kind", "a", "b"])

    return run


_FOUND = "kind int, a bigint, b bigint"


class Top:
    """The tree's top levels: lowest centres in tree order, one set for vectors of the sample's usual length."""

    def __init__(self, sample: np.ndarray):
        self.dims = sample.shape[1] if len(sample) else -1
        u = unit(sample) if len(sample) else sample
        tree = CoverTree.grow(u, TOP_RADII)
        lowest = tree.centres[-1]
        self.centres = u[tree.order[np.isin(tree.order, lowest)]]
        self.apart = distances(self.centres, self.centres) if len(sample) else np.zeros((0, 0))

    def fall(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre of each vector and all distances."""
        gaps = distances(u, self.centres)
        return gaps.argmin(axis=1), gaps


def _with_cell(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: Top = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                sizes = batch.column("dims").to_numpy()
                cell, fall = np.full(batch.num_rows, -1, dtype=np.int32), np.zeros(batch.num_rows)
                at = np.flatnonzero(sizes == top.dims)
                if len(at):
                    cell[at], gaps = top.fall(unit(_matrix(batch.column("v").take(pa.array(at)), top.dims)))
                    fall[at] = gaps[np.arange(len(at)), cell[at]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(fall)], [*batch.schema.names, "cell", "fall"])

    return run


def _with_pieces(rows: DataFrame, reaches: str, piece_rows: int, key: str) -> tuple[DataFrame, dict[int, tuple[np.ndarray, ...]]]:
    """``piece`` of each row, numbered in the order of cells; and per length the cells, their first piece, parts and radius.

    The cells come to the driver: at most ``TOP_ROWS``, and one for every odd length.
    """
    found = rows.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(reaches)).alias("r")).orderBy("dims", "cell").collect()
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    piece_rows = min(piece_rows, max(_LEAST_ROWS, -(-sum(c.n for c in found) // tasks)))
    places, table = {}, []
    for dims in sorted({c.dims for c in found}):
        own = [c for c in found if c.dims == dims]
        cut = _cut([(c.cell, c.n) for c in own], piece_rows)
        table += [(dims, cell, *where) for cell, where in cut.items()]
        places[dims] = (np.array([c.cell for c in own]), *np.array([cut[c.cell] for c in own]).T, np.array([c.r for c in own]))
    cells = known_size(rows.sparkSession.createDataFrame(table, "dims int, cell int, first int, parts int"), "cell-pieces")
    return rows.join(cells, ["dims", "cell"]).withColumn(
        "piece", F.col("first") + F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("first", "parts"), places


def _visits(shared):
    """Each node at home and, once more, in each later piece (or other part of its cell) that holds a cell within reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, places, reach = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes, piece, own = (batch.column(c).to_numpy() for c in ("dims", "piece", "radius"))
                rows, target = [np.arange(batch.num_rows)], [piece]
                for dims in np.unique(sizes):
                    at = np.flatnonzero(sizes == dims)
                    cells, first, parts, radius = places[dims]
                    if dims == top.dims:
                        _, gaps = top.fall(unit(_matrix(batch.column("v").take(pa.array(at)), dims)))
                        near = gaps[:, cells] <= reach + own[at][:, None] + radius + _SLACK
                        # Centres of another cell are nearer to its centre than to that of the node's own cell.
                        home = batch.column("cell").to_numpy()[at]
                        apart = top.apart[np.ix_(home, cells)]
                        beyond = (gaps[:, cells] ** 2 - gaps[np.arange(len(at)), home][:, None] ** 2) / np.maximum(2 * apart, 1e-12)
                        near &= (beyond <= reach + own[at][:, None] + NODE_RADIUS + _SLACK) | (apart < 1e-6)
                    else:
                        near = np.ones((len(at), len(cells)), dtype=bool)
                    # Cells of one piece follow each other; a cell in several parts has its pieces for itself.
                    pieces, starts = np.unique(first, return_index=True)
                    near = np.logical_or.reduceat(near, starts, axis=1)
                    for part in range(parts.max()):
                        i, j = np.nonzero(near & (parts[starts] > part) & (pieces + part > piece[at][:, None]))
                        rows.append(at[i])
                        target.append(pieces[j] + part)
                rows, target = np.concatenate(rows), np.concatenate(target)
                home = np.zeros(len(rows), dtype=bool)
                home[:batch.num_rows] = True
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("dims"), pa.array(target.astype(np.int32)), pa.array(home)] + [taken.column(c) for c in ("node", "radius", "n", "v")],
                    ["dims", "piece", "home", "node", "radius", "n", "v"])

    return run


def link_classes(classes: DataFrame, cosine: float = MIN_COSINE, top_rows: int = TOP_ROWS, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Links among distinct vectors (``class``, ``n`` copies, ``v``; none null, zero or not finite).

    Two written tables: ``class``, ``others`` (how many vectors of other classes are linked) and ``a``, ``b``,
    a set of links that joins what is linked, directly or by way of others.  Vectors of
    different lengths have no cosine, so no link.
    """
    if not 2 * NODE_RADIUS < reach_of(cosine):
        raise ValueError("members of a node must be linked: the cosine is too high for NODE_RADIUS")
    context, reach = classes.sparkSession.sparkContext, reach_of(cosine)
    value = classes.schema["v"].dataType.simpleString()
    sized = classes.withColumn("dims", F.size("v"))
    usual = sized.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    sample = [] if usual is None else sized.filter(F.col("dims") == usual.dims).orderBy(F.xxhash64("class"), "class").limit(top_rows).select("v").collect()
    top = Top(np.array([r.v for r in sample], dtype=np.float64).reshape(len(sample), -1 if sample else 0))
    celled = map_arrow(sized, _with_cell(context.broadcast(top)), f"class bigint, n bigint, v {value}, dims int, cell int, fall double")
    pieced, _ = _with_pieces(materialize(celled, "cells"), "fall", piece_rows, "class")
    noded = materialize(map_arrow(pieced.select("dims", "piece", "cell", "fall", "class", "n", "v").repartition("dims", "piece").sortWithinPartitions("dims", "piece", "class"),
                                  _nodes_of_pieces, f"dims int, cell int, fall double, class bigint, n bigint, v {value}, node bigint, gap double"), "nodes")
    totals = noded.groupBy("node").agg(F.sum("n").alias("n"), F.max("gap").alias("radius"))
    centres = noded.filter("class = node").select("dims", "cell", "fall", "node", "v").join(totals, "node")
    centres, places = _with_pieces(materialize(centres, "node-centres"), "fall + radius", piece_rows, "node")
    visits = map_arrow(centres.select("dims", "cell", "piece", "node", "radius", "n", "v"), _visits(context.broadcast((top, places, reach))),
                       f"dims int, piece int, home boolean, node bigint, radius double, n bigint, v {value}")
    met = visits.repartition("dims", "piece").sortWithinPartitions("dims", "piece", F.desc("home"), "node")
    decided = materialize(map_arrow(met, _traverse(reach, cosine), _FOUND), "node-links")
    undecided = decided.filter("kind = 2").select("a", "b")
    members = noded.select("node", "dims", "class", "n", "v")
    sides = [undecided.join(members, F.col(side) == F.col("node")).select("a", "b", F.lit(side == "a").alias("left"), "dims", "class", "n", "v") for side in "ab"]
    met = sides[0].union(sides[1]).repartition("a", "b").sortWithinPartitions("a", "b", F.desc("left"), "class")
    single = materialize(map_arrow(met, _members(reach, cosine), _FOUND), "member-links")
    # Members of one node are linked; a node's links are those of each of its members.
    of_node = decided.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("linked"))
    of_node = totals.join(of_node, "node", "left").select("node", (F.col("n") + F.coalesce("linked", F.lit(0))).alias("held"))
    of_class = single.filter("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("linked"))
    counts = noded.select("class", "node", "n").join(of_node, "node").join(of_class, "class", "left").select(
        "class", (F.col("held") - F.col("n") + F.coalesce("linked", F.lit(0))).alias("others"))
    links = noded.filter("class <> node").select(F.col("class").alias("a"), F.col("node").alias("b"))
    for found in (decided, single):
        links = links.union(found.filter("kind = 1").select("a", "b"))
    return materialize(counts, "class-counts"), materialize(links, "class-links")


def similar_vectors(vectors: DataFrame, cosine: float = MIN_COSINE, id_column: str = "vec_id", vector_column: str = "embedding",
                    top_rows: int = TOP_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links``, ``component_id``, ``kept``.

    Links join vectors of cosine ``cosine`` or more, in double precision.  Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, and are their own component.  Equal rows and
    repeated ids are vectors of their own; a null id is never a component's smallest, and its row isn't
    kept.  An empty table gives no rows; other columns aren't read.
    """
    v = F.col(f"`{vector_column}`")
    able = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.when(able, v).alias("v"))
    classes = rows.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    counts, links = link_classes(classes.select("class", "n", "v"), cosine, top_rows, piece_rows)
    rooted = classes.select("class", "n", "least").join(component_roots(links).withColumnRenamed("a", "class"), "class", "left").join(counts, "class").select(
        "class", "n", "least", "others", F.coalesce("root", "class").alias("root"))
    rooted = materialize(rooted, "class-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    info = rooted.join(least, "root").select("class", (F.col("n") - 1 + F.col("others")).alias("n_links"), "component_id")
    found = rows.join(classes.select("v", "class").join(info, "class"), "v", "left").select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
