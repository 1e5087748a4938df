"""Layout quality of placed nodes: flow direction, overlaps and their mix.

Neither score lists pairs.  Flow direction counts, for every x, the inputs to its
left and the outputs to its right.  Overlap looks nodes up in a grid whose cells are
so small that two nodes of one cell always overlap; only nodes alone in their cell
meet the nodes of the neighbouring cells, which bounds the work per node.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators.ordering import number_bucket, running_totals
from tallyforge.operators.rectangles import BLOCK_ROWS, boxes_met
from tallyforge.session import known_size, materialize

# Node sizes (width, height) by type, the size of other types, and weights.
NODE_SIZES = {
    "in": (100, 50), "out": (100, 50), "instance": (200, 100), "data_instance": (200, 100),
    "setter": (200, 100), "getter": (200, 100), "waypoint": (200, 100),
}
OTHER_SIZE = (120, 60)
INPUT_TYPES = ("in",)
OUTPUT_TYPES = ("out",)
FLOW_WEIGHT = 0.3
OVERLAP_WEIGHT = 0.7

_WIDTHS = [w for w, _ in (*NODE_SIZES.values(), OTHER_SIZE)]
_HEIGHTS = [h for _, h in (*NODE_SIZES.values(), OTHER_SIZE)]
# Two nodes in a cell are closer than the smallest node is wide and high.
_CELL_X, _CELL_Y = min(_WIDTHS), min(_HEIGHTS)
# No two nodes overlap when their centres are further apart than the largest node is wide or high.
_REACH_X, _REACH_Y = max(_WIDTHS), max(_HEIGHTS)


def _size(kind: Column, index: int) -> Column:
    expr = F.lit(float(OTHER_SIZE[index]))
    for name, size in NODE_SIZES.items():
        expr = F.when(kind == name, float(size[index])).otherwise(expr)
    return expr


def role(kind: Column) -> Column:
    """in, out or main; an unknown type counts as main."""
    return F.when(kind.isin(*INPUT_TYPES), "in").when(kind.isin(*OUTPUT_TYPES), "out").otherwise("main")


def explode_layout(programs: DataFrame, keys: Sequence[str], code: str = "code") -> DataFrame:
    """Placed nodes of the first function of each program, one per row."""
    return (programs.select(*keys, F.explode(X.layout_nodes(X.function_block(F.col(code)))).alias("__node"))
            .select(*keys, "__node.*"))


def flow_pairs(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correct and total (in, main) and (main, out) pairs per program.

    Nodes are first reduced to one row per distinct x, so that a running count of
    the inputs and outputs answers "how many lie to the left" for all nodes at once.
    """
    kind = role(F.col("type"))
    at_x = nodes.groupBy(*keys, "x").agg(
        F.count_if(kind == "in").alias("__in"), F.count_if(kind == "main").alias("__main"),
        F.count_if(kind == "out").alias("__out"))
    counted = running_totals(at_x, keys, ["x"], number_bucket("x"),
                             {"__ins": F.col("__in"), "__outs": F.col("__out")}, totals=True)
    left = F.col("__ins") - F.col("__in")
    right = F.col("__outs_total") - F.col("__outs")
    return counted.groupBy(*keys).agg(
        F.sum(F.col("__main") * (left + right)).alias("correct_pairs"),
        (F.sum("__main") * (F.first("__ins_total") + F.first("__outs_total"))).alias("total_pairs"))


def flow_direction_score(pairs: DataFrame) -> DataFrame:
    """Add the share of correct pairs; a program without pairs scores 1."""
    share = F.col("correct_pairs") / F.nullif(F.col("total_pairs"), F.lit(0))
    return pairs.withColumn("flow_score", F.coalesce(share, F.lit(1.0)))


def _boxes(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position, size and cell of every node, numbers only."""
    kind = F.col("type")
    return nodes.select(
        *keys, "x", "y", _size(kind, 0).alias("__w"), _size(kind, 1).alias("__h"),
        F.floor(F.col("x") / _CELL_X).alias("__cx"), F.floor(F.col("y") / _CELL_Y).alias("__cy"))


def _occupied_cells(boxes: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Number of nodes per cell and, of use where it is one, a node of it."""
    return boxes.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("__in_cell"), *[F.min(c).alias(f"__a{c.strip('_')}") for c in ("x", "y", "__w", "__h")])


def _touched_alone(occupied: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of a single node that overlaps a node of another cell.

    A wide cell spans four times the reach, so a node looks into 2 x 2 of them at most.
    No more than 144 single nodes look into any wide cell, which bounds the matches per
    node.
    """
    def wide(position: str, reach: int, shift: int = 0) -> Column:
        return F.floor((F.col(position) + shift) / (4 * reach))

    def span(position: str, reach: int) -> Column:
        return F.explode(F.sequence(wide(position, reach, -reach), wide(position, reach, reach)))

    probes = (occupied.filter(F.col("__in_cell") == 1).drop("__in_cell")
              .withColumn("__wx", span("__ax", _REACH_X)).withColumn("__wy", span("__ay", _REACH_Y)))
    placed = boxes.select(
        *keys, "x", "y", "__w", "__h", F.col("__cx").alias("__bx"), F.col("__cy").alias("__by"),
        wide("x", _REACH_X).alias("__wx"), wide("y", _REACH_Y).alias("__wy"))
    itself = (F.col("__cx") == F.col("__bx")) & (F.col("__cy") == F.col("__by"))
    # A probe becomes four rows at most, so size estimates are off by that at most and Spark may choose the join.
    return (probes.join(placed, [*keys, "__wx", "__wy"]).filter(~itself & _boxes_overlap())
            .select(*keys, "__cx", "__cy").distinct())


def _boxes_overlap() -> Column:
    """Whether a probing node and a placed node intersect; touching edges count."""
    def apart(probe: str, node: str, probe_size: str, node_size: str) -> Column:
        a, b = F.col(probe), F.col(node)
        ha, hb = F.col(probe_size) / 2, F.col(node_size) / 2
        return (a + ha < b - hb) | (a - ha > b + hb)

    return ~(apart("__ax", "x", "__aw", "__w") | apart("__ay", "y", "__ah", "__h"))


def overlap_flags(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct placed nodes with their number of copies and whether they overlap another node.

    Touching edges overlap.  Work per node is bounded by the number of cells a node
    can reach, however many nodes share a place.
    """
    cell = [*keys, "__cx", "__cy"]
    boxes = _boxes(nodes, keys)
    occupied = _occupied_cells(boxes, cell)
    crowded = occupied.filter(F.col("__in_cell") > 1).select(*cell)
    hit = _touched_alone(occupied, boxes, keys).unionByName(crowded).withColumn("__hit", F.lit(True))
    spots = nodes.groupBy(*keys, "type", "x", "y").agg(F.count(F.lit(1)).alias("copies")).withColumns(
        {"__cx": F.floor(F.col("x") / _CELL_X), "__cy": F.floor(F.col("y") / _CELL_Y)})
    return spots.join(hit, cell, "left").select(
        *keys, "type", "x", "y", "copies", F.coalesce("__hit", F.lit(False)).alias("overlapping"))


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def _links_in_lists(spots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links of spots in programs of a few: each looks through its program's list."""
    def apart(other: Column, position: str, size: str) -> Column:
        return (F.col(f"s.{position}") + F.col(f"s.{size}") / 2 < other[position] - other[size] / 2) | (
            F.col(f"s.{position}") - F.col(f"s.{size}") / 2 > other[position] + other[size] / 2)

    own = ["type", "x", "y", "copies", "__w", "__h"]
    lists = spots.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("__all"))
    each = lists.select(*keys, "__all", F.explode("__all").alias("s"))
    near = F.filter("__all", lambda o: ~(apart(o, "x", "__w") | apart(o, "y", "__h")))
    return each.select(*keys, "s.type", "s.x", "s.y", F.col("s.copies").alias("copies"),
                       F.aggregate(near, F.lit(-1).cast("long"), lambda n, o: n + o["copies"]).alias("links"))


def _links_by_rank(spots: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Links of spots in crowded programs (``__g`` numbers them) by counting in rectangles."""
    sizes = sorted({*NODE_SIZES.values(), OTHER_SIZE})
    kind = reduce(lambda e, i: F.when((F.col("__w") == sizes[i][0]) & (F.col("__h") == sizes[i][1]), i).otherwise(e), range(1, len(sizes)), F.lit(0))

    def place(position: str) -> Column:
        """Null stands before all numbers, NaN behind them."""
        at = F.col(position).cast("double")
        return F.when(F.isnan(at), float("inf")).otherwise(F.coalesce(at, F.lit(-float("inf")))) + F.lit(0.0)

    placed = materialize(spots.select(*keys, "type", "x", "y", "copies", F.col("__g").alias("g"), kind.alias("c"), place("x").alias("__x"), place("y").alias("__y")),
                         "crowded-spots")
    points = materialize(placed.groupBy("g", "c", F.col("__x").alias("x"), F.col("__y").alias("y")).agg(F.sum("copies").alias("copies")), "crowded-points")
    met = boxes_met(points, sizes, block_rows).select("g", "c", F.col("x").alias("__x"), F.col("y").alias("__y"), "met")
    return placed.join(met, ["g", "c", "__x", "__y"]).select(*keys, "type", "x", "y", "copies", (F.col("met") - 1).alias("links"))


def overlap_links(nodes: DataFrame, keys: Sequence[str], few: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct placed nodes with their number of copies and of ``links``, the other nodes that each copy overlaps (runs jobs).

    Touching edges overlap, copies do too.  No pair of nodes is listed: programs of at most ``few`` distinct nodes
    are a row each, larger ones are counted in blocks of ``block_rows`` nodes or more (see ``rectangles``).
    """
    spots = nodes.groupBy(*keys, "type", "x", "y").agg(F.count(F.lit(1)).alias("copies")).withColumns(
        {"__w": _size(F.col("type"), 0), "__h": _size(F.col("type"), 1)})
    crowds = spots.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > few)
    crowds = known_size(crowds.select(*keys, F.monotonically_increasing_id().alias("__g")), "crowded-programs")
    left, right = spots.alias("l"), crowds.alias("r")
    links = _links_in_lists(left.join(right, _same(keys), "left_anti"), keys)
    if not crowds.isEmpty():
        links = links.unionByName(_links_by_rank(left.join(right, _same(keys)).select("l.*", "r.__g"), keys, block_rows))
    return links.withColumn("overlapping", F.col("links") > 0)


def overlap_score(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of nodes that overlap no other node, and the number of nodes.

    Only nodes alone in their cell can be clear, so counting cells is enough.
    """
    boxes = _boxes(nodes, keys)
    occupied = _occupied_cells(boxes, [*keys, "__cx", "__cy"])
    none = F.lit(0).cast("long")
    cells = occupied.select(*keys, F.col("__in_cell").alias("nodes"),
                            (F.col("__in_cell") == 1).cast("long").alias("__clear"))
    touched = _touched_alone(occupied, boxes, keys).select(*keys, none.alias("nodes"), F.lit(-1).cast("long").alias("__clear"))
    return cells.unionByName(touched).groupBy(*keys).agg(
        F.sum("nodes").alias("nodes"), (F.sum("__clear") / F.sum("nodes")).alias("overlap_score"))


def layout_score(nodes: DataFrame, keys: Sequence[str], programs: DataFrame | None = None) -> DataFrame:
    """Weighted mix of both scores per program.

    ``programs`` may list programs without any node or function; they score 0.
    """
    parts = flow_direction_score(flow_pairs(nodes, keys)).select(*keys, "flow_score").unionByName(
        overlap_score(nodes, keys), allowMissingColumns=True)
    merged = parts.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("flow_score", "nodes", "overlap_score")])
    scored = merged.withColumn(
        "layout_score", F.lit(FLOW_WEIGHT) * F.col("flow_score") + F.lit(OVERLAP_WEIGHT) * F.col("overlap_score"))
    if programs is None:
        return scored
    return (programs.select(*keys).join(scored.select(*keys, "layout_score"), list(keys), "left")
            .withColumn("layout_score", F.coalesce("layout_score", F.lit(0.0))))


def nodes_at_flow(scores: DataFrame, run_keys: Sequence[str], task: str = "task_id",
                  score: str = "layout_score") -> DataFrame:
    """Mean over tasks of the mean score of their valid candidates.

    Candidates without a score are ignored, and so are tasks with none; a run
    without any score gets 0.
    """
    per_task = scores.groupBy(*run_keys, task).agg(F.avg(score).alias("__mean"))
    return per_task.groupBy(*run_keys).agg(F.coalesce(F.avg("__mean"), F.lit(0.0)).alias("nodes_at_flow"))
