"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: how strongly it is drawn on at each moment of the
training, a piecewise linear curve over time 0 to 1.  Weights give the words each source
owes in all (its target); the schedule, integrated, gives how much of that is due up to any
moment.  Inverting this cumulative demand at a document's running total of words gives
the document's training position, and a range sort by position is the training order.

A source that owes more than it has is read again from the start, pass by pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import WORD
from tallyforge.session import known_size

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
# For the sources in turn: fading out, steady, growing.  Points (time, strength); scaled to integral 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
_BUCKET_DIGITS = 3  # 4,096 runs of each source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``source, n, source_size, target`` from ``source, source_size``: one row per source.

    ``n`` counts the sources by code point, null last; weights repeat along it.  The
    targets share the sum of all sizes by weight.  No target exceeds ``most`` times its source; what
    that leaves is shared again by weight until none does, in one pass: in the order
    in which sources reach their limit, the first whose limit isn't reached sets the
    level (target per weight) of all that follow.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("n", F.row_number().over(ordered) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")))
    limited = numbered.withColumn("most", F.col("source_size") * most)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    level = limited.select(
        "*", ((F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
              / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("level"))
    open_ = level.withColumn("share", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"),
                                                   F.struct(F.col("most") / F.col("weight"), "n", "level"))).over(everything)["level"])
    return open_.select("source", "n", "source_size",
                        F.least(F.coalesce("share", F.lit(0.0)) * F.col("weight"), F.col("most").cast("double")).alias("target"))


def schedule_pieces(points: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(start, strength there, slope, demand before, demand after) of each piece, with integral 1."""
    if points[0][0] != 0 or points[-1][0] != 1 or any(v < 0 for _, v in points):
        raise ValueError("a schedule runs from time 0 to 1 and is never negative")
    pieces = list(zip(points, points[1:], strict=False))
    total = sum((t2 - t1) * (v1 + v2) / 2 for (t1, v1), (t2, v2) in pieces)
    out, held = [], 0.0
    for (t1, v1), (t2, v2) in pieces:
        area = (t2 - t1) * (v1 + v2) / 2 / total
        out.append((t1, v1 / total, (v2 - v1) / (t2 - t1) / total, held, held + area))
        held += area
    return out


def demand_time(share: Column, points: tuple[tuple[float, float], ...]) -> Column:
    """The moment at which the integrated schedule reaches ``share`` (0 to 1) of the whole demand."""
    found = F.lit(1.0)
    for start, strength, slope, before, after in reversed(schedule_pieces(points)):
        due = share - before
        # strength * x + slope / 2 * x^2 = due, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(strength * strength) + due * (2 * slope), F.lit(0.0)))
        x = F.when(due <= 0, F.lit(0.0)).otherwise(2 * due / (F.lit(strength) + root))
        found = F.when(share <= after, F.lit(start) + x).otherwise(found)
    return found


def with_passes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, schedules=SCHEDULES,
                carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as ``row`` (its columns ``carry``, by default all), with ``size, source_size, target, taken, passes``.

    ``passes`` has for each time the mix reads the document its number, the words taken
    and the ``position``; only the last one of a source may be cut, so that each source
    gives its target to the word (rounded).  Documents of a source come in the order of
    the MD5 of their id (of their text if the id is null); equal rows tie, which changes
    nothing.  Texts of no words (null, blank) have size 0 and no pass.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(row.alias("row"), F.col("source"), F.col("doc_id"), word_count(F.col("text")).alias("size"),
                       key.alias("key")).withColumn("bucket", F.substring("key", 1, _BUCKET_DIGITS))
    # Null-free keys: the window and the join share one exchange of the wide rows.
    rows = rows.withColumns({"s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    runs = known_size(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-runs")
    targets = source_targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col("source").alias("of"), "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    starts = known_size(starts.join(targets, F.col("of").eqNullSafe(F.col("source"))).select(
        F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "bucket", "base", "n", "source_size", "target"), "mix-starts")
    inside = Window.partitionBy("s", "none", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, ["s", "none", "bucket"])
    due = F.round("target").cast("long")
    first = F.col("base") + F.col("inside")
    kinds = len(schedules)

    def one(p: int) -> Column:
        at = F.col("first") + F.col("source_size") * p
        share = F.when(F.col("due") > 0, at / F.col("due"))
        time = F.coalesce(*[F.when(F.col("n") % kinds == k, demand_time(share, points)) for k, points in enumerate(schedules)])
        return F.struct(F.lit(p).alias("pass"), F.greatest(F.lit(0), F.least(F.col("size"), F.col("due") - at)).cast("long").alias("words"),
                        time.alias("position"))

    counted = placed.select("row", "size", "source_size", "target", "n", due.alias("due"), first.alias("first"))
    passes = F.filter(F.array(*[one(p) for p in range(most + 1)]), lambda x: x["words"] > 0)
    return counted.select("row", "size", "source_size", "target", passes.alias("passes")).withColumn(
        "taken", F.aggregate("passes", F.lit(0).cast("long"), lambda n, x: n + x["words"]))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once per pass, range-sorted by position.

    Columns of ``docs`` as ``row``, its ``size``, and ``pass``, ``words``, ``position``.
    """
    mixed = with_passes(docs, **options).select("row", "size", F.explode("passes").alias("p"))
    return mixed.select("row", "size", "p.*").orderBy("position", "pass", F.col("row.doc_id"))
