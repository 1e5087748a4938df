"""Running totals, ranks and look-ahead inside groups of any size.

A plain window puts a whole group into one task.  Here groups are always cut into buckets
that follow the sort order; the window runs per (group, bucket), and the per-bucket
summaries, which are small, carry the group-wide offset.  Rows are exchanged once, by
(group, bucket); summaries and windows read the same exchange.  The result equals the plain window
for any bucket expression that never decreases along the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import materialize

_BEFORE_ALL = Window.unboundedPreceding
_FIRST_BUCKET = -(2 ** 62)


def _filler(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    return F.lit(0).cast(dtype)


def with_group_keys(df: DataFrame, keys: Sequence[str], bucket: Column) -> tuple[DataFrame, list[str]]:
    """Add join-safe copies of the keys (null gets a filler plus a flag) and the bucket."""
    names, columns = [], []
    for i, key in enumerate(keys):
        field = df.schema[key]
        columns.append(F.coalesce(F.col(key), _filler(field.dataType)).alias(f"__g{i}"))
        columns.append(F.col(key).isNull().alias(f"__n{i}"))
        names += [f"__g{i}", f"__n{i}"]
    # Non-null on purpose: no null filter gets pushed into one reader of ``df`` only, so
    # that the readers can share their exchange.
    return df.select("*", *columns, F.coalesce(bucket, F.lit(_FIRST_BUCKET)).alias("__bucket")), names


def _in_buckets(df: DataFrame, keys: Sequence[str], bucket: Column) -> tuple[DataFrame, list[str]]:
    """Rows exchanged by group keys and bucket; every reader shares the exchange."""
    tagged, group = with_group_keys(df, keys, bucket)
    return tagged.repartition(*group, "__bucket"), group


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
                   values: dict[str, Column], totals: bool = False) -> DataFrame:
    """Add, for each name in ``values``, the sum from the start of the group up to this row.

    ``bucket`` must never decrease along ``order`` (null comes first); ``order`` should
    be unique within a group so that the result does not depend on the partitioning.
    With ``totals``, the sum over the whole group is added as ``<name>_total``.
    """
    names = list(values)
    valued = df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()])
    tagged, group = _in_buckets(valued, keys, bucket)
    sums = tagged.groupBy(*group, "__bucket").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    # One row per bucket from here on; without keys that is one task over the buckets.
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("__bucket").rowsBetween(_BEFORE_ALL, -1)
    offsets = sums.select(
        *group, "__bucket",
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in names],
        *([F.sum(f"__s_{n}").over(whole).alias(f"__t_{n}") for n in names] if totals else []))
    upto = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(_BEFORE_ALL, 0)
    local = tagged.select("*", *[F.sum(f"__v_{n}").over(upto).alias(f"__l_{n}") for n in names])
    return local.join(offsets, [*group, "__bucket"]).select(
        *df.columns, *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in names],
        *([F.col(f"__t_{n}").alias(f"{n}_total") for n in names] if totals else []))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
                out: str, totals: bool = False) -> DataFrame:
    """Add ``out``: 1-based position of the row in its group, optionally with the group size."""
    return running_totals(df, keys, order, bucket, {out: F.lit(1).cast("long")}, totals)


def next_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                  value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the following row of the group, null for the last row."""
    tagged, group = _in_buckets(df, keys, bucket)
    within = Window.partitionBy(*group, "__bucket").orderBy(*order)
    heads = tagged.groupBy(*group, "__bucket").agg(F.min_by(F.struct(value), F.struct(*order)).alias("__head"))
    following = heads.select(
        *group, "__bucket",
        F.lead("__head").over(Window.partitionBy(*group).orderBy("__bucket")).alias("__next_head"))
    return (
        tagged.withColumn("__next", F.lead(F.struct(value)).over(within))
        .join(following, [*group, "__bucket"])
        .withColumn(out, F.coalesce("__next", "__next_head")[value])
        .select(*df.columns, out)
    )


def numbered_in_order(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: 1-based position of the row in the order of all rows (runs a job).

    For orders without a natural bucket, such as texts: rows are dealt into ranges
    of the whole order by sampled bounds and written once, each range is numbered by itself, and
    the sizes of the ranges before it are added.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(_BEFORE_ALL, -1)  # one row per range
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return placed.withColumn("__pos", F.row_number().over(inside)).join(starts, "__part").select(
        *df.columns, (F.col("__before") + F.col("__pos")).alias(out))


def mixed_key(column: Column | str) -> Column:
    """Shuffle key in [0, 2**31 - 1) computed with plain integer arithmetic.

    A multiplication modulo the prime 2147483647 is one-to-one on the residues, so
    any SQL engine gets the same order; ties need the id as a second sort key.
    """
    col = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.pmod(col.cast("long"), F.lit(2147483647)) * F.lit(1103515245), F.lit(2147483647))


def hashed_key(column: Column | str, seed: int) -> Column:
    """Seeded shuffle key in [0, 2**31) from ``xxhash64``."""
    col = F.col(column) if isinstance(column, str) else column
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), col), 33)


def key_bucket(key: Column, bits: int = 14) -> Column:
    """Top ``bits`` bits of a 31-bit shuffle key: an even cut of every group."""
    return F.shiftright(key, 31 - bits)


def id_bucket(column: Column | str, bits: int = 20) -> Column:
    """Bucket of at most ``2**bits`` distinct ids, in id order."""
    col = F.col(column) if isinstance(column, str) else column
    return F.shiftright(col.cast("long"), bits)


def number_bucket(column: Column | str) -> Column:
    """Bucket of a real number: eighths within +-2**14, logarithmic beyond.

    However far the values spread, there are a few hundred thousand buckets at most.
    """
    col = F.col(column) if isinstance(column, str) else column
    edge = 2.0 ** 14
    far = F.lit(int(edge) * 8) + F.floor(F.log2(F.greatest(F.abs(col), F.lit(edge)) / edge) * 256)
    return F.when(F.abs(col) < edge, F.floor(col * 8)).when(col > 0, far).otherwise(-far - 1)
