"""Splits with exact sizes that never gather a group in one task.

All orders are shuffle keys of the row id, so the same rows fall into the same
split whatever the partitioning.  The row ids must be unique.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ordering import hashed_key, key_bucket, numbered_in_order, row_numbers, running_totals
from tallyforge.session import known_size, materialize


def _positions(df: DataFrame, keys: list[str], row_id: str, key: Column | None, seed: int, totals: bool) -> DataFrame:
    keyed = df.withColumn("__key", key if key is not None else hashed_key(row_id, seed))
    return row_numbers(keyed, keys, ["__key", row_id], key_bucket(F.col("__key")), "__pos", totals).drop("__key")


def kfold_split(df: DataFrame, row_id: str, k: int = 5, seed: int = 42, key: Column | None = None) -> DataFrame:
    """Add ``fold``: each row is tested in exactly one fold, fold sizes differ by at most one."""
    placed = _positions(df, [], row_id, key, seed, False)
    return placed.withColumn("fold", (F.col("__pos") - 1) % k).drop("__pos")


def stratified_kfold(df: DataFrame, row_id: str, by: str, k: int = 5, seed: int = 42,
                     key: Column | None = None) -> DataFrame:
    """Add ``fold`` such that every class is spread evenly, up to one row, over the folds."""
    placed = _positions(df, [by], row_id, key, seed, False)
    return placed.withColumn("fold", (F.col("__pos") - 1) % k).drop("__pos")


def fold_roles(folded: DataFrame, k: int) -> DataFrame:
    """One row per (row, fold) with role train or test, the form split files are written in."""
    roles = folded.withColumnRenamed("fold", "__own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return roles.withColumn("role", F.when(F.col("fold") == F.col("__own"), "test").otherwise("train")).drop("__own")


def random_split(df: DataFrame, row_id: str, eval_size: float = 0.4, seed: int = 42,
                 key: Column | None = None) -> DataFrame:
    """Add ``split``: train, and the held-out share halved into validation and test.

    Held-out sizes are rounded up, as is the test half.
    """
    placed = _positions(df, [], row_id, key, seed, True)
    share = Fraction(str(eval_size))
    total = F.col("__pos_total")
    held = F.floor((total * share.numerator + share.denominator - 1) / share.denominator)
    train = total - held
    validation = train + F.floor(held / 2)
    split = (F.when(F.col("__pos") <= train, "train")
             .when(F.col("__pos") <= validation, "validation").otherwise("test"))
    return placed.withColumn("split", split).drop("__pos", "__pos_total")


def label_code(label: Column) -> Column:
    """60-bit number of a label from its MD5, the same in every engine."""
    return F.conv(F.substr(F.md5(label), F.lit(1), F.lit(15)), 16, 10).cast("long")


def multilabel_split(pairs: DataFrame, eval_size: float = 0.4, seed: int = 58, task: str = "task_id",
                     label: str = "label", key: Column | None = None) -> DataFrame:
    """Split tasks so that every label has its share in train, validation and test, to the row where that can be.

    Each label has quotas, how many of its tasks are held out and how many of these are test.  Labels
    get their turn from the rarest to the most frequent.  A turn settles the tasks that have the label and none before it:
    what the label's quotas still lack after earlier turns is taken from them at even steps, along their label sets
    and shuffle keys, so that all other labels are divided in proportion as well.  At least one task of a label
    stays in training.

    Tasks of one label set are settled by counts: a turn is one job over the label sets of its group, and one row of
    figures per label is all that comes to the driver.  Tasks get their place from ranks at the end.
    """
    distinct = pairs.select(task, label).filter(F.col(task).isNotNull() & F.col(label).isNotNull()).distinct()
    sizes = distinct.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    ranked = known_size(numbered_in_order(sizes, ["__size", label], "__rank").select(
        label, "__size", "__rank", label_code(F.col(label)).alias("__code")), "label-ranks")
    # Written once: several readers follow.
    tasks = materialize(distinct.join(ranked, label).groupBy(task).agg(
        F.min("__rank").alias("__rarest"), F.bit_xor("__code").alias("__set"), F.collect_list("__rank").alias("__labels")), "multilabel")
    in_group = ["__rarest", "__set"]
    sets = tasks.groupBy(*in_group).agg(F.count(F.lit(1)).alias("__n"), F.first("__labels").alias("__labels"))
    upto = running_totals(sets, ["__rarest"], ["__set"], F.shiftright("__set", 40), {"__upto": F.col("__n")}, totals=True)
    placed = materialize(upto.withColumn("__start", F.col("__upto") - F.col("__n")), "label-sets")

    share = Fraction(str(eval_size))
    labels = ranked.select("__rank", "__size").orderBy("__rank").collect()  # one row per label
    held, test = {r["__rank"]: 0 for r in labels}, {r["__rank"]: 0 for r in labels}
    groups = {r["__rarest"]: r["n"] for r in placed.groupBy("__rarest").agg(F.max("__upto").alias("n")).collect()}
    quotas = []
    for row in labels:
        rank, size = row["__rank"], row["__size"]
        if rank not in groups:
            continue
        wanted = min(int(size * share + Fraction(1, 2)), size - 1)
        hold = min(max(wanted - held[rank], 0), groups[rank])
        tests = min(max(wanted // 2 - test[rank], 0), hold)
        quotas.append((rank, groups[rank], hold, tests))
        if hold:
            own = placed.filter(F.col("__rarest") == rank)
            taken = [_taken_upto(F.col(c), groups[rank], hold, tests) for c in ("__upto", "__start")]
            counts = own.select(F.explode("__labels").alias("l"), (taken[0][0] - taken[1][0]).alias("h"), (taken[0][1] - taken[1][1]).alias("t"))
            for r in counts.groupBy("l").agg(F.sum("h").alias("h"), F.sum("t").alias("t")).collect():
                held[r["l"]] += r["h"]
                test[r["l"]] += r["t"]
    table = known_size(tasks.sparkSession.createDataFrame(quotas, "__rarest long, __of long, __hold long, __tests long"), "label-quotas")
    keyed = tasks.drop("__labels").withColumn("__key", key if key is not None else hashed_key(task, seed))
    numbered = row_numbers(keyed, in_group, ["__key", task], key_bucket(F.col("__key")), "__pos")
    numbered = numbered.join(placed.select(*in_group, "__start"), in_group).join(table, "__rarest")
    position = F.col("__start") + F.col("__pos")
    now, before = (_taken_upto(p, F.col("__of"), F.col("__hold"), F.col("__tests")) for p in (position, position - 1))
    split = F.when(now[0] == before[0], "train").when(now[1] == before[1], "validation").otherwise("test")
    return numbered.select(task, split.alias("split"))


def _taken_upto(position: Column, of: int | Column, hold: int | Column, tests: int | Column) -> tuple[Column, Column]:
    """How many of the first ``position`` tasks of a group are held out, and how many of these are test."""
    of, hold, tests = (F.lit(x) if isinstance(x, int) else x for x in (of, hold, tests))
    held = F.floor(position * hold / of)
    return held, F.floor(held * tests / F.greatest(hold, F.lit(1)))
