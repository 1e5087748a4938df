"""Split properties: cover, disjointness, exact sizes, proportions under skew, stability."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import samples as M
from tallyforge.operators import splits as P


@pytest.fixture(scope="module")
def rows(spark):
    lang = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("l"), (F.col("id") % 7).cast("string")))
    return spark.range(0, 5003, numPartitions=6).withColumn("lang", lang)


def test_kfold_covers_once_with_even_sizes(rows):
    sizes = [r["count"] for r in P.kfold_split(rows, "id", 5).groupBy("fold").count().collect()]
    assert sum(sizes) == 5003 and len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_kfold_does_not_depend_on_partitioning(rows):
    a = {r.id: r.fold for r in P.kfold_split(rows, "id", 3).collect()}
    b = {r.id: r.fold for r in P.kfold_split(rows.repartition(11, "lang"), "id", 3).collect()}
    assert a == b
    assert a != {r.id: r.fold for r in P.kfold_split(rows, "id", 3, seed=7).collect()}


def test_fold_roles(rows):
    roles = P.fold_roles(P.kfold_split(rows, "id", 3), 3)
    assert roles.count() == 3 * 5003
    assert roles.filter("role = 'test'").select("id").distinct().count() == 5003


def test_stratified_kfold_keeps_classes_even(rows):
    counts = P.stratified_kfold(rows, "id", "lang", 4).groupBy("lang", "fold").count().groupBy("lang").agg(
        F.max("count").alias("hi"), F.min("count").alias("lo"), F.count("*").alias("folds")).collect()
    assert all(r.hi - r.lo <= 1 and r.folds == 4 for r in counts) and None in {r.lang for r in counts}


def test_random_split_sizes(rows):
    got = {r.split: r["count"] for r in P.random_split(rows, "id", 0.4).groupBy("split").count().collect()}
    assert got == {"train": 5003 - 2002, "validation": 1001, "test": 1001}


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(2)
    rows = []
    for task in range(6000):
        labels = {"hot"} if task % 3 == 0 else set()
        labels |= {f"L{min(int(rng.expovariate(0.4)), 20)}" for _ in range(rng.randrange(1, 5))}
        rows += [(task, name) for name in labels]
    return spark.createDataFrame(rows, "task_id long, label string").repartition(5)


def test_multilabel_split_keeps_every_label_in_proportion(spark, pairs):
    split = P.multilabel_split(pairs, 0.4).cache()
    assert split.count() == pairs.select("task_id").distinct().count() == split.select("task_id").distinct().count()
    shares = pairs.join(split, "task_id").groupBy("label").agg(
        F.count("*").alias("n"), *[F.avg((F.col("split") == s).cast("int")).alias(s) for s in ("train", "validation", "test")]).collect()
    for r in shares:
        slack = 0.02 + 1.5 / r.n ** 0.5 / 2
        assert abs(r.train - 0.6) < slack and abs(r.validation - 0.2) < slack and abs(r.test - 0.2) < slack, r


def brute_quotas(labels_of, share=0.4):
    """Counts of each label in (held out, test): one turn per label, rarest first, over tasks that no turn settled yet."""
    sizes = {}
    for names in labels_of.values():
        for name in names:
            sizes[name] = sizes.get(name, 0) + 1
    return {name: min(int(n * share + 0.5), n - 1) for name, n in sizes.items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_multilabel_split_meets_every_quota(spark, seed):
    rng = random.Random(seed)
    labels_of = {t: {f"L{min(int(rng.expovariate(0.35)), 12)}" for _ in range(rng.randrange(1, 4))} for t in range(900)}
    labels_of |= {2000 + t: {f"only{t % 3}"} for t in range(7)}
    df = spark.createDataFrame([(t, n) for t, names in labels_of.items() for n in names] * 2 + [(None, "L1"), (5, None)], "task_id long, label string")
    split = {r.task_id: r.split for r in P.multilabel_split(df.repartition(4), 0.4).collect()}
    assert set(split) == set(labels_of)
    for name, wanted in brute_quotas(labels_of).items():
        held = [t for t, names in labels_of.items() if name in names and split[t] != "train"]
        assert abs(len(held) - wanted) <= 1 and abs(sum(split[t] == "test" for t in held) - wanted // 2) <= 1, name


def test_multilabel_split_of_nothing(spark):
    assert P.multilabel_split(spark.createDataFrame([], "task_id long, label string")).collect() == []


def test_rare_labels_are_never_missing_from_training(pairs):
    split = P.multilabel_split(pairs, 0.4)
    labelled = pairs.join(split, "task_id")
    assert M.unseen_labels(labelled).isEmpty()


def test_label_matrix_forms_agree(pairs):
    names = sorted(r.label for r in pairs.select("label").distinct().collect())
    assert names == sorted(names)
    wide = M.label_matrix(pairs, names)
    ones = {(r.task_id, r.label) for r in M.label_matrix_entries(pairs).collect()}
    sums = {r.task_id: sum(r[n] for n in names) for r in wide.collect()}
    assert sum(sums.values()) == len(ones) == pairs.distinct().count()
    columns = {r.label: r.column for r in M.label_matrix_entries(pairs).select("label", "column").distinct().collect()}
    assert columns == {n: i for i, n in enumerate(names)}


def test_label_distribution_fills_zeros(spark):
    rows = [("train", "root.std.A"), ("train", "A"), ("test", "B")]
    got = {r.label: (r.train, r.test) for r in M.label_distribution(
        spark.createDataFrame(rows, "split string, label string"), ["train", "test"]).collect()}
    assert got == {"A": (2, 0), "B": (0, 1)}


def test_lookup_takes_the_first_entry(spark):
    catalog = spark.createDataFrame([("A", "second", 2), ("A", "first", 1)], "function_name string, doc string, pos int")
    predicted = spark.createDataFrame([(" A\n",), ("B",)], "node string")
    got = {r.node: r.doc for r in M.lookup_node_doc(predicted, catalog, "pos").collect()}
    assert got == {" A\n": "first", "B": "No doc"}


def test_label_matrix_keeps_bits_per_group(spark):
    """A group is a number for every 62 labels, not one for each label."""
    names = [f"N{i}" for i in range(130)]
    rows = [(t, f"N{(t * 37 + j * j) % 140}") for t in range(20) for j in range(9)] + [(None, "N61"), (None, "N62"), (50, None), (51, "other"), (3, "N129"), (3, "N129")]
    wide = M.label_matrix(spark.createDataFrame(rows, "task_id long, label string"), names)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_or(") == 3 and "pivot" not in plan.lower()
    have = {(t, x) for t, x in rows}
    assert wide.columns == ["task_id", *names] and {t for _, t in wide.dtypes[1:]} == {"int"}
    got = {r[0]: list(r[1:]) for r in wide.collect()}
    assert got == {t: [int((t, n) in have) for n in names] for t in {t for t, _ in rows}}
