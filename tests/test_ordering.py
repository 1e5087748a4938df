"""Bucketed running totals equal plain windows, whatever the group sizes."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ordering as O


def _rows(n=3000, hot=0.4, seed=1):
    rng = random.Random(seed)
    keys = ["hot"] * int(n * hot) + [None if rng.random() < 0.1 else f"k{rng.randrange(40)}" for _ in range(n - int(n * hot))]
    ids = rng.sample(range(10 ** 6), n)
    return [(k, i, rng.randrange(0, 9)) for k, i in zip(keys, ids)]


@pytest.mark.parametrize("bits", [4, 10, 20])
def test_running_total_matches_a_plain_window(spark, bits):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, id long, v long").repartition(7)
    got = O.running_totals(df, ["k"], ["id"], O.id_bucket("id", bits), {"upto": F.col("v")}, True).toPandas()
    want = pd.DataFrame(rows, columns=["k", "id", "v"]).sort_values("id")
    want["upto"] = want.groupby("k", dropna=False)["v"].cumsum()
    want["upto_total"] = want.groupby("k", dropna=False)["v"].transform("sum")
    pd.testing.assert_frame_equal(
        got.sort_values("id").reset_index(drop=True)[["id", "upto", "upto_total"]],
        want.reset_index(drop=True)[["id", "upto", "upto_total"]])


def test_row_numbers_without_keys_are_a_permutation(spark):
    df = spark.range(0, 5000, numPartitions=9)
    out = O.row_numbers(df.withColumn("h", O.hashed_key("id", 3)), [], ["h", "id"], O.key_bucket(F.col("h")), "n")
    assert sorted(r.n for r in out.collect()) == list(range(1, 5001))


@pytest.mark.parametrize("bits", [5, 12, 20])
def test_next_in_order_crosses_buckets(spark, bits):
    rows = _rows(800)
    df = spark.createDataFrame(rows, "k string, id long, v long").repartition(5)
    got = {r.id: r.nxt for r in O.next_in_order(df, ["k"], ["id"], O.id_bucket("id", bits), "v", "nxt").collect()}
    frame = pd.DataFrame(rows, columns=["k", "id", "v"]).sort_values("id")
    frame["nxt"] = frame.groupby("k", dropna=False)["v"].shift(-1)
    assert got == {int(i): (None if pd.isna(n) else int(n)) for i, n in zip(frame["id"], frame["nxt"])}


def test_no_window_task_holds_a_whole_group(spark):
    df = spark.range(0, 100000).withColumn("k", F.lit("only"))
    tagged, group = O.with_group_keys(df, ["k"], O.id_bucket("id", 10))
    largest = tagged.groupBy(*group, "__bucket").count().agg(F.max("count")).first()[0]
    assert largest <= 1024


def test_mixed_key_is_one_to_one_below_the_modulus(spark):
    keys = spark.range(0, 200000).select(O.mixed_key("id").alias("k"))
    assert keys.distinct().count() == 200000
    spread = keys.groupBy(O.key_bucket(F.col("k"), 4).alias("b")).count().agg(F.min("count"), F.max("count")).first()
    assert spread[1] < 1.2 * spread[0]


def test_numbered_in_order_of_texts(spark):
    rng = random.Random(4)
    words = list({"root.std." + "".join(rng.choices("abé", k=rng.randint(0, 6))) for _ in range(300)})
    got = O.numbered_in_order(spark.createDataFrame([(w,) for w in words], "w string").repartition(5), ["w"], "n").collect()
    assert {r.w: r.n for r in got} == {w: i + 1 for i, w in enumerate(sorted(words, key=lambda w: w.encode()))}



def test_number_bucket_follows_the_order(spark):
    values = [-1e300, -1e9, -16385.0, -16384.0, -3.2, -0.01, 0.0, 0.01, 3.1, 16383.9, 16384.0, 17000.0, 1e9, 1e300]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", O.number_bucket("x").alias("b")).orderBy("x").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and rows[0].b < rows[4].b < rows[8].b < rows[-1].b
