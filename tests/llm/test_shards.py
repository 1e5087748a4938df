import random
import zlib

from pyspark.sql import functions as F

from tallyforge.llm import shards


def rows_of(n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(i, "x" * int(rng.paretovariate(1.1) * 20)) for i in range(n)]
    return rows + [(7, None), (None, "no id"), (None, "no id"), (8, "é" * 9), (8, "é" * 9), (9_999, "y" * 50_000)]


def test_places_sizes_and_balance(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 3, "z") for r in rows], "doc_id long, text string, size int, shard string")
    found = shards.assign(docs).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in found) == sorted(
        str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in rows)
    held, places = {}, {}
    for r in found:
        held[r.shard] = held.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.virtual_slot < shards.SLOTS
    assert sorted(held) == list(range(8))
    assert max(held.values()) - min(held.values()) <= 0.02 * sum(held.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    again = {(r.doc_id, r.text_crc32, r.shard) for r in shards.assign(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard) for r in found}


def test_map_is_edited_by_version(spark):
    maps = shards.SlotMaps(spark)
    maps.write(1, shards.first_map(spark, 64, 4))
    sizes = spark.range(64).select(F.col("id").cast("int").alias("vslot"), (F.col("id") * F.col("id")).alias("bytes"), F.lit(1).cast("long").alias("rows"))
    maps.write(2, shards.rebalanced(maps.read(1), sizes, 4))
    maps.write(3, shards.grown(maps.read(2), sizes, 4))
    versions = [{r.vslot: r.shard for r in maps.read(v).collect()} for v in (1, 2, 3)]
    assert all(sorted(v) == list(range(64)) for v in versions)
    loads = [[sum(i * i for i, s in v.items() if s == k) for k in range(5)] for v in versions]
    assert max(loads[1][:4]) - min(loads[1][:4]) < max(loads[0][:4]) - min(loads[0][:4])
    assert max(loads[1][:4]) <= sum(loads[1]) / 4 + 63 * 63
    moved = [i for i in range(64) if versions[1][i] != versions[2][i]]
    assert moved and {versions[2][i] for i in moved} == {4}
    assert 0.5 * sum(loads[2]) / 5 < loads[2][4] <= sum(loads[2]) / 5


def test_shards_may_shrink(spark):
    sizes = spark.range(64).select(F.col("id").cast("int").alias("vslot"), F.lit(5).cast("long").alias("bytes"))
    fewer = [r.shard for r in shards.rebalanced(shards.first_map(spark, 64, 8), sizes, 3).collect()]
    assert set(fewer) == {0, 1, 2} and max(map(fewer.count, range(3))) - min(map(fewer.count, range(3))) <= 1


def test_empty_table(spark):
    assert shards.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []
