import hashlib
import random

from pyspark.sql import functions as F

from tallyforge.llm import mixing


def brute(rows, weights=(5, 2, 1), most=3):
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # share again until none is above
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return sizes, target, order
        capped |= over


def rows_of():
    rng = random.Random(6)
    rows = [(i, rng.choice(["b", "a", "ä", "Z", None, "tiny", "big", "big", "big"]), " ".join("w" * rng.randint(0, 40))) for i in range(500)]
    rows = [(i, s, t[:8] if s == "tiny" else t) for i, s, t in rows]
    return rows + [(None, "a", "some null id"), (None, "a", "some null id"), (3, "b", "twice"), (3, "b", "twice"), (600, "b", None),
                   (601, "none", ""), (602, "a", "long " * 20_000)]


def test_targets_and_taken(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, source string, text string, size int, target string")
    sizes, target, order = brute(rows)
    found = mixing.with_passes(docs).collect()
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        s = r.row.source
        assert r.size == len((r.row.text or "").split()) and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.passes)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    again = sorted(str((r.row, r.passes)) for r in mixing.with_passes(docs.repartition(9)).collect())
    assert again == sorted(str((r.row, r.passes)) for r in found)


def integral(points, t):
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
    held = 0.0
    for (t1, v1), (t2, v2) in zip(points, points[1:], strict=False):
        end = min(max(t, t1), t2)
        held += (end - t1) * (v1 + v1 + (v2 - v1) * (end - t1) / (t2 - t1)) / 2
    return held / total


def test_positions_follow_the_schedules(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    _, target, order = brute(rows)
    by_source = {}
    for r in mixing.with_passes(docs).collect():
        key = hashlib.md5((str(r.row.doc_id) if r.row.doc_id is not None else r.row.text or "").encode()).hexdigest()
        for p in r.passes:
            by_source.setdefault(r.row.source, []).append((p["pass"], key, p.position, p.words))
    for s, passes in by_source.items():
        points = mixing.SCHEDULES[order.index(s) % len(mixing.SCHEDULES)]
        due, held = round(target[s]), 0
        for _, _, position, words in sorted(passes):
            assert abs(integral(points, position) - held / due) < 1e-6
            held += words
    order_ = [r.position for r in mixing.training_order(docs).collect()]
    assert order_ == sorted(order_) and len(order_) == sum(map(len, by_source.values()))


def test_demand_time_is_the_inverse(spark):
    points = ((0.0, 0.0), (0.25, 0.0), (0.5, 3.0), (0.75, 3.0), (1.0, 1.0))
    for share, time in spark.range(101).select((F.col("id") / 100).alias("u"), mixing.demand_time(F.col("id") / 100, points)).collect():
        assert abs(integral(points, time) - share) < 1e-9


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.with_passes(docs).collect() == [] and mixing.training_order(docs).collect() == []
    one = spark.createDataFrame([(1, "a", "")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mixing.with_passes(one).collect()] == [(0.0, 0)]
