"""Layout scores against pair-by-pair brute force, also for crowded programs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import layout as L
from tallyforge.operators import rectangles as R

TYPES = ["in", "out", "instance", "data_instance", "setter", "getter", "waypoint", "strange"]


def _size(kind):
    return L.NODE_SIZES.get(kind, L.OTHER_SIZE)


def _overlap(a, b):
    (wa, ha), (wb, hb) = _size(a[0]), _size(b[0])
    apart_x = a[1] + wa / 2 < b[1] - wb / 2 or a[1] - wa / 2 > b[1] + wb / 2
    apart_y = a[2] + ha / 2 < b[2] - hb / 2 or a[2] - ha / 2 > b[2] + hb / 2
    return not (apart_x or apart_y)


def _brute(nodes):
    ins = [n for n in nodes if n[0] == "in"]
    outs = [n for n in nodes if n[0] == "out"]
    mains = [n for n in nodes if n[0] not in ("in", "out")]
    right = sum(i[1] < m[1] for i in ins for m in mains) + sum(m[1] < o[1] for m in mains for o in outs)
    total = len(ins) * len(mains) + len(mains) * len(outs)
    flow = right / total if total else 1.0
    hits = [any(i != j and _overlap(a, b) for j, b in enumerate(nodes)) for i, a in enumerate(nodes)]
    return right, total, flow, hits, hits.count(False) / len(nodes)


def _program(rng, n, width, step):
    return [(rng.choice(TYPES), rng.randrange(-width, width, step) * 1.0, rng.randrange(-width, width, step) * 1.0) for _ in range(n)]


@pytest.fixture(scope="module")
def programs():
    rng = random.Random(5)
    made = {i: _program(rng, rng.randrange(1, 14), 900, 25) for i in range(60)}
    made[100] = _program(rng, 500, 4000, 1)       # large
    made[101] = _program(rng, 400, 60, 5)         # everything piled up
    made[102] = [("in", 0.0, 0.0), ("out", 100.0, 0.0)]      # touching edges
    made[103] = [("in", 0.0, 0.0), ("out", 100.5, 0.0)]
    made[104] = [("strange", 3.0, 3.0)]
    return made


@pytest.fixture(scope="module")
def nodes(spark, programs):
    rows = [(p, *n) for p, ns in programs.items() for n in ns]
    return spark.createDataFrame(rows, "p long, type string, x double, y double").repartition(6).cache()


def test_flow_pairs(nodes, programs):
    got = {r.p: (r.correct_pairs, r.total_pairs, r.flow_score) for r in L.flow_direction_score(L.flow_pairs(nodes, ["p"])).collect()}
    for p, ns in programs.items():
        right, total, flow, _, _ = _brute(ns)
        assert got[p] == (right, total, pytest.approx(flow))


def test_overlap_flags(nodes, programs):
    got = {(r.p, r.type, r.x, r.y): (r.copies, r.overlapping) for r in L.overlap_flags(nodes, ["p"]).collect()}
    for p, ns in programs.items():
        hits = _brute(ns)[3]
        for n, hit in zip(ns, hits):
            assert got[(p, *n)] == (ns.count(n), hit)
    assert len(got) == sum(len(set(ns)) for ns in programs.values())


def test_layout_score(spark, nodes, programs):
    listed = spark.createDataFrame([(p,) for p in [*programs, 999]], "p long")
    got = {r.p: r.layout_score for r in L.layout_score(nodes, ["p"], listed).collect()}
    for p, ns in programs.items():
        _, _, flow, _, clear = _brute(ns)
        assert got[p] == pytest.approx(0.3 * flow + 0.7 * clear)
    assert got[999] == 0.0


def test_matches_per_node_stay_bounded_in_a_dense_program(spark):
    dense = spark.range(0, 40000).select(
        F.lit(1).alias("p"), F.lit("in").alias("type"), (F.col("id") % 200 * 1.0).alias("x"), (F.col("id") / 200).cast("int").cast("double").alias("y"))
    score = L.overlap_score(dense, ["p"]).first()
    assert (score.nodes, score.overlap_score) == (40000, 0.0)


def test_nodes_at_flow_ignores_candidates_without_score(spark):
    rows = [("r", 1, 0.5), ("r", 1, 1.0), ("r", 1, None), ("r", 2, None), ("r", 3, 0.25), ("s", 1, None)]
    df = spark.createDataFrame(rows, "run string, task_id int, layout_score double")
    got = {r.run: r.nodes_at_flow for r in L.nodes_at_flow(df, ["run"]).collect()}
    assert got == {"r": 0.5, "s": 0.0}


@pytest.mark.parametrize("few", [64, 2])
def test_link_counts_equal_the_pairs(spark, few):
    """Ordinary programs and one crowded one, with copies and touching edges."""
    rng = random.Random(12)
    rows = [(p, rng.choice(["in", "out", "instance", "odd"]), float(rng.randrange(0, w, 5)), float(rng.randrange(0, w, 5)))
            for p, n, w in ((0, 400, 2500), (1, 7, 400), (2, 1, 10), (3, 30, 60), (None, 5, 300)) for _ in range(n)]
    rows += [(4, "in", 0.0, 0.0), (4, "in", 100.0, 50.0), (4, "in", 200.1, 0.0), (4, "in", 0.0, 0.0)]
    want = {}
    for i, (p, *a) in enumerate(rows):
        links = sum(q == p and j != i and _overlap(tuple(a), tuple(b)) for j, (q, *b) in enumerate(rows))
        want[(p, *a)] = (want.get((p, *a), (0,))[0] + 1, links)
    found = L.overlap_links(spark.createDataFrame(rows, "p long, type string, x double, y double").repartition(5), ["p"], few)
    assert {(r.p, r.type, r.x, r.y): (r.copies, r.links) for r in found.collect()} == want
    assert all(r.overlapping == (r.links > 0) for r in found.collect())


@pytest.mark.parametrize(("block_rows", "rows"), [(16, 700), (64, 3000), (1 << 15, 3000)])
def test_link_counts_in_blocks_equal_the_pairs(spark, block_rows, rows):
    """Crowds that fill many blocks, points of equal x or y, and programs that share a block."""
    rng = random.Random(3)
    made = [(p, rng.choice(["in", "out", "instance", "odd"]), float(rng.choice(xs)), float(rng.choice(ys)))
            for p, n, xs, ys in ((0, rows, range(0, 900, 3), range(0, 500, 7)), (1, 90, range(300), range(300)), (None, 90, range(300), [2, 3]),
                                 (2, rows // 4, [5], range(0, 1500)), (3, rows // 4, range(0, 1500), [-5.5])) for _ in range(n)]
    want = {}
    for p in (0, 1, None, 2, 3):
        of = [a for a in made if a[0] == p]
        x, y = (np.array([a[i] for a in of]) for i in (2, 3))
        w, h = (np.array([_size(a[1])[i] for a in of], dtype=float) for i in (0, 1))
        apart = [((x[i] + w[i] / 2 < x - w / 2) | (x[i] - w[i] / 2 > x + w / 2) | (y[i] + h[i] / 2 < y - h / 2) | (y[i] - h[i] / 2 > y + h / 2)) for i in range(len(of))]
        want |= {a: int((~v).sum()) - 1 for a, v in zip(of, apart, strict=True)}
    found = L.overlap_links(spark.createDataFrame(made, "p long, type string, x double, y double").repartition(5), ["p"], block_rows=block_rows)
    assert {(r.p, r.type, r.x, r.y): r.links for r in found.collect()} == want


def test_a_crowd_is_moved_a_few_times_per_node(spark, tmp_path):
    """Digits of ranks made a hundred rows of a node; blocks get it once or twice per node size."""
    n = 20000
    nodes = spark.range(n).select(F.lit(1).alias("p"), F.lit("in").alias("type"), (F.col("id") * 7 % 1000 * 1.0).alias("x"), (F.col("id") * 11 % 503 * 1.0).alias("y"))
    points = nodes.select(F.lit(0).cast("long").alias("g"), F.lit(0).alias("c"), "x", "y", F.lit(1).cast("long").alias("copies")).distinct()
    points.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    sizes = np.array([100.0])
    cuts = R.Cuts("x", sizes, np.zeros(10, dtype=np.int64), np.zeros(10, dtype=np.int64), np.arange(10) * 100.0)
    sent = points.withColumn("part", F.floor(F.col("x") / 100).cast("int")).mapInArrow(R._send(cuts, None, np.ones(10, dtype=np.int64), "part"), R._SCHEMA)
    assert sent.count() <= 3 * n
