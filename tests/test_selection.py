"""Coverage selection, nearest neighbours and projection against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import neighbours
from tallyforge.operators import selection as X
from tallyforge.operators.ordering import mixed_key


def _greedy(sets, k):
    order = lambda t: ((t % 2147483647) * 1103515245 % 2147483647, t)
    covered, chosen, left = set(), [], dict(sets)
    while len(chosen) < k and left:
        best = min(left, key=lambda t: (-len(left[t] - covered), order(t)))
        gain = len(left[best] - covered)
        if gain <= 0:
            break
        chosen.append((best, gain))
        covered |= left.pop(best)
    chosen += [(t, 0) for t in sorted(left, key=order)[: k - len(chosen)]]
    return chosen


@pytest.mark.parametrize("labels,k,front", [(30, 5, 10_000), (4, 6, 10_000), (30, 12, 3), (12, 9, 1), (4, 90, 2)])
def test_coverage_is_greedy_and_then_fills(spark, labels, k, front):
    rng = random.Random(labels)
    sets = {t: {f"L{rng.randrange(labels)}" for _ in range(rng.randrange(1, 6))} for t in range(80)}
    rows = [(t, name) for t, names in sets.items() for name in names] * 2
    got = X.coverage_select(spark.createDataFrame(rows, "task_id long, label string"), k, key=mixed_key, front=front)
    assert [(r.task_id, r.gain) for r in got.orderBy("rank").collect()] == _greedy(sets, k)


def test_coverage_of_nothing(spark):
    assert X.coverage_select(spark.createDataFrame([], "task_id long, label string"), 3).collect() == []


def _brute_knn(queries, pool, k, exclude):
    out = {}
    for q, v in queries.items():
        near = sorted((round(float(np.linalg.norm(v - w)), 6), i) for i, w in pool.items() if not (exclude and i == q))
        out[q] = near[:k]
    return out


@pytest.mark.parametrize("block_rows,exclude", [(16384, True), (40, True), (64, False)])
def test_knn_is_exact_for_any_blocking(spark, block_rows, exclude):
    rng = np.random.default_rng(3)
    points = {i: rng.integers(-3, 4, 6).astype("float64") for i in range(300)}   # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "id long, vector array<double>")
    got = X.knn_topk(df, df, 7, exclude, block_rows).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
    assert found == _brute_knn(points, points, 7, exclude)


def test_knn_with_fewer_points_than_asked(spark):
    pool = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    got = X.knn_topk(pool, pool, 5, exclude_self=True).collect()
    assert {(r.query_id, r.neighbor_id) for r in got} == {(1, 2), (2, 1)}


def test_knn_with_its_own_number_for_each_query(spark):
    rng = np.random.default_rng(5)
    points = {i: rng.normal(size=4) for i in range(200)}
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in points.items()], "id long, vector array<double>, k int")
    found = {}
    for r in X.knn_topk(df, df.drop("k"), 3, True, 50, 20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    want = _brute_knn(points, points, 3, True)
    assert {q: [(d, i) for _, d, i in sorted(n)] for q, n in found.items()} == {q: n[:min(3, q % 5)] for q, n in want.items() if q % 5}


def test_knn_of_empty_sides(spark):
    some = spark.createDataFrame([(1, [0.0, 1.0])], "id long, vector array<double>")
    assert X.knn_topk(some, some.limit(0), 2).collect() == [] == X.knn_topk(some.limit(0), some, 2).collect()


def test_clouds_meet_few_blocks(spark, monkeypatch):
    """Exact in clouds too, where a query meets under 30 % of the blocks."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    points = {i: centres[i % 40] + rng.normal(size=16) * 0.1 for i in range(1200)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "id long, vector array<double>")
    index = neighbours.cell_index(df, 200, 60)
    met = []
    plain = neighbours._met
    monkeypatch.setattr(neighbours, "_met", lambda index, asked, *more: met.append(asked.count()) or plain(index, asked, *more))
    got = neighbours.search(index, df, 4, True).collect()
    blocks = index.rows.select("block").distinct().count()
    assert blocks > 15 and sum(met) < 0.3 * blocks * len(points)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
    assert found == _brute_knn(points, points, 4, True)


def test_similarity_select_carries_example_columns(spark):
    pool = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [5.0, 0.0], "b")], "id long, vector array<double>, task string")
    got = X.similarity_select(pool.select("id", "vector"), pool, 1).collect()
    assert {(r.query_id, r.task) for r in got} == {(1, "a"), (2, "b")}


def test_pca_equals_the_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "id long, vector array<double>")
    got = np.array([[r.pc1, r.pc2] for r in X.pca_2d(df).orderBy("id").collect()])
    centred = data - data.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov(centred.T))
    want = centred @ vectors[:, ::-1][:, :2]
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_pca_needs_two_dimensions(spark):
    with pytest.raises(ValueError, match="two dimensions"):
        X.pca_2d(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"))


def test_hashing_embedding_is_unit_length_and_repeats(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, "gamma")], "id int, content string")
    got = {r.id: r.vector for r in X.build_chunk_index(df).collect()}
    assert got[1] == got[2] != got[3]
    assert all(abs(sum(v * v for v in vec) - 1) < 1e-5 for vec in got.values())


def test_index_takes_any_embedding(spark):
    df = spark.createDataFrame([(1, "abc")], "id int, content string")
    got = X.build_chunk_index(df, embed=lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))).first()
    assert got.vector == [3.0, 1.0]


def test_stacked_datasets_keep_their_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, extra string")
    stacked = X.stack_datasets({"one": a, "two": a.drop("extra")}).collect()
    assert [(r.dataset, r.extra) for r in stacked] == [("one", "x"), ("two", None)]


def test_a_worker_holds_few_distances_and_queries_are_written_once(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from tallyforge.operators import neighbours as N

    sizes, nearest = [], N._nearest
    monkeypatch.setattr(N, "_nearest", lambda ids, asked, most, pool, points, own: sizes.append(len(asked) * len(points)) or nearest(ids, asked, most, pool, points, own))
    n = 6000
    rows = pa.table({"block": [0] * n, "chunk": [0] * n, "kind": [0] * 5000 + [1] * 1000, "id": range(n), "vector": [[i * 0.5, i % 7] for i in range(n)], "k": [3] * n})
    found = sum(b.num_rows for b in N._meet(True)(iter(rows.to_batches())))
    assert found == 3000 and max(sizes) <= 1 << 20

    written = []
    kept = N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, tag: written.append((tag, df.count())) or kept(df, tag))
    points = spark.range(1500).selectExpr("id", "array(double(id * 37 % 1009), double(id * 11 % 503)) AS vector")
    assert N.knn_topk(points, points, 2, exclude_self=True, block_rows=64, cells=32).count() == 3000
    assert all(count <= 1500 for tag, count in written if tag not in ("near", "far"))


def _spied(monkeypatch):
    written, kept = {}, neighbours.materialize

    def spy(df, tag):
        written[tag] = kept(df, tag)
        return written[tag]

    monkeypatch.setattr(neighbours, "materialize", spy)
    return written


def test_further_blocks_give_a_query_no_more_than_it_asks_for(spark, monkeypatch):
    """Bounds fall from block to block, so that no block gives its own nearest ones (39,275 rows before)."""
    rng = np.random.default_rng(8)
    points = {i: rng.normal(size=12) for i in range(900)}
    df = spark.createDataFrame([(i, v.tolist(), 1 + i % 4) for i, v in points.items()], "id long, vector array<double>, k int")
    written = _spied(monkeypatch)
    found = {}
    for r in neighbours.search(neighbours.cell_index(df, 40, 64), df, 4, True).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
    assert found == {q: n[:1 + q % 4] for q, n in _brute_knn(points, points, 4, True).items()}
    assert 0 < written["far"].count() <= sum(1 + i % 4 for i in points)


def test_in_clouds_few_further_blocks_are_asked(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    df = spark.createDataFrame([(i, (centres[i % 40] + rng.normal(size=16) * 0.1).tolist()) for i in range(1200)], "id long, vector array<double>")
    index, written = neighbours.cell_index(df, 200, 60), _spied(monkeypatch)
    neighbours.search(index, df, 4, True).collect()
    asked = sum(bin(byte).count("1") for r in written["far-queries"].collect() for byte in r.blocks)
    assert asked < 0.3 * index.rows.select("block").distinct().count() * 1200


@pytest.mark.parametrize("scale,offset", [(1.0, 0.0), (1e-3, 1e3), (1e20, 0.0), (1e-3, 1e18), (1e-12, 0.0)])
def test_knn_is_exact_where_single_precision_is_not(spark, scale, offset):
    rng = np.random.default_rng(9)
    points = {i: rng.normal(size=5) * scale + offset for i in range(400)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "id long, vector array<double>")
    found = {}
    for r in X.knn_topk(df, df, 6, True, 64).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append(r.neighbor_id)
    want = {q: sorted((round(float(np.sqrt(((v - w) ** 2).sum())), 6), i) for i, w in points.items() if i != q)[:6] for q, v in points.items()}
    assert found == {q: [i for _, i in n] for q, n in want.items()}


def test_single_precision_vectors_stay_so_and_meet_doubles(spark):
    rng = np.random.default_rng(10)
    points = {i: rng.normal(size=7).astype(np.float32).astype(float) for i in range(300)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "id long, vector array<float>")
    assert neighbours.cell_index(df, 20, 64).rows.schema["vector"].dataType.simpleString() == "array<float>"
    for queries in (df, df.withColumn("vector", F.col("vector").cast("array<double>"))):
        found = {}
        for r in X.knn_topk(queries, df, 3, True, 64).orderBy("rank").collect():
            found.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
        assert found == _brute_knn(points, points, 3, True)


def test_points_pass_by_groups_a_few_distances_at_a_time(monkeypatch):
    import pyarrow as pa

    rng, n, q = np.random.default_rng(11), 5000, 1500
    vectors, sizes, compare = rng.normal(size=(q + n, 6)), [], neighbours._Group._compare
    monkeypatch.setattr(neighbours._Group, "_compare", lambda self, asking, ids, points: sizes.append(len(asking) * len(ids)) or compare(self, asking, ids, points))
    rows = pa.table({"group": [3] * (q + n), "kind": [0] * q + [1] * n, "block": [0] * q + [1] * 2500 + [2] * 2500, "id": range(q + n), "vector": vectors.tolist(),
                     "k": [4] * q + [0] * n, "bound": [9.0] * q + [0.0] * n, "blocks": pa.array([b"\x60"] * q + [None] * n, pa.binary())})
    found = {}
    for batch in neighbours._pass_by(True)(iter(rows.to_batches(max_chunksize=700))):
        for query, near, distance in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found.setdefault(query, []).append((distance, near))
    want = {i: sorted((float(d), q + j) for j, d in enumerate(np.round(np.sqrt(((vectors[i] - vectors[q:]) ** 2).sum(axis=1)), 6)))[:4] for i in range(q)}
    assert found == want and max(sizes) <= 1 << 20


@pytest.mark.parametrize("most", [3, 40, 10 ** 12])
def test_neighbours_in_order(most):
    rng = np.random.default_rng(12)
    query, neighbour = rng.integers(0, 9, 500), rng.integers(0, 99, 500)
    distance = np.round(rng.integers(0, most, 500) * 0.37, 6)
    order = neighbours._order(query, distance, neighbour)
    assert (np.column_stack([x[order] for x in (query, distance, neighbour)]) == sorted(zip(query, distance, neighbour, strict=True))).all()
    assert len(neighbours._order(query[:0], distance[:0], neighbour[:0])) == 0


def test_knn_of_repeated_vectors_holds_few_pairs_at_once(spark):
    import tracemalloc

    rng = np.random.default_rng(13)
    points = {i: np.full(4, 0.5) if i % 2 else rng.normal(size=4) for i in range(700)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "id long, vector array<double>")
    found = {}
    for r in X.knn_topk(df, df, 5, True, 64).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
    assert found == _brute_knn(points, points, 5, True)

    one, many = np.ones((1, 64)), np.zeros(400_000, dtype=np.int64)
    tracemalloc.start()
    assert not neighbours._exact(one, many, one, many).any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6   # 410 MB if all are fetched
