import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import covertree

SCHEMA = "vec_id long, embedding array<double>, label int, class string, n int, v string"


def brute(rows, cosine):
    """(id, links, smallest id reachable, kept) of every row."""
    able = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    near = {i: set() for i in range(len(rows))}
    for dims in {len(v) for (_, v), ok in zip(rows, able, strict=True) if ok}:
        at = np.array([i for i, ((_, v), ok) in enumerate(zip(rows, able, strict=True)) if ok and len(v) == dims])
        x = np.array([rows[i][1] for i in at], dtype=np.float64)
        x /= np.abs(x).max(axis=1)[:, None]
        norms = np.sqrt((x * x).sum(axis=1))
        hit = x @ x.T / np.outer(norms, norms) >= cosine
        for k, i in enumerate(at):
            near[int(i)] = set(at[hit[k]].tolist()) - {int(i)}
    component, seen = {}, set()
    for start in near:
        if start in seen:
            continue
        group, queue = {start}, [start]
        while queue:
            fresh = near[queue.pop()] - group
            group |= fresh
            queue += fresh
        seen |= group
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        component |= {i: min(ids, default=None) for i in group}
    return sorted(str((d, len(near[i]), component[i], d is not None and d == component[i])) for i, (d, _) in enumerate(rows))


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], SCHEMA)
    out = covertree.similar_vectors(df.repartition(5), **more)
    return sorted(str(tuple(r)) for r in out.collect())


def mixed(seed, dims):
    """Random vectors, tight crowds, chains and clouds whose cosines lie around the threshold."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(150, dims))]
    centre = rng.normal(size=dims)
    parts.append(centre + rng.normal(size=(200, dims)) * 0.002)
    for spread in (0.1, 0.2, 0.3):
        parts.append(rng.normal(size=dims) + rng.normal(size=(80, dims)) * spread)
    a, b = rng.normal(size=(2, dims))
    parts.append(np.array([a * np.cos(t) + b * np.sin(t) for t in np.linspace(0, 1.5, 40)]))
    vectors = np.concatenate(parts) * rng.uniform(0.01, 100, size=(590 + 40, 1))[:sum(map(len, parts))]
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]


ODD = [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None] * 3), (904, [float("nan")] * 6), (905, [float("inf"), 1.0] * 3), (906, [-0.0] * 6),
       (907, [1.0, 2.0]), (908, [2.0, 4.0]), (909, [1e300] * 6), (910, [1e-300] * 6), (911, [1.0] * 6), (None, [1.0] * 6), (911, [1.0] * 6),
       (None, None), (912, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (913, [0.0, 1.0, -0.0, 0.0, 0.0, 0.0]), (914, [-0.0, 5.0, 0.0, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("piece_rows,top_rows", [(8192, 2048), (40, 30)])
def test_against_brute_force(spark, piece_rows, top_rows):
    rows = mixed(1, 6) + ODD
    assert found(spark, rows, piece_rows=piece_rows, top_rows=top_rows) == brute(rows, 0.95)


def test_another_threshold(spark):
    rows = mixed(2, 12)
    assert found(spark, rows, cosine=0.8, piece_rows=100, top_rows=50) == brute(rows, 0.8)


def test_levels_nest_and_cover():
    rng = np.random.default_rng(3)
    u = covertree.unit(np.concatenate([rng.normal(size=(300, 5)), 1 + rng.normal(size=(300, 5)) * 0.05]))
    tree = covertree.CoverTree.grow(u, covertree.RADII)
    for k, radius in enumerate(covertree.RADII):
        gaps = np.linalg.norm(u - u[tree.centres[k][tree.owner[k]]], axis=1)
        assert gaps.max() <= radius + 1e-7 and (tree.radius[k] >= np.array([gaps[tree.owner[k] == c].max() for c in range(len(tree.centres[k]))]) - 1e-12).all()
        if k:
            assert set(tree.centres[k - 1]) <= set(tree.centres[k])
            assert all(len(np.unique(tree.owner[k - 1][tree.owner[k] == c])) == 1 for c in range(len(tree.centres[k])))
    assert len(tree.centres[0]) < len(tree.centres[-1]) < len(u)


def test_traversal_opens_few_nodes(monkeypatch):
    """Far apart clouds: the levels rule out nearly all pairs before vectors are compared."""
    rng = np.random.default_rng(4)
    clouds = np.concatenate([rng.normal(size=40) + rng.normal(size=(60, 40)) * 0.02 for _ in range(50)])
    tree = covertree.CoverTree.grow(covertree.unit(clouds), covertree.RADII)
    compared = []
    plain = covertree.distances
    monkeypatch.setattr(covertree, "distances", lambda a, b: compared.append(len(a) * len(b)) or plain(a, b))
    zero = np.zeros(len(clouds))
    pairs = sum(len(i) for i, _, _ in covertree.node_pairs(tree, zero, tree, zero, covertree.reach_of(0.95)))
    assert pairs == 50 * 60 * 60 and sum(compared) < 0.25 * len(clouds) ** 2


def test_crowd_meets_as_nodes(spark):
    """Thousands of near copies in many pieces cost a node a piece, not their pairs."""
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.001).tolist()) for i in range(3000)]
    out = covertree.similar_vectors(spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], SCHEMA), piece_rows=100)
    assert {(r.n_links, r.component_id) for r in out.collect()} == {(2999, 0)}


def test_cosine_too_high_for_the_nodes(spark):
    with pytest.raises(ValueError):
        found(spark, [(1, [1.0])], cosine=0.999)


def test_empty_table_and_no_vector(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.0])]) == brute([(1, None), (2, [0.0])], 0.95)


def test_visitors_of_a_piece_stream_by(monkeypatch):
    """A task holds its piece and a bounded number of visitors, however many come."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 8))
    v[1000:1040] = v[:40] + 1e-3
    v[2000:2020] = v[1000:1020] + 1e-3
    home = np.arange(3000) < 60
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.full(3000, 8, np.int32)), pa.array(np.zeros(3000, np.int32)), pa.array(home), pa.array(np.arange(3000)), pa.array(np.zeros(3000)),
         pa.array(np.ones(3000, np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), 8).cast(pa.list_(pa.float64()))],
        ["dims", "piece", "home", "node", "radius", "n", "v"])
    held, plain = [], covertree.unit
    monkeypatch.setattr(covertree, "unit", lambda x: held.append(len(x)) or plain(x))
    out = pa.Table.from_batches(covertree._traverse(covertree.reach_of(0.95), 0.95, visitor_rows=100)(iter([rows]))).to_pydict()
    links = np.zeros(3000, dtype=np.int64)
    for kind, a, b in zip(out["kind"], out["a"], out["b"], strict=True):
        assert kind < 2
        if kind == 0:
            links[a] += b
    u = plain(v)
    near = (u @ u.T >= 0.95) & ~np.eye(3000, dtype=bool) & (home[:, None] | home[None, :])
    assert links.tolist() == near.sum(axis=1).tolist() and links.sum() >= 120
    assert max(held) <= 100 and sum(held) == 3000
