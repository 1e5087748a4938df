import itertools
import random
import zlib

import numpy as np

from tallyforge.llm import quality


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 4, 3, 6, 1])
    starts = np.cumsum(lengths) - lengths
    unary, stay = rng.normal(size=lengths.sum()), (0.7, 1.3)
    p, log_z, kept = quality.marginals(unary, starts, lengths, stay)
    total_z, total_kept = 0.0, np.zeros(2)
    for s, n in zip(starts, lengths, strict=True):
        z, good, own = 0.0, np.zeros(n), np.zeros(2)
        for labels in itertools.product((0, 1), repeat=int(n)):
            pairs = list(zip(labels, labels[1:], strict=False))
            weight = np.exp(sum(unary[s + i] for i in range(n) if labels[i]) + sum(stay[a] for a, b in pairs if a == b))
            z += weight
            good += weight * np.array(labels)
            own += weight * np.array([sum(a == b == v for a, b in pairs) for v in (0, 1)])
        assert np.allclose(p[s:s + n], good / z)
        total_z += np.log(z)
        total_kept += own / z
    assert np.isclose(log_z, total_z) and np.allclose(kept, total_kept)


def test_neighbours_stay_inside_documents():
    rows = np.arange(12, dtype=float).reshape(4, 3) + 1
    x = quality.with_neighbours(rows, np.array([0, 3]))
    assert (x[0, 3:6] == 0).all() and (x[1, 3:6] == rows[0]).all() and (x[2, 6:] == 0).all() and (x[3, 3:] == 0).all()


def corpus():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 9))) for _ in range(400)]
    docs = []
    for i in range(400):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(4, 25))).capitalize() + "." for _ in range(rng.randint(1, 9))]
        good = rng.random() < 0.7
        if not good:
            at = rng.randrange(len(lines))
            lines[at:] = [" ".join(w + "***" for w in x.split()) if i % 2 else x.upper() + "!!" for x in lines[at:]]
        docs.append((i, "\n".join(lines), int(good)))
    return docs


def test_held_out_accuracy(spark):
    rows = corpus()
    odd = [(1000, None), (1001, ""), (None, "A line without id."), (1002, "\n\n\n"), (1003, "x" * 70_000), (1004, "a\n" * 30_000), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t, _ in rows] + [(*r, 5, "s") for r in odd], "doc_id long, text string, score int, row string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    found = quality.with_scores(docs, model).selectExpr("row.doc_id as doc_id", "row.text as text", "score").collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    truth = {i: q for i, _, q in rows}
    held = [r for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in held]) > 0.93
    again = quality.train(docs.repartition(5), labels.repartition(3))
    assert np.allclose(again.weights, model.weights)


def test_training_never_sees_the_held_out_part(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, _, q in rows]
    a = quality.train(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    b = quality.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert np.allclose(a.weights, b.weights)


def test_bound_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in corpus()], "doc_id long, quality int")
    assert quality.train(docs, labels, sample_rows=5).weights.shape == (quality.FEATURES,)
    nothing = quality.train(docs, labels.limit(0))
    assert [r.score for r in quality.with_scores(docs.limit(2), nothing).collect()] == [0.5, 0.5]
    assert quality.with_scores(docs.limit(0), nothing).collect() == []
    odd = docs.limit(3).selectExpr("*", "1 AS `a b:c`", "named_struct('x.y', 2) AS `row`", "0.1D AS score")
    assert quality.with_scores(odd, nothing).select("row.*").columns == odd.columns
