import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import simhash
from tallyforge.llm.components import component_roots


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, radius=4):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(x, least.get(top(i), x))
    return [least.get(top(i)) for i in range(len(ids))]


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two", "É é A a", "x" * 70_000, "word " * 30_000]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(2, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("\n".join(copy))
    return [(i, t) for i, t in enumerate(texts)]


def test_fingerprint_matches_brute_force():
    for _, text in corpus():
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("piece_rows", [4096, 3])
def test_components_match_brute_force(spark, piece_rows):
    rows = corpus() + [(5, "one two"), (None, "one two"), (None, "a text without any id at all")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, fp long")
    got = sorted(simhash.near_duplicates(docs, piece_rows=piece_rows).collect(), key=str)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    expected = sorted(((i, simhash._signed(f), c) for (i, _), f, c in zip(rows, fps, want, strict=True)), key=str)
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(expected, key=lambda r: str(r))] or \
        sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_search_loses_no_link(spark):
    """Fingerprints at every distance up to the radius around random centres, one crowded centre among them."""
    rng = random.Random(1)
    fps = set()
    for crowd in [400] + [6] * 40:
        centre = rng.getrandbits(64)
        for _ in range(crowd):
            fp = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                fp ^= 1 << bit
            fps.add(fp)
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for pieces in (4096, 50):
        links = simhash.fingerprint_links(frame, piece_rows=pieces).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
        roots = {r.a: r.root for r in component_roots(spark.createDataFrame(links)).collect()}
        got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
        want = brute_components([simhash._signed(f) for f in fps], fps)
        assert got == want


def test_one_of_each(spark):
    docs = spark.createDataFrame(
        [(2, "same text here now", "a"), (1, "same text here now", "b"), (1, "same text here now", "b"),
         (None, "no id on this row", "c"), (None, "no id on this row", "d"), (9, None, "e"), (8, "", "f")],
        "doc_id long, text string, row string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = sorted(tuple(r) for r in kept.collect() if r.doc_id is not None)
    assert rows == [(1, "same text here now", "b"), (8, "", "f")]
    assert kept.filter(F.col("doc_id").isNull()).count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.one_of_each(docs).collect() == []


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (100, 101)]
    roots = {r.a: r.root for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {101: 100}


def test_pivots_bound_the_distance():
    x, y = np.uint64(simhash.fingerprint("a b c d e f g")), np.uint64(simhash.fingerprint("a b c d e f h"))
    gap = np.abs(np.bitwise_count(x ^ simhash.PIVOTS).astype(int) - np.bitwise_count(y ^ simhash.PIVOTS).astype(int)).max()
    assert gap <= int(np.bitwise_count(x ^ y))


def similarity(a, b):
    a, b = (set(simhash._shingles(t, 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_texts_leave_one(spark):
    """Copies at a five-word similarity of 0.8 or more go, texts below 0.6 stay."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(2000)]
    rows, near, far = [], [], []
    for n in range(120):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows.append((10 * n, " ".join(base)))
        for j, rate in enumerate((0.003, 0.01, 0.02, 0.12), 1):
            copy = [rng.choice(vocabulary) if rng.random() < rate else w for w in base]
            share = similarity(rows[-j][1], " ".join(copy))
            rows.append((10 * n + j, " ".join(copy)))
            near += [rows[-1][0]] * (share >= 0.8)
            far += [rows[-1][0]] * (share < 0.55 and j == 4)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {10 * n for n in range(120)} <= kept
    assert len(near) > 150 and not set(near) & kept
    assert len(far) > 60 and set(far) <= kept


@pytest.mark.parametrize("piece_rows", [4096, 3])
def test_stage_equals_exact_similarity(spark, piece_rows):
    """Just the rows that brute-force similarity of five-word shingles leaves, short texts and one shared passage among them."""
    rng = random.Random(21)
    vocabulary = [f"u{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    texts = [None, "", "one", "One", "one two", "a b a b a b a b", "a b a b a b a b a b a b"]
    for _ in range(90):
        base = rng.choices(vocabulary, k=rng.choice((14, 17, 20, 40, 80)))
        texts.append(" ".join(base))
        for _ in range(3):
            cut = rng.randint(1, max(2, len(base) // 5))
            texts.append(" ".join(base[:-cut] + rng.choices(vocabulary, k=cut)))
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(3, 14))) for _ in range(60)]
    sets = [set(simhash._shingles(t, 5)) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    below = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            share = len(x & y) / len(x | y) if x | y else 1
            below += 0.6 <= share < 0.8
            if share >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    want = {i for i in range(len(texts)) if top(i) == i}
    assert below > 300 and len(want) < len(texts) - 60
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), piece_rows=piece_rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_order_of_common_shingles_loses_no_pair():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9, 14, 63, 400):
        x = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        for gone in range(n // 9 + 1):
            y = np.unique(np.concatenate((x[gone:], rng.integers(0, 2 ** 63, gone).astype(np.uint64))))
            common = np.unique(rng.choice(x, max(1, n // 2)))
            ranks = rng.integers(3, 9, len(common))
            assert np.intersect1d(simhash._prefix(x, common, ranks), simhash._prefix(y, common, ranks)).size
            assert np.bitwise_count((simhash._parity(x) ^ simhash._parity(y)).view(np.uint64)).sum() <= 2 * gone
            wide = [np.frombuffer(simhash._long_parity(z), dtype=np.uint64) for z in (x, y, np.concatenate((y, rng.integers(0, 2 ** 63, 900).astype(np.uint64))))]
            width = min(map(len, wide))
            bits = [simhash._folded(w, width) for w in wide]
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= 2 * gone and np.bitwise_count(bits[1] ^ bits[2]).sum() <= 900


def test_hot_shingles(spark):
    """Thousands of texts that share nearly all shingles are one group; thousands that share one stay, however pieces are cut."""
    rng = random.Random(33)
    passage = [f"p{i}" for i in range(24)]
    rows = [(i, " ".join([*passage, f"x{i}"])) for i in range(5000)]
    rows += [(10_000 + i, " ".join(["one", "shared", "run", "of", "words", f"y{i}", f"z{rng.randrange(9)}"])) for i in range(5000)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), piece_rows=700)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(10_000, 15_000)]


def test_long_texts_that_share_passages_are_not_compared(spark, monkeypatch):
    """Parities as many as shingles tell long texts apart without their texts."""
    rng = random.Random(34)
    passage = [f"p{i}" for i in range(900)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)])) for i in range(12)]
    rows += [(100, rows[0][1] + " end"), (101, rows[5][1] + " another end")]
    compared = []
    plain = simhash._checked
    monkeypatch.setattr(simhash, "_checked", lambda pairs, *more: compared.append((more[-1], pairs.count())) or plain(pairs, *more))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(12))
    assert sum(n for tag, n in compared if tag == "similar-pairs") <= 4 < sum(n for tag, n in compared if tag == "able-pairs")


def test_long_texts_that_share_passages_are_few_pairs(spark, monkeypatch):
    """Long texts that share passages aren't given as pairs, and similar ones that meet in many buckets are given about once."""
    rng = random.Random(35)
    passage = [f"p{i}" for i in range(900)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)])) for i in range(40)]
    base = [f"b{i}" for i in range(2000)]  # each two of this family share three quarters of their shingles
    rows += [(100 + i, " ".join(f"c{i}-{j}" if j % 50 == 3 * i else w for j, w in enumerate(base))) for i in range(12)]
    rows += [(200, rows[0][1] + " end"), (201, rows[45][1] + " another end")]
    plain = simhash._search_able

    def counted(forest):
        def run(batches):
            for batch in plain(forest)(batches):
                total.add(0 if forest else batch.num_rows)
                yield batch
        return run

    total = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(simhash, "_search_able", counted)
    kept = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [*range(40), *range(100, 112)]
    assert total.value <= 150
