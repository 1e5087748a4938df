import random
import re

from tallyforge.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items, threshold=0.8, width=5):
    """Best window of each text for each item, over all windows."""
    found = []
    for doc_id, text in docs:
        w = words(text)
        for item_id, item in {(i, t) for i, t in items}:
            v = words(item)
            if not v:
                continue
            k = min(width, len(v))
            target = [tuple(v[i:i + k]) for i in range(len(v) - k + 1)]
            best = None
            for s in range(len(w) - len(v) + 1):
                own = [tuple(w[i:i + k]) for i in range(s, s + len(v) - k + 1)]
                share = sum(min(own.count(x), target.count(x)) for x in set(target)) / len(target)
                if share >= threshold and (best is None or share > best[1]):
                    best = (s, share)
            if best:
                found.append((doc_id, item_id, best[0], len(v), best[1]))
    return found


def corpus():
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.randint(6, 40)))) for i in range(12)]
    items += [(50, "Two words"), (51, "one"), (52, None), (53, " ,.! "), (None, "null id item with seven words"), (54, "a b a b a b a b a b a b")]
    docs = [(900, None), (901, ""), (902, "x " * 30_000), (903, "two words"), (904, "a b " * 20), (904, "a b " * 20), (905, "NULL id, item! with seven: words")]
    for n in range(60):
        body = make(rng.randint(0, 80))
        leak = words(rng.choice(items[:12])[1])
        kind = n % 6
        at = rng.randrange(len(body) + 1)
        if kind == 1:
            leak[0] = "edge"
        elif kind == 2:
            del leak[len(leak) // 2]
        elif kind == 3:
            leak.insert(len(leak) // 2, "more")
        elif kind == 4:
            leak = leak[len(leak) // 3:]
        elif kind == 5:
            leak = [w.upper() + "," for w in leak]
        docs.append((n if n else None, "  ".join(body[:at] + leak + body[at:])))
    return docs, items


def test_matches_brute_force_over_all_windows(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, ka int, item string")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n int")
    got = sorted(map(str, (tuple(r) for r in decontaminate.contaminated(frame, bench).collect())))
    want = sorted(map(str, brute(docs, items)))
    assert got == want and len(want) > 30
    left = decontaminate.without_leaks(frame, bench)
    assert left.columns == frame.columns
    bad = {str(r[0]) for r in brute(docs, items)}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d[0]) for d in docs if str(d[0]) not in bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text of enough words here")], "doc_id long, text string")
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "some text of enough words here")], "item_id long, text string")
    assert decontaminate.contaminated(none, items).collect() == []
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == 1
    assert [r.similarity for r in decontaminate.contaminated(docs, items).collect()] == [1.0]


def test_no_window_at_the_threshold_is_lost(spark):
    """Items with their tail replaced down to just the threshold; some of them differ by more bits than the radius."""
    rng = random.Random(4)
    items, docs = [], []
    for i in range(1500):
        own = [f"w{rng.randrange(10 ** 6)}" for _ in range(54)]
        items.append((i, " ".join(own)))
        docs.append((i, " ".join(own[:44] + [f"z{rng.randrange(10 ** 6)}" for _ in range(10)])))  # 40 of 50 shingles
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(1500)]


def test_short_texts_are_one_window(spark):
    item = " ".join(f"s{i}" for i in range(20))
    texts = [item.rsplit(" ", cut)[0] for cut in (1, 3, 4)] + ["s0 s1 s2", item.split(" ", 1)[1], ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r.similarity for r in decontaminate.contaminated(docs, benchmark, short_texts=True).collect()}
    assert found == {0: 15 / 16, 1: 13 / 16, 4: 15 / 16}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, benchmark, short_texts=True).collect()) == [2, 3, 5]
    assert decontaminate.contaminated(docs, benchmark).count() == 0
