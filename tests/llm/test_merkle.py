import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, digest string, g int, pos string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(digests):
    """All levels of one tree, and each leaf's siblings as (left, right) per level."""
    paths, spans, level = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(level) > 1:
        parents, grouped = [], []
        for s in range(0, len(level), 8):
            run = level[s:s + 8]
            for k in range(len(run)):
                for leaf in spans[s + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            parents.append(sha("".join(run)))
            grouped.append([leaf for part in spans[s:s + 8] for leaf in part])
        level, spans = parents, grouped
    return level[0], paths


def expected(rows):
    parts = {}
    for doc, text, lang, source, n_chars, *_ in rows:
        head = "".join(map(framed, (doc, source, lang, n_chars)))
        changed = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        parts.setdefault(lang, []).append((doc is not None, doc, sha(head + framed(text)), sha(head + framed(lowered(text) if changed else text))))
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        parts[lang].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees.append(levels([x[2] for x in parts[lang]]))
    root, tops = levels([t[0] for t in trees])
    out = []
    for lang, (subroot, paths), above in zip(order, trees, tops, strict=True):
        for (_, doc, leaf, own), path in zip(parts[lang], paths, strict=True):
            acc, proof = own, ""
            for left, right in path + above:
                acc, proof = sha(left + acc + right), proof + left + right
            out.append((doc, leaf, subroot, root, sha(proof), acc, acc == root))
    return sorted(map(str, out))


def rows_of(sizes, seed=3):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            text = rng.choice([None, "", f"Plain Text {i}", f"lower {i}", "Ünï \U0001f600 " * rng.randrange(4), "Same"])
            rows.append((i * 7 % 1009, text, lang, rng.choice([None, "", "src"]), rng.choice([None, i]), "x", 1, "y"))
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 600, None: 65, "": 1, "de": 64, "fr": 8, "\U0001f600": 9, "￿": 2},
    {f"l{i}": 1 + i % 3 for i in range(70)}, {"en": 1}, {None: 9}, {"en": 2, "de": 1}])
def test_against_brute_force(spark, sizes):
    rows = rows_of(sizes)
    rows += [(None, "No Id", rows[0][2], None, None, "x", 1, "y")] * 2 + [rows[0]] * 2 + [(rows[0][0], "Other", *rows[0][2:])]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.verify(docs.repartition(5)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(str(tuple(r)) for r in found.collect()) == expected(rows)


def test_one_part_of_one_row(spark):
    found = merkle.verify(spark.createDataFrame([(5, "A", "en", "s", 1, "", 1, "")], SCHEMA)).collect()
    assert len(found) == 1 and found[0].leaf == found[0].subroot == found[0].root and found[0].proof_sha256 == sha("")


def test_empty_table(spark):
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).collect() == []
    assert merkle.build(spark.createDataFrame([], SCHEMA)).root.count() == 0


def test_levels_are_an_eighth_each(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    manifest = merkle.build(docs)
    assert [level.count() for level in manifest.parts.levels] == [125, 16, 2, 1]
    moved = merkle.build(docs.withColumn("text", F.when(F.col("doc_id") == 500, "b").otherwise(F.col("text"))))
    a, b = (m.parts.levels[0].select("parent", "digest") for m in (manifest, moved))
    assert [r.parent for r in a.exceptAll(b).collect()] == [62]
    assert manifest.root.first() != moved.root.first()
