"""Each stage of the pipeline on its own input, against brute force."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tallyforge.llm import quality, tokens
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_tokens import reference_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 9))) for _ in range(500)]
    line = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(6, 25))).capitalize() + "."
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(5)]
    rows = []
    for i in range(240):
        text = "\n".join(line() for _ in range(rng.randint(2, 9)))
        if i % 5 == 0:
            text = " ".join(w + "***" for w in text.split(" "))
        elif i % 11 == 1:
            text += "\n" + rng.choice(items)[1]
        elif i % 7 == 2 and rows:
            text = rows[-1][1]
        rows.append((i, text, "en", f"src{rng.choice((0, 0, 0, 1, 2))}", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "src1", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps, kept = [docs], [docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, steps[-1], path)
        if i < 4:
            assert out.columns == COLUMNS, name
        out.write.parquet(f"{path}/stage{i}")
        steps.append(spark.read.parquet(f"{path}/stage{i}"))
        kept.append(steps[-1].collect())
    before, good, single, clean, mixed, written = kept
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = quality.score_texts(model, [r.text for r in before])
    assert sorted(str(tuple(r)) for r in good) == sorted(str(tuple(r)) for r, s in zip(before, scores, strict=True) if s >= 0.7)
    assert not any("***" in (r.text or "") for r in good) and len(good) > 150
    components = brute_components([r.doc_id for r in good], [brute_fingerprint(r.text) for r in good])
    assert sorted(r.doc_id for r in single) == sorted(r.doc_id for r, c in zip(good, components, strict=True) if r.doc_id == c)
    assert len(single) < len(good)
    leaking = {f[0] for f in brute_leaks([(r.doc_id, r.text) for r in single], items)}
    assert leaking and sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if r.doc_id not in leaking)
    sizes, target, _ = brute_mix([(r.doc_id, r.source, r.text) for r in clean])
    words = {r.doc_id: len((r.text or "").split()) for r in clean}
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + words[r.doc_id]
    longest = max(words.values())
    assert {r.doc_id for r in mixed} <= set(words) and all(abs(taken.get(s, 0) - target[s]) <= longest for s in target)
    want = sorted((r.doc_id, len(reference_ids(r.text)) + 1, zlib.crc32(np.array(reference_ids(r.text) + [2], "<u4").tobytes())) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in written) == want
    again = sorted(tuple(r) for r in corpus_pipeline.run(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert again == sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in written)


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert tokens.END_ID == 2


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, score int, key string, first long, position double, words int, rank string, marked int"


def test_stages_keep_columns_of_any_name_and_repeated_ids(spark, folder):
    """Clashing names, repeated and null ids, fully equal rows, null and blank texts: each stage but the last returns the columns it got."""
    path, _ = folder
    extra = ("r", 1, "k", 2, 0.5, 3, "x", 1)
    texts = [f"A plain sentence number {i} about rivers and {i * 7} quiet hills, which ends here." for i in range(12)]
    rows = [(i % 9 if i % 5 else None, t, "en", "src0" if i % 3 else None, len(t), *extra) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (50, None, None, None, None, *extra), (50, "", "en", "src1", 0, *extra), (None, " \n", "en", "src1", 2, *extra)]
    docs = spark.createDataFrame(rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        found = [tuple(r) for r in out.collect()]
        assert set(found) <= set(rows), name
    single = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, path).collect()]
    assert len(single) == len(set(single)) and sum(1 for r in single if not (r[1] or "").strip()) == 1
    written = corpus_pipeline.write_tokens(spark, docs, path)
    assert sorted(str(r.doc_id) for r in written.collect()) == sorted(str(r[0]) for r in rows)


def test_stages_of_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, path).collect() == [], name
