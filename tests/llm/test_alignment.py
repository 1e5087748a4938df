import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import alignment
from tallyforge.llm.queries import alignment_files

DEFINITION, MODEL = alignment_files()
A = Tokenizer.from_str(DEFINITION)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
NAMES = {i: t for t, i in A.get_vocab().items()}
SCHEMA = "doc_id long, text string, row long, pairs string, n_a int"
OWN = alignment.Aligner.of(DEFINITION, MODEL)


def a_bytes(i):
    return bytes(alignment._BYTES[c] for c in NAMES[i])


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and piece.endswith(">") and len(piece) == 6 else piece.replace("▁", " ").encode()


def brute(text):
    """n_a, n_b, n_groups, links as a list of id pairs, digest."""
    if not text:
        return 0, 0, 0, [], ""
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spans = []
    for ids, of in ((a, a_bytes), (b, b_bytes)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(of(i)), i))
            at += len(of(i))
        spans.append(own)
        if b"".join(map(of, ids)) != (" " + text).encode():
            return 0, 0, 0, [], ""
    ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
    groups, start = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(i) for s, e, i in own if start <= s and e <= end) for own in spans))
        start = end
    return len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def expected(rows):
    found = [brute(t) for _, t in rows]
    docs = {}
    for _, _, _, links, _ in found:
        for pair in set(links):
            docs[pair] = docs.get(pair, 0) + 1
    most = {}
    for (i, _), n in docs.items():
        most[i] = max(most.get(i, 0), n)
    return sorted(str((doc, n_a, n_b, n_g, len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), digest))
                  for (doc, _), (n_a, n_b, n_g, links, digest) in zip(rows, found, strict=True))


TEXTS = ["", None, "plain words of a text", "  two  blanks  ", "\n\ttabs\r\n", " ", "<|endoftext|> and <s> </s> <unk>", "▁ marks ▁▁", "naïve Zürich 東京 😀👩‍👩‍👧",
         "a\x00b\x7f\x85 ﻿ 　", "ﬁ ½ é", "x" * 300, "1234567890 " * 20, "antidisestablishmentarianism uncharacteristically"]


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], SCHEMA)
    found = alignment.with_pair_counts(docs.repartition(3), DEFINITION, MODEL, **more)
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("frequent", [0, 40, 1 << 20])
def test_against_brute_force(spark, frequent):
    rng = random.Random(4)
    words = "the of tokenizer alignment über naïve 東京 x1y2 don't we'll Straße \n  zzzqq".split(" ")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")] * 2 + [(3, "same id"), (3, "same id")]
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(60)]
    assert run(spark, rows, frequent=frequent) == expected(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aA é ßtheing'st9½\t\n\x0b\x85\xa0́　中▁<|endoftext|>.😀İ"), max_size=40), min_size=1, max_size=4))
def test_a_batch_is_its_texts(texts):
    found = OWN.align(pa.array(texts, pa.string())).to_pylist()
    for row, text in zip(found, texts, strict=True):
        n_a, n_b, n_groups, links, digest = brute(text)
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["groups_sha256"]) == (n_a, n_b, n_groups, len(links), digest)
        held = [i * len(OWN.b.bytes) + j for i, j in links]
        assert row["pairs"] == sorted(set(held)) and row["times"] == [held.count(p) for p in row["pairs"]]


def test_slow_tokenizer_gives_the_same():
    slow = alignment.ByteLevel(DEFINITION)
    texts = [t for t in TEXTS if t]
    fast = [x.tolist() for x in slow.encode(texts)]
    slow._fast, slow._slow = None, A
    assert fast == [list(x) for x in slow.encode(texts)]


def test_long_text_in_small_batches(spark, monkeypatch):
    rows = [(1, "lorem ipsum über " * 40_000), (2, "lorem"), (3, None)]
    found = alignment.with_pair_counts(spark.createDataFrame(rows, "doc_id long, text string"), DEFINITION, MODEL).collect()
    long = next(r for r in found if r.doc_id == 1)
    assert long.n_links == long.n_a + long.n_b - long.n_groups > 100_000


def test_empty_table(spark):
    assert run(spark, []) == []
