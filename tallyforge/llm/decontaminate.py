"""Benchmark decontamination by SimHash windows.

Of every text, windows as long as a benchmark item (in words) are fingerprinted.  A multi-
index of Hamming blocks finds, for each window, all items of that length within
``radius`` bits: fingerprints that differ in at most ``radius`` bits agree in at least one
of ``radius + 1`` blocks.  No radius is sure to hold all windows of a similarity, so windows
beyond it that may pass (see below) are candidates as well.  All are verified by exact weighted-shingle similarity:
shared shingles of five words, each counting as often as it stands in both, over all shingles of the item.

Only windows that can pass are fingerprinted, and none that can is left out: a window that
reaches the threshold has at least that share of places where a shingle of the item
begins, so these places (found by one join with the items' shingles) say which windows to look at.

Everything is DataFrame operations.  Texts are keyed by a 128-bit hash, so copies of a text are
searched once.  The items' tables are small and written first; Spark broadcasts them
below its own threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import known_size, materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 20

_KEY = ["ka", "kb"]


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case: punctuation, case and spacing don't hide a copy."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def text_keys(text: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("ka"), F.xxhash64(F.lit(7), whole).alias("kb")]


def shingles(words: Column, width: Column | int, make) -> Column:
    """``make`` of each run of ``width`` words; the words are computed once, outside the inner loop."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.flatten(F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= width, F.transform(
        F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: make(F.slice(ws, i, width)))).otherwise(F.array())))


def counted(found: Column) -> Column:
    """Shingles whose repeats are told apart, so that sets of them intersect as multisets: the first as it is, later ones numbered."""
    def numbered(all_: Column) -> Column:
        return F.transform(all_, lambda x, i: F.concat_ws(" #", x, F.nullif(
            F.size(F.filter(F.slice(all_, F.lit(1), i), lambda y: y == x)), F.lit(0)).cast("string")))

    return F.element_at(F.transform(F.array(found), lambda all_: F.when(
        F.size(F.array_distinct(all_)) == F.size(all_), all_).otherwise(numbered(all_))), 1)


def fingerprint(words: Column) -> Column:
    """64-bit SimHash of the words, each occurrence counting: bit i is set if it is in over half of their hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bits = F.sequence(F.lit(0), F.lit(63))

    def bit(hs: Column, b: Column) -> Column:
        ones = F.aggregate(hs, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.element_at(F.transform(F.array(hashes), lambda hs: F.aggregate(
        bits, F.lit(0).cast("long"), lambda fp, b: fp.bitwiseOR(bit(hs, b)))), 1)


def hamming_blocks(fp: Column, radius: int) -> Column:
    """(block number, bits of the block) for the radius + 1 blocks of a fingerprint."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << hi - lo) - 1)).alias("bits"))
                     for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])


def items_table(benchmark: DataFrame, shingle_words: int, threshold: float, radius: int) -> DataFrame:
    """Items with words: id, length ``n``, shingle width ``k``, shingles, least overlap ``q``, fingerprint."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    full = (words.withColumn("k", F.least(F.lit(shingle_words), F.col("n")))
            .withColumn("shingles", counted(shingles(F.col("words"), F.col("k"), lambda s: F.array_join(s, " "))))
            .withColumn("hashes", shingles(F.col("words"), F.col("k"), F.xxhash64))
            .withColumn("q", F.greatest(F.lit(1), F.ceil(F.lit(threshold) * (F.col("n") - F.col("k") + 1) - 1e-9).cast("int")))
            .withColumn("fp", fingerprint(F.col("words"))))
    return known_size(full.withColumn("item", F.xxhash64("item_id", F.array_join("words", " "))).dropDuplicates(["item"]), "items")


def candidate_windows(docs: DataFrame, items: DataFrame, shingle_words: int) -> DataFrame:
    """``ka, kb, item, n, start``: windows with at least as many starting places of an item's shingles as the threshold needs."""
    # Items of fewer words than a shingle are one shingle of their own length: at most shingle_words widths.
    widths = sorted(r.k for r in items.select("k").distinct().collect())
    places = None
    for k in widths:
        own = known_size(items.filter(F.col("k") == k).select("item", "n", "q", F.explode(F.array_distinct("hashes")).alias("h")), "item-shingles")
        found = docs.select(*text_keys(F.col("text")), F.posexplode(shingles(words_of(F.col("text")), k, F.xxhash64)).alias("pos", "h"))
        found = found.join(own, "h").select(*_KEY, "item", "n", "q", F.lit(k).alias("k"), "pos")
        places = found if places is None else places.union(found)
    # At most a text's own places come together, and copies of a text add none.
    grouped = places.groupBy(*_KEY, "item", "n", "q", "k").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    last = F.col("n") - F.col("k")
    # q places fit in a window if the last of them begins early enough after the first.
    first = F.filter(F.sequence(F.lit(1), F.size("places") - F.col("q") + 1),
                     lambda i: F.element_at("places", i + F.col("q") - 1) - F.element_at("places", i) <= last)
    starts = F.transform(first, lambda i: F.sequence(
        F.greatest(F.lit(0), F.element_at("places", i + F.col("q") - 1) - last), F.element_at("places", i)))
    able = grouped.filter(F.size("places") >= F.col("q"))
    return able.select(*_KEY, "item", "n", F.explode(F.array_distinct(F.flatten(starts))).alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = SIMILARITY,
          radius: int = RADIUS, short_texts: bool = False) -> DataFrame:
    """``ka, kb, item_id, start, n_words, similarity``: for each text (by key) and item the best window that reaches the threshold.

    ``start`` counts words from 0; of equal windows the first is given.  Null texts, texts and
    items without words never match; an item longer than the text doesn't either, unless
    ``short_texts``: then such a text is one window, the whole of it.  Items of fewer than ``shingle_words`` words are one shingle.  Items of equal id and words count once.
    """
    items = items_table(benchmark.select("item_id", "text"), shingle_words, threshold, radius)
    if items.isEmpty():
        return docs.sparkSession.createDataFrame([], f"ka long, kb long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, "
                                                     "start int, n_words int, similarity double")
    windows = known_size(candidate_windows(docs, items, shingle_words), "windows")
    wanted = known_size(windows.groupBy(*_KEY).agg(F.collect_set(F.struct("n", "start")).alias("windows")), "texts-with-windows")
    texts = docs.select(*text_keys(F.col("text")), "text").join(wanted.select(*_KEY), _KEY, "left_semi")
    # Grouped by a value of its own, so that copies are reduced before they are exchanged and a text of many copies can be split.
    one_each = texts.groupBy(F.struct(*_KEY).alias("key")).agg(F.first("text").alias("text")).select("key.*", "text").join(wanted, _KEY)
    def fits(w: Column, size: Column) -> Column:
        inside = w["start"] + w["n"] <= size
        return inside | ((w["start"] == 0) & (w["n"] > size)) if short_texts else inside

    cut = (one_each.select(*_KEY, words_of(F.col("text")).alias("words"), F.col("windows"))
           .select(*_KEY, F.explode(F.transform(F.filter("windows", lambda w: fits(w, F.size("words"))), lambda w: F.struct(
               w["n"].alias("n"), w["start"].alias("start"), F.slice("words", w["start"] + 1, w["n"]).alias("words")))).alias("w")))
    prints = materialize(cut.select(*_KEY, "w.*").withColumn("fp", fingerprint(F.col("words"))), "window-fingerprints")
    indexed = known_size(items.select("item", "n", F.col("fp").alias("item_fp"), F.inline(hamming_blocks(F.col("fp"), radius))), "item-blocks")
    near = (prints.select(*_KEY, "n", "start", "fp", F.inline(hamming_blocks(F.col("fp"), radius))).join(indexed, ["n", "block", "bits"]))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    beyond = (windows.join(prints.select(*_KEY, "n", "start", "fp"), [*_KEY, "n", "start"])
              .join(items.select("item", F.col("fp").alias("item_fp")), "item").filter(apart > radius))
    pairs = near.filter(apart <= radius).select(*_KEY, "n", "start", "item").union(beyond.select(*_KEY, "n", "start", "item")).distinct()
    verify = pairs.join(prints.select(*_KEY, "n", "start", "words"), [*_KEY, "n", "start"]).join(
        items.select("item", "item_id", "k", "q", "shingles"), "item")
    shared = F.size(F.array_intersect("own", "shingles"))
    scored = (verify.withColumn("own", counted(shingles(F.col("words"), F.col("k"), lambda s: F.array_join(s, " "))))
              .withColumn("shared", shared).filter(F.col("shared") >= F.col("q"))
              .select(*_KEY, "item", "item_id", "start", F.col("n").alias("n_words"), (F.col("shared") / F.size("shingles")).alias("similarity")))
    best = scored.groupBy(*_KEY, "item", "item_id", "n_words").agg(
        F.min(F.struct((-F.col("similarity")).alias("less"), "start")).alias("b"))
    return best.select(*_KEY, "item_id", "b.start", "n_words", (-F.col("b.less")).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity`` for every row of ``docs`` and item that its text holds.

    Repeated rows each give their rows; other columns are not read.
    """
    found = known_size(leaks(docs.select("text"), benchmark, **options), "leaks")
    return docs.select("doc_id", *text_keys(F.col("text"))).join(found, _KEY).drop(*_KEY)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without the rows whose text holds an item."""
    found = known_size(leaks(docs.select("text"), benchmark, **options).select(*_KEY).distinct(), "leaking-texts")
    tagged = docs.select(F.struct("*").alias("row"), *text_keys(F.col("text")))
    return tagged.join(found, _KEY, "left_anti").select("row.*")
