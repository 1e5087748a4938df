"""Choosing few-shot examples: greedy label coverage and nearest neighbours."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.neighbours import knn_topk
from tallyforge.operators.ordering import hashed_key
from tallyforge.session import materialize


def coverage_select(pairs: DataFrame, k: int, task: str = "task_id", label: str = "label", seed: int = 9,
                    key: Callable[[str], Column] | None = None, front: int = 10_000) -> DataFrame:
    """Greedy choice of ``k`` tasks that together cover the most labels.

    Each pick is the task with the most labels not covered yet; ties go by shuffle key.  Once
    nothing new can be covered, the rest is filled in shuffle order.

    Of tasks with equal label sets only the first in shuffle order can ever be picked, so one scan leaves
    a row per label set.  The ``front`` largest sets come to the driver, as bits.  There the greedy choice is
    lazy: what a set would have gained earlier, its size at first, is an upper bound, and only sets whose bound
    reaches the best gain found are looked at again.  The sets behind the front are asked in Spark
    if a pick gains no more than the largest of them has labels, which costs a scan of the sets, not of the tasks.
    """
    order = key or (lambda c: hashed_key(c, seed))
    own = pairs.groupBy(task).agg(F.sort_array(F.collect_set(label)).alias("labels"))
    first = F.min(F.struct(order(task).alias("key"), F.col(task).alias("id")))
    sets = materialize(own.groupBy("labels").agg(first.alias("first")).withColumn("size", F.size("labels")), "label-sets")
    held = sets.filter("size > 0").orderBy(F.desc("size"), "first").limit(front + 1).collect()
    behind = held[front] if len(held) > front else None
    numbers: dict[str, int] = {}
    rows = [(r["first"], sum(1 << numbers.setdefault(name, len(numbers)) for name in r["labels"])) for r in held[:front]]
    heap = [(-bits.bit_count(), tuple(at), bits) for at, bits in rows]
    heapq.heapify(heap)
    covered, names, chosen = 0, set(), []
    while len(chosen) < k:
        while heap and (gain := (heap[0][2] & ~covered).bit_count()) < -heap[0][0]:
            heapq.heapreplace(heap, (-gain, *heap[0][1:]))
        best = (-heap[0][0], heap[0][1]) if heap else (0, None)
        labels = None
        if behind is not None and best[0] <= behind["size"]:
            gains = sets.filter((F.col("size") >= best[0]) & ((F.col("size") < behind["size"]) | (
                (F.col("size") == behind["size"]) & (F.col("first") >= F.struct(F.lit(behind["first"]["key"]).alias("key"), F.lit(behind["first"]["id"]).alias("id"))))))
            gain = F.size(F.array_except("labels", F.lit(sorted(names)).cast("array<string>"))) if names else F.col("size")
            found = gains.agg(F.min(F.struct((-gain).alias("loss"), "first", "labels"))).first()[0]
            if found is not None and (found["loss"], tuple(found["first"])) < (-best[0], best[1] or ()):
                best, labels = (-found["loss"], tuple(found["first"])), found["labels"]
        if best[0] <= 0:
            break
        if labels is None:
            bits = heapq.heappop(heap)[2]
            labels = [name for name, n in numbers.items() if bits >> n & 1]
        chosen.append((best[1][1], best[0]))
        names.update(labels)
        covered |= sum(1 << numbers.setdefault(name, len(numbers)) for name in labels)
    if len(chosen) < k:
        picked = {i for i, _ in chosen}
        rest = pairs.select(task).distinct().select(order(task).alias("key"), F.col(task).alias("id")).orderBy("key", "id").limit(k).collect()
        chosen += [(r["id"], 0) for r in rest if r["id"] not in picked][:k - len(chosen)]
    kind = pairs.schema[task].dataType.simpleString()
    ranked = [(rank, i, gain) for rank, (i, gain) in enumerate(chosen, 1)]
    return pairs.sparkSession.createDataFrame(ranked, f"rank int, `{task}` {kind}, gain long")


def similarity_select(tasks: DataFrame, examples: DataFrame, shots: int, exclude_self: bool = False) -> DataFrame:
    """The ``shots`` examples nearest to each task, with the columns of the example.

    Both sides have columns ``id, vector``; further example columns are carried along.
    """
    near = knn_topk(tasks, examples, shots, exclude_self)
    extra = examples.drop("vector").withColumnRenamed("id", "neighbor_id")
    return near.join(extra, "neighbor_id")


def hashing_embedding(chunks: DataFrame, text: str = "content", dims: int = 256) -> DataFrame:
    """Default text embedding without a model: normalised hashed word counts in ``vector``."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    words = RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\W+").transform(chunks)
    counts = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="__counts", outputCol="__unit").transform(counts)
    return unit.withColumn("vector", vector_to_array("__unit", "float32")).drop("__words", "__counts", "__unit")


def build_chunk_index(chunks: DataFrame, text: str = "content",
                      embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks with an embedding column ``vector``; ``embed`` is any Column function, e.g. a Pandas UDF."""
    return hashing_embedding(chunks, text) if embed is None else chunks.withColumn("vector", embed(F.col(text)))


def filter_corpus_files(chunks: DataFrame, names: Sequence[str], file: str = "file") -> DataFrame:
    """Chunks whose base file name, ignoring case, is in the list."""
    return chunks.filter(F.upper(F.substring_index(F.col(file), "/", -1)).isin([n.upper() for n in names]))


def pca_2d(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Project all vectors on their first two principal components (fits a model).

    Vectors are centred first.  The sign of a component is arbitrary.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dense = vectors.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    width = dense.select(F.size(vector)).first()
    if width is None or width[0] < 2:
        raise ValueError("vectors need at least two dimensions")
    centred = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(dense).transform(dense)
    projected = PCA(k=2, inputCol="__c", outputCol="__p").fit(centred).transform(centred)
    return projected.withColumn("__a", vector_to_array("__p")).select(
        *[c for c in vectors.columns if c != vector],
        F.col("__a")[0].alias("pc1"), F.col("__a")[1].alias("pc2"))


def stack_datasets(named: dict[str, DataFrame]) -> DataFrame:
    """Several datasets in one frame with the name of the origin in ``dataset``."""
    frames: Iterator[DataFrame] = (df.withColumn("dataset", F.lit(n)) for n, df in named.items())
    first = next(frames)
    for df in frames:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
