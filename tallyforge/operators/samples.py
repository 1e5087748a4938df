"""Benchmark samples, label sets and the function catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators.ordering import numbered_in_order
from tallyforge.session import known_size

# Label prefix removed for display, and the text for a name without documentation.
LABEL_PREFIX = "root.std."
NO_DOC = "No doc"


def bare_label(label: Column) -> Column:
    return F.replace(label, F.lit(LABEL_PREFIX), F.lit(""))


def _joined_labels(labels: str) -> Column:
    return F.array_join(F.transform(labels, bare_label), ", ")


def flatten_node_sample(tasks: DataFrame) -> DataFrame:
    """Task text with its labels as the expected response."""
    return tasks.select(
        F.col("MBPP_task_id").cast("string").alias("MBPP_task_id"), F.col("task_id").cast("string").alias("task_id"),
        F.try_element_at("prompts", F.lit(1)).alias("task"),
        _joined_labels("external_functions").alias("response"),
        _joined_labels("external_functions").alias("external_functions"))


def flatten_code_sample(tasks_with_code: DataFrame) -> DataFrame:
    """Task text, program, labels and the nested specification and tests, lifted to the top."""
    return tasks_with_code.select(
        F.col("MBPP_task_id").cast("string").alias("MBPP_task_id"), F.col("task_id").cast("string").alias("task_id"),
        F.try_element_at("prompts", F.lit(1)).alias("task"), F.col("code").alias("response"),
        _joined_labels("external_functions").alias("external_functions"),
        F.col("testing.python_tests").alias("python_tests"), F.col("testing.tests").alias("tests"),
        F.col("specification.function_signature").alias("function_signature"),
        F.col("specification.preconditions").alias("preconditions"),
        F.col("specification.postconditions").alias("postconditions"), "flow_description")


def code_to_node_sample(samples: DataFrame) -> DataFrame:
    return samples.withColumn("response", F.col("external_functions"))


def split_label_string(samples: DataFrame, column: str = "external_functions") -> DataFrame:
    return samples.withColumn(column, X.split_labels(F.col(column)))


def drop_nested_field(tasks: DataFrame, column: str = "testing", field: str = "tests") -> DataFrame:
    return tasks.withColumn(column, F.col(column).dropFields(field))


def task_label_pairs(tasks: DataFrame, task: str = "task_id", labels: str = "external_functions") -> DataFrame:
    return tasks.select(task, F.explode(F.array_distinct(labels)).alias("label"))


def used_catalog(catalog: DataFrame, labels: DataFrame) -> DataFrame:
    """Catalog rows whose name occurs among the labels.

    Labels are reduced to distinct names before they meet the catalog.
    """
    names = labels.select(bare_label(F.col("label")).alias("function_name")).distinct()
    return catalog.join(names, "function_name", "left_semi")


def missing_labels(catalog: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct labels that the catalog does not know."""
    return labels.select(bare_label(F.col("label")).alias("label")).distinct().join(
        catalog.select(F.col("function_name").alias("label")), "label", "left_anti")


def unseen_labels(labelled: DataFrame, train: str = "train") -> DataFrame:
    """Distinct (split, label) of the other splits whose label does not occur in training."""
    pairs = labelled.select("split", "label").distinct()
    seen = pairs.filter(F.col("split") == train).select("label")
    return pairs.filter(F.col("split") != train).join(seen, "label", "left_anti")


def label_distribution(labelled: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Label counts with one column per split, zeros filled in."""
    bare = labelled.select("split", bare_label(F.col("label")).alias("label"))
    return bare.groupBy("label").pivot("split", list(splits)).count().na.fill(0, list(splits))


def label_matrix(pairs: DataFrame, labels: Sequence[str], task: str = "task_id") -> DataFrame:
    """Indicator matrix: one row per task, one 0/1 column per label in the given order.

    The labels are an argument, as columns have to be known; ``label_matrix_entries``
    gives the same matrix sparsely for any label set.
    """
    labels, width = list(labels), 62
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1

    def marks(word: int) -> Column:
        """The labels of one word of bits: a group is a few numbers, however many columns come of it."""
        mine = F.floor(place / width) == word
        return F.coalesce(F.bit_or(F.when(mine, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(width)).cast("int")))), F.lit(0).cast("long"))

    words = pairs.groupBy(task).agg(*[marks(w).alias(f"__w{w}") for w in range(-(-len(labels) // width))])
    return words.select(task, *[F.shiftrightunsigned(f"__w{i // width}", i % width).bitwiseAND(F.lit(1)).cast("int").alias(label) for i, label in enumerate(labels)])


def label_matrix_entries(pairs: DataFrame, task: str = "task_id") -> DataFrame:
    """The ones of the indicator matrix as (task, column) for label sets of any size."""
    names = pairs.select("label").distinct()
    numbered = known_size(numbered_in_order(names, ["label"], "column"), "label-columns")
    return pairs.distinct().join(numbered, "label").select(task, (F.col("column") - 1).alias("column"), "label")


def lookup_node_doc(predicted: DataFrame, catalog: DataFrame, position: str, name: str = "node") -> DataFrame:
    """Documentation of each predicted name; of several catalog rows the first by ``position`` counts."""
    docs = catalog.groupBy(F.col("function_name").alias("__name")).agg(F.min_by("doc", position).alias("doc"))
    return (predicted.join(docs, X.strip(F.col(name)) == F.col("__name"), "left").drop("__name")
            .withColumn("doc", F.coalesce("doc", F.lit(NO_DOC))))


def catalog_entry_text(name: Column, doc: Column) -> Column:
    """One catalog entry the way it is shown in a prompt."""
    return F.concat(F.lit("Function node name: "), name, F.lit("\n Documentation: "), doc, F.lit("\n\n"))


def pool_order(pool: DataFrame, task: str = "task_id") -> DataFrame:
    return pool.orderBy(F.col(task).cast("long"))


def catalog_frame(spark: SparkSession, path: str) -> DataFrame:
    from tallyforge.operators.catalog import extract_catalog
    from tallyforge.sources.readers import read_json_array
    from tallyforge.sources.schemas import CATALOG

    if path.endswith(".json"):
        return read_json_array(spark, path, CATALOG)
    return extract_catalog(spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
