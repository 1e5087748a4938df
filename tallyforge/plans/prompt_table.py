"""From tasks, examples and documentation to the final prompt table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import context as C
from tallyforge.operators.selection import knn_topk


def similarity_prompts(queries: DataFrame, texts: DataFrame, pool: DataFrame, shots: int,
                       templates: C.PromptTemplates, exclude_self: bool = False) -> DataFrame:
    """Prompts with the ``shots`` nearest examples each.

    ``queries`` and ``pool`` are (id, vector); ``texts`` has the columns the templates
    use for every id.  Tasks are the queries that have a text.
    """
    near = knn_topk(queries.select("id", "vector"), pool.select("id", "vector"), shots, exclude_self)
    chosen = near.select(F.col("query_id").alias("id"), "rank", "neighbor_id").join(
        texts.withColumnRenamed("id", "neighbor_id"), "neighbor_id").drop("neighbor_id")
    return C.build_prompts(texts.join(queries.select("id"), "id", "left_semi"), chosen, templates, task="id")


def with_available_context(prompts: DataFrame, max_context: int, max_new_tokens: int) -> DataFrame:
    """Add prompt tokens and what is left for documentation."""
    text = C.prompt_text(F.col("messages"))
    sized = prompts.withColumn("prompt_tokens", C.token_count(text))
    return sized.withColumn("available", C.available_context(max_context, F.col("prompt_tokens"), max_new_tokens))
