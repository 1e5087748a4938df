"""Run files: one record per execution, candidates nested by task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: output tokens added to the largest prompt when a run record is repaired.
OUTPUT_ALLOWANCE = 2012


def explode_runs(runs: DataFrame) -> DataFrame:
    """One row per (run, task, candidate); candidates count from 1."""
    keep = [c for c in runs.columns if c != "task_candidates"]
    by_task = runs.select(*keep, F.explode("task_candidates").alias("task_id", "__candidates"))
    return by_task.select(
        *keep, F.col("task_id").try_cast("long").alias("task_id"),
        F.posexplode("__candidates").alias("__pos", "code"),
    ).withColumn("candidate_id", F.col("__pos") + 1).drop("__pos")


def normalize_refined_runs(refined: DataFrame) -> DataFrame:
    """Runs whose candidates are refinement records, reduced to the final programs."""
    return refined.withColumn("task_candidates", F.transform_values(
        "task_candidates", lambda _, cands: F.transform(cands, lambda c: c["final_code_candidate"])))


def repair_run_records(runs: DataFrame) -> DataFrame:
    """Fix records whose candidate entry is ``[candidates, context]``.

    Keeps the candidate list, and sets ``largest_context`` to the largest context
    found plus the output allowance.  Sound entries and records pass unchanged.
    """
    def pair_context(entry: Column) -> Column:
        second = F.try_variant_get(entry, "$[1]", "variant")
        is_pair = (F.schema_of_variant(second) == "BIGINT") & F.try_variant_get(entry, "$[2]", "variant").isNull()
        return F.when(is_pair, F.try_variant_get(entry, "$[1]", "long"))

    entries = F.map_values("task_candidates")
    largest = F.array_max(F.transform(entries, pair_context))
    fixed = F.transform_values("task_candidates", lambda _, v: F.when(
        pair_context(v).isNotNull(), F.try_variant_get(v, "$[0]", "array<string>")
    ).otherwise(F.try_variant_get(v, "$", "array<string>")))
    return runs.select(
        *[c for c in runs.columns if c not in ("task_candidates", "largest_context")],
        F.coalesce(largest + OUTPUT_ALLOWANCE, F.col("largest_context")).alias("largest_context"),
        fixed.alias("task_candidates"))
