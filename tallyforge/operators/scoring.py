"""From checker outputs to pass@k: scoring cascade, task counts, roll-ups, best parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import errors as E
from tallyforge.functions.passk import pass_at_k as pass_at_k_column
from tallyforge.functions.rounding import round_half_even

METRICS = ("syntax", "semantic", "tests")

# What each metric takes for a failure, along the cascade.
_FAILS = {"syntax": ("syntax",), "semantic": ("syntax", "semantic"), "tests": ("syntax", "semantic", "tests")}

# Parameters used when no validation run scored above zero.
DEFAULT_PARAMS = {"temperature": 0.2, "top_p": 0.6, "top_k": 10, "seed": 9}


def with_error_type(outputs: DataFrame) -> DataFrame:
    """Add ``error_type``, the first failed stage of the cascade, null when all passed.

    Needs ``stdout, stderr, returncode`` of the build and ``tests_stdout`` of the tests.
    """
    lowered = F.col("__lowered")
    kind = (F.when(E.names_syntax_error(lowered), "syntax")
            .when((F.col("returncode") == 1) | lowered.contains("error"), "semantic")
            .when(~E.all_tests_passed(E.test_result(F.col("tests_stdout"), E.TEST_TOTALS)), "tests"))
    # A column of its own, so that both streams are lowered once per row.
    staged = outputs.withColumn("__lowered", E.lowered_output(F.col("stdout"), F.col("stderr")))
    return staged.withColumn("error_type", kind).drop("__lowered")


def passed(metric: str, error_type: str = "error_type") -> Column:
    """Whether a candidate passes a metric, given its first failed stage."""
    return ~F.coalesce(F.col(error_type), F.lit("")).isin(*_FAILS[metric])


def score_candidates(outputs: DataFrame) -> DataFrame:
    """One row per candidate and metric with ``passed`` and the stage that failed.

    The checker outputs are read once for all metrics.
    """
    staged = outputs if "error_type" in outputs.columns else with_error_type(outputs)
    heavy = {"stdout", "stderr", "returncode", "tests_stdout", "error_type"}
    keep = [c for c in staged.columns if c not in heavy]
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), passed(m).alias("passed"),
                 F.when(~passed(m), F.col("error_type")).alias("error_type")) for m in METRICS]))
    return staged.select(*keep, rows.alias("__row")).select(*keep, "__row.*")


def task_counts(candidates: DataFrame, run_keys: Sequence[str], task: str = "task_id",
                metrics: Sequence[str] = METRICS) -> DataFrame:
    """Attempts ``n`` and passes ``c`` per (run, task, metric).

    Counts all metrics in one aggregation, partially before the shuffle, and only
    then turns them into rows.
    """
    counted = candidates.groupBy(*run_keys, task).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(passed(m)).alias(m) for m in metrics])
    return counted.unpivot([*run_keys, task, "n"], list(metrics), "metric", "c")


def pass_at_k(counts: DataFrame, run_keys: Sequence[str], ks: Sequence[int] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Mean pass@k over the tasks of a run, in long form ``(run, metric, k, value)``.

    A ``k`` is given for a run only if every task has at least ``k`` attempts.
    """
    keys = [*run_keys, "metric"]
    means = counts.groupBy(*keys).agg(
        F.min("n").alias("__min_n"),
        *[F.avg(pass_at_k_column("n", "c", k)).alias(f"__k{k}") for k in ks])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__k{k}").alias("value")) for k in ks]))
    return (means.select(*keys, "__min_n", cells.alias("__cell"))
            .filter(F.col("__min_n") >= F.col("__cell.k"))
            .select(*keys, "__cell.k", "__cell.value"))


def containment_counts(candidates: DataFrame, run_keys: Sequence[str], task: str = "task_id",
                       truth: str = "truth", answer: str = "answer") -> DataFrame:
    """Task counts where a candidate passes if it names every label of the truth.

    Both sides are comma lists; the parts are compared as they are, untrimmed.
    """
    missing = F.array_except(F.split(truth, ","), F.split(answer, ","))
    return (candidates.groupBy(*run_keys, task)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(missing) == 0).alias("c"))
            .withColumn("metric", F.lit("containment")))


def set_f1(answers: DataFrame, run_keys: Sequence[str], task: str = "task_id", position: str = "candidate_id",
           truth: str = "truth", answer: str = "answer") -> DataFrame:
    """Mean F1 of the first candidate of each task, by ``position``, against the truth, both as word sets."""
    first = answers.groupBy(*run_keys, task).agg(F.min_by(F.struct(truth, answer), position).alias("__first"))
    answers = first.select(*run_keys, "__first.*")

    def words(name: str) -> Column:
        tokens = F.split(F.replace(F.col(name), F.lit(","), F.lit("")), r"\s+")
        return F.array_distinct(F.filter(tokens, lambda w: w != ""))

    a, b = words(truth), words(answer)
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    f1 = F.when(total == 0, F.lit(0.0)).otherwise(2.0 * both / F.nullif(total, F.lit(0)))
    return answers.groupBy(*run_keys).agg(F.avg(f1).alias("f1"))


def mean_std_runs(scores: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and population deviation over the runs of a key, both to two digits."""
    return scores.groupBy(*keys).agg(
        round_half_even(F.avg(value)).alias("mean"), round_half_even(F.stddev_pop(value)).alias("std"))


def mean_std_folds(fold_means: DataFrame, keys: Sequence[str], folds: int = 3, fold: str = "fold",
                   model_keys: Sequence[str] | None = None) -> DataFrame:
    """Mean and deviation over folds of the already rounded fold means.

    Models without all ``folds`` are left out; ``model_keys`` says what a model is
    (default: the keys without metric and k).
    """
    model_keys = list(model_keys or [k for k in keys if k not in ("metric", "k")])
    # Folds, metrics and ks of one model: a handful of rows, already aggregated.
    seen = F.size(F.collect_set(fold).over(Window.partitionBy(*model_keys)))
    complete = fold_means.withColumn("__folds", seen).filter(F.col("__folds") == folds)
    return complete.groupBy(*keys).agg(
        round_half_even(F.avg("mean")).alias("mean"), round_half_even(F.stddev_pop("mean")).alias("std"))


def seed_union(runs: DataFrame, keys: Sequence[str], seed: str = "seed") -> DataFrame:
    """Distinct seeds per key in order; ``seed`` may be a number or an array of numbers."""
    nested = runs.schema[seed].dataType.typeName() == "array"
    flat = runs.select(*keys, (F.explode(seed) if nested else F.col(seed)).alias("__seed")).distinct()
    return flat.groupBy(*keys).agg(F.sort_array(F.collect_set("__seed")).alias("seeds"))


def deviation(scores: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Unrounded mean and population deviation of each value column over runs."""
    return scores.groupBy(*keys).agg(*[
        f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def best_params(grid_scores: DataFrame, keys: Sequence[str], params: Sequence[str], score: str = "value",
                position: str = "grid_pos", defaults: dict | None = None) -> DataFrame:
    """Parameters of the best run per key; the earliest run wins a tie.

    Keys where nothing scores above zero get the default parameters with score 0.
    """
    fallback = DEFAULT_PARAMS if defaults is None else defaults
    ranked = F.struct(F.col(score).alias("score"), (-F.col(position)).alias("__pos"),
                      *[F.col(p) for p in params])
    best = grid_scores.groupBy(*keys).agg(F.max(F.when(F.col(score) > 0, ranked)).alias("__best"))
    return best.select(*keys, *[
        F.when(F.col("__best").isNull(), F.lit(fallback.get(p))).otherwise(F.col("__best")[p]).alias(p)
        for p in params], F.coalesce(F.col("__best")["score"], F.lit(0.0)).alias("score"))


def best_params_for_model(models: DataFrame, stored: DataFrame, on: Sequence[str], position: str) -> DataFrame:
    """Look up stored parameters, the first by ``position`` where there are several; a model without any keeps nulls."""
    others = [c for c in stored.columns if c not in on and c != position]
    first = stored.groupBy(*on).agg(F.min_by(F.struct(*others), position).alias("__first")).select(*on, "__first.*")
    return models.join(first, list(on), "left")


def best_params_fallback(per_metric: DataFrame, keys: Sequence[str], params: Sequence[str],
                         last: str = "tests", fallback: str = "semantic") -> DataFrame:
    """Parameters of the last metric, or of the fallback metric if the last scored 0."""
    def pick(metric: str) -> Column:
        chosen = F.struct(*[F.col(p) for p in params], F.col("score"))
        return F.max(F.when(F.col("metric") == metric, chosen))

    both = per_metric.groupBy(*keys).agg(pick(last).alias("__last"), pick(fallback).alias("__fallback"))
    use_fallback = F.col("__last").isNull() | (F.col("__last.score") == 0.0)
    return both.select(*keys, F.when(use_fallback, fallback).otherwise(last).alias("metric"), *[
        F.when(use_fallback, F.col(f"__fallback.{p}")).otherwise(F.col(f"__last.{p}")).alias(p)
        for p in [*params, "score"]])


def hyperparam_grid(models: DataFrame, temperatures: Sequence[float], top_ps: Sequence[float],
                    top_ks: Sequence[int] = ()) -> DataFrame:
    """Every parameter combination for each model, numbered in search order.

    The combinations are one array literal, so no join is involved.
    """
    cells = [(t, k, p) for t in temperatures for k in (list(top_ks) or [-1]) for p in top_ps]
    literal = F.array(*[
        F.struct(F.lit(i).alias("grid_pos"), F.lit(t).alias("temperature"), F.lit(k).alias("top_k"),
                 F.lit(p).alias("top_p")) for i, (t, k, p) in enumerate(cells)])
    return models.select("*", F.explode(literal).alias("__cell")).select(*models.columns, "__cell.*")


def attempt_seed(seed: str = "seed", candidate: str = "candidate_id") -> Column:
    return F.col(seed) * F.col(candidate)


def flatten_metrics(results: DataFrame, keys: Sequence[str], column: str = "metric_results") -> DataFrame:
    """``map<metric, map<name, value>>`` to long rows named like ``syntax@1``."""
    outer = results.select(*keys, F.explode(column).alias("__metric", "__cells"))
    inner = outer.select(*keys, "__metric", F.explode("__cells").alias("__name", "value"))
    return inner.select(*keys, flat_name(F.col("__metric"), F.col("__name")).alias("name"), "value")


def flat_name(metric: Column, name: Column) -> Column:
    suffix = F.when(name.contains("@"), F.split_part(name, F.lit("@"), F.lit(2))).otherwise(name)
    prefix = F.replace(metric, F.lit("pass@k_"), F.lit(""))
    return F.concat(prefix, F.lit("@"), suffix)


def nest_metrics(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long scores to ``map<pass@k_metric, map<pass@k, value>>`` per key.

    The cells of one key are metrics times k, a set fixed by the request.
    """
    inner = scores.groupBy(*keys, "metric").agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat(F.lit("pass@"), F.col("k").cast("string")), "value"))).alias("__cells"))
    return inner.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat(F.lit("pass@k_"), "metric"), "__cells"))).alias("metric_results"))


def pivot_scores(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str], ks: Sequence[int],
                 value: str = "value") -> DataFrame:
    """One row per key with columns ``metric@k``; the column set is given, so no extra scan."""
    cells = [f"{m}@{k}" for m in metrics for k in ks]
    named = scores.withColumn("__cell", F.concat("metric", F.lit("@"), F.col("k").cast("string")))
    return named.groupBy(*keys).pivot("__cell", cells).agg(F.first(value))


def skip_failed_attempts(candidates: DataFrame, failures: DataFrame,
                         on: Sequence[str] = ("task_id", "candidate_id")) -> DataFrame:
    """Candidates without a syntax or semantic error."""
    bad = failures.filter(F.col("error_type").isin("syntax", "semantic")).select(*on).distinct()
    return candidates.join(bad, list(on), "left_anti")


def attach_tests(candidates: DataFrame, modules: DataFrame, task: str = "task_id") -> DataFrame:
    """Candidate program followed by the tests module of its task; a task without one adds an empty module."""
    return (candidates.join(modules.select(task, "tests_module"), task, "left")
            .withColumn("code", F.concat("code", F.lit("\n"), F.coalesce("tests_module", F.lit("")))).drop("tests_module"))


def max_tokens_per_model(responses: DataFrame, tokens: Column, model: str = "model") -> DataFrame:
    return responses.groupBy(model).agg(F.max(tokens).alias("max_tokens"))


def upsert_model_tokens(table: DataFrame, fresh: DataFrame, model: str = "model") -> DataFrame:
    return table.join(fresh, model, "left_anti").unionByName(fresh)


def models_without_tokens(models: DataFrame, table: DataFrame, model: str = "model") -> DataFrame:
    return models.select(model).distinct().join(table, model, "left_anti")


def tokens_of_models(models: DataFrame, table: DataFrame, model: str = "model", tokens: str = "max_tokens") -> DataFrame:
    """Token figure of each model; a model that is not in the table is an error."""
    unknown = F.raise_error(F.concat(F.lit("no token figure for model: "), F.col(model))).cast("long")
    found = models.join(table.select(model, tokens), model, "left")
    return found.withColumn(tokens, F.coalesce(F.col(tokens).cast("long"), unknown))


def largest_context(prompts: DataFrame, run_keys: Sequence[str], sizes: Sequence[Column], output: Column) -> DataFrame:
    """Largest prompt-plus-output token count of a run over all its steps."""
    step = reduce(lambda a, b: F.greatest(a, b), [s + output for s in sizes])
    return prompts.groupBy(*run_keys).agg(F.max(step).alias("largest_context"))
