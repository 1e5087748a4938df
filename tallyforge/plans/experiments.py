"""Whole reports as single plans over all experiments, models, folds and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import diagnosis as D
from tallyforge.operators import layout as L
from tallyforge.operators import scoring as S

KS = (1, 2, 3, 5, 10)


def run_scores(outputs: DataFrame, run_keys: Sequence[str], ks: Sequence[int] = KS) -> DataFrame:
    """pass@k per run and metric straight from checker outputs (two shuffles: task, run)."""
    staged = outputs if "error_type" in outputs.columns else S.with_error_type(outputs)
    return S.pass_at_k(S.task_counts(staged, run_keys), run_keys, ks)


def evaluate_experiments(outputs: DataFrame, experiment_keys: Sequence[str], folds: int = 3, seed: str = "seed",
                         fold: str = "fold", ks: Sequence[int] = KS) -> DataFrame:
    """Result table: mean and deviation over folds of the rounded seed means, per metric and k.

    Covers every experiment in one plan; models without all folds are left out.
    """
    keys = list(experiment_keys)
    scores = run_scores(outputs, [*keys, fold, seed], ks)
    per_fold = S.mean_std_runs(scores, [*keys, fold, "metric", "k"])
    return S.mean_std_folds(per_fold, [*keys, "metric", "k"], folds, fold, keys)


def hold_out_results(outputs: DataFrame, experiment_keys: Sequence[str], seed: str = "seed",
                     ks: Sequence[int] = KS) -> DataFrame:
    """Result table without folds: mean and deviation over seeds."""
    keys = list(experiment_keys)
    return S.mean_std_runs(run_scores(outputs, [*keys, seed], ks), [*keys, "metric", "k"])


def layout_results(scores: DataFrame, experiment_keys: Sequence[str], folds: int = 3, seed: str = "seed",
                   fold: str = "fold", score: str = "layout_score") -> DataFrame:
    """The ``nodes@flow`` rows of the result table, rolled up like the other metrics.

    ``scores`` has one row per candidate; candidates that failed have no score.
    """
    keys = list(experiment_keys)
    runs = L.nodes_at_flow(scores, [*keys, fold, seed], score=score).withColumns(
        {"metric": F.lit("nodes"), "k": F.lit("flow")})
    per_fold = S.mean_std_runs(runs, [*keys, fold, "metric", "k"], "nodes_at_flow")
    return S.mean_std_folds(per_fold, [*keys, "metric", "k"], folds, fold, keys)


def validation_winners(outputs: DataFrame, model_keys: Sequence[str], params: Sequence[str], metric: str,
                       k: int = 1, position: str = "grid_pos") -> DataFrame:
    """Best parameters of a validation grid by one metric."""
    keys = [*model_keys, *params, position]
    scores = run_scores(outputs, keys, [k]).filter(F.col("metric") == metric)
    return S.best_params(scores, model_keys, params, position=position)


def error_report(errors: DataFrame, metric: str, keys: Sequence[str], top: int = 5,
                 parsing_tokens: bool = False) -> DataFrame:
    """The largest error categories of every panel in one plan."""
    return D.top_categories(D.category_comparison(errors, metric, keys, parsing_tokens), keys, top)
