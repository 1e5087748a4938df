"""pass@k, roll-ups and best parameters on hand-computed cases."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions.passk import pass_at_k
from tallyforge.functions.rounding import round_half_even
from tallyforge.operators import scoring as S
from tallyforge.plans import experiments as P


def _estimate(n, c, k):
    return 1.0 - math.comb(n - c, k) / math.comb(n, k)


@pytest.mark.parametrize("n,c,k,value", [(10, 0, 5, 0.0), (10, 3, 5, 0.916667), (10, 10, 1, 1.0), (10, 7, 5, 1.0)])
def test_pass_at_k_fixed_cases(spark, n, c, k, value):
    got = spark.range(1).select(pass_at_k(F.lit(n), F.lit(c), k).alias("v")).first().v
    assert got == pytest.approx(value, abs=1e-6)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 60)), min_size=1, max_size=40), st.integers(1, 50))
def test_pass_at_k_equals_the_closed_form(spark, pairs, k):
    pairs = [(n, min(c, n)) for n, c in pairs]
    df = spark.createDataFrame(pairs, "n long, c long").select("n", "c", pass_at_k("n", "c", k).alias("v"))
    for r in df.collect():
        assert (r.v is None) if r.n < k else r.v == pytest.approx(_estimate(r.n, r.c, k), abs=1e-9)


def test_cost_does_not_grow_with_attempts(spark):
    got = spark.range(1).select(pass_at_k(F.lit(10 ** 12), F.lit(10 ** 11), 2).alias("v")).first().v
    assert got == pytest.approx(1 - 0.9 ** 2, abs=1e-9)


def _attempts(spark, rows):
    return spark.createDataFrame(rows, "model string, fold int, seed int, task_id int, error_type string")


def test_short_task_suppresses_k_for_the_run(spark):
    rows = [("m", 0, 3, 1, None)] * 10 + [("m", 0, 3, 2, None)] * 4
    scores = P.run_scores(_attempts(spark, rows), ["model", "fold", "seed"], (1, 2, 5)).collect()
    assert {r.k for r in scores} == {1, 2}


def test_all_pass_gives_one_everywhere(spark):
    rows = [("m", f, s, t, None) for f in range(3) for s in (3, 75) for t in range(4) for _ in range(10)]
    table = P.evaluate_experiments(_attempts(spark, rows), ["model"]).collect()
    assert len(table) == 3 * 5 and all((r["mean"], r["std"]) == (1.0, 0.0) for r in table)


def test_cascade_takes_the_first_failure(spark):
    good = '{"num_tests": 1, "num_passed": 1, "test_results": []}'
    bad = '{"num_tests": 2, "num_passed": 1, "test_results": []}'
    rows = [(1, "", "Parsing failed: x", 0, good), (2, "an Error here", "", 0, good), (3, "", "", 1, good),
            (4, "", "", 0, bad), (5, "", "", 0, "no json"), (6, "", "", 0, f"noise {good} noise"), (7, "", "", 0, "")]
    df = spark.createDataFrame(rows, "id int, stdout string, stderr string, returncode int, tests_stdout string")
    got = {r.id: r.error_type for r in S.with_error_type(df).collect()}
    assert got == {1: "syntax", 2: "semantic", 3: "semantic", 4: "tests", 5: "tests", 6: None, 7: "tests"}
    scored = S.score_candidates(df).filter("id = 2").collect()
    assert {r.metric: (r.passed, r.error_type) for r in scored} == {
        "syntax": (True, None), "semantic": (False, "semantic"), "tests": (False, "semantic")}


def test_rounding_is_half_even_on_the_scaled_value(spark):
    got = spark.createDataFrame([(2.675,), (0.125,), (0.135,)], "v double").select(round_half_even("v").alias("r")).collect()
    assert [r.r for r in got] == [2.68, 0.12, round(0.135 * 100) / 100]


def test_fold_means_are_rounded_before_the_folds_are_merged(spark):
    rows = [("m", f, "tests", 1, v) for f, v in ((0, 0.333), (1, 0.333), (2, 0.336))]
    per_fold = S.mean_std_runs(spark.createDataFrame(rows, "model string, fold int, metric string, k int, value double"),
                               ["model", "fold", "metric", "k"])
    got = S.mean_std_folds(per_fold, ["model", "metric", "k"]).first()
    assert (got["mean"], got["std"]) == (0.33, 0.0)


def test_models_without_all_folds_are_left_out(spark):
    rows = [("a", f, "tests", 1, 0.5, 0.0) for f in range(3)] + [("b", f, "tests", 1, 0.5, 0.0) for f in range(2)]
    df = spark.createDataFrame(rows, "model string, fold int, metric string, k int, mean double, std double")
    assert [r.model for r in S.mean_std_folds(df, ["model", "metric", "k"]).collect()] == ["a"]


def test_best_params_first_wins_and_default(spark):
    rows = [("a", 0, 0.2, 10, 0.5), ("a", 1, 0.6, 50, 0.7), ("a", 2, 0.9, 100, 0.7), ("b", 0, 0.9, 100, 0.0)]
    df = spark.createDataFrame(rows, "model string, grid_pos int, temperature double, top_k int, value double")
    got = {r.model: (r.temperature, r.top_k, r.score) for r in S.best_params(df, ["model"], ["temperature", "top_k"]).collect()}
    assert got == {"a": (0.6, 50, 0.7), "b": (0.2, 10, 0.0)}


def test_grid_without_top_k_uses_minus_one(spark):
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    rows = S.hyperparam_grid(models, [0.2, 0.6], [0.5]).collect()
    assert len(rows) == 4 and {r.top_k for r in rows} == {-1}
    assert "CartesianProduct" not in S.hyperparam_grid(models, [0.2], [0.5])._jdf.queryExecution().toString()


def test_containment_compares_untrimmed_parts(spark):
    rows = [(1, 1, "a,b", "b,a,c"), (1, 1, "a,b", "a, b")]
    df = spark.createDataFrame(rows, "run int, task_id int, truth string, answer string")
    got = S.containment_counts(df, ["run"]).first()
    assert (got.n, got.c) == (2, 1)


def test_set_f1_zero_division(spark):
    df = spark.createDataFrame([(1, 1, 1, "", ""), (2, 1, 1, "a, b", "b"), (3, 1, 2, "a", "wrong"), (3, 1, 1, "a", "a")],
                               "run int, task_id int, candidate_id int, truth string, answer string")
    got = {r.run: r.f1 for r in S.set_f1(df, ["run"]).collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(2 / 3) and got[3] == 1.0


def test_tests_and_parameters_of_every_task(spark):
    candidates = spark.createDataFrame([(1, "a"), (2, "b")], "task_id int, code string")
    modules = spark.createDataFrame([(1, "t")], "task_id int, tests_module string")
    assert {r.task_id: r.code for r in S.attach_tests(candidates, modules).collect()} == {1: "a\nt", 2: "b\n"}
    stored = spark.createDataFrame([("m", 7, 2), ("m", 5, 1)], "model string, top_k int, pos int")
    models = spark.createDataFrame([("m",), ("x",)], "model string")
    assert {r.model: r.top_k for r in S.best_params_for_model(models, stored, ["model"], "pos").collect()} == {"m": 5, "x": None}


def test_seed_union_of_numbers_and_arrays(spark):
    flat = spark.createDataFrame([("a", 3), ("a", 75), ("a", 3)], "m string, seed int")
    nested = spark.createDataFrame([("a", [3, 75]), ("a", [346, 3])], "m string, seed array<int>")
    assert S.seed_union(flat, ["m"]).first().seeds == [3, 75]
    assert S.seed_union(nested, ["m"]).first().seeds == [3, 75, 346]


def test_nested_and_flat_metrics_round_trip(spark):
    df = spark.createDataFrame([("a", "syntax", 1, 0.5), ("a", "tests", 5, 0.25)], "m string, metric string, k int, value double")
    nested = S.nest_metrics(df, ["m"])
    assert nested.first().metric_results == {"pass@k_syntax": {"pass@1": 0.5}, "pass@k_tests": {"pass@5": 0.25}}
    assert {(r.name, r.value) for r in S.flatten_metrics(nested, ["m"]).collect()} == {("syntax@1", 0.5), ("tests@5", 0.25)}


def test_fallback_when_the_last_metric_scored_nothing(spark):
    rows = [("a", "tests", 1, 0.0), ("a", "semantic", 2, 0.4), ("b", "tests", 3, 0.1), ("b", "semantic", 4, 0.9), ("c", "semantic", 5, 0.2)]
    df = spark.createDataFrame(rows, "model string, metric string, top_k int, score double")
    got = {r.model: (r.metric, r.top_k) for r in S.best_params_fallback(df, ["model"], ["top_k"]).collect()}
    assert got == {"a": ("semantic", 2), "b": ("tests", 3), "c": ("semantic", 5)}


def test_validation_winner(spark):
    rows = [("m", 0.2, 0, t, None if t else "tests") for t in range(2)] + [("m", 0.6, 1, t, None) for t in range(2)]
    df = spark.createDataFrame(rows, "model string, temperature double, grid_pos int, task_id int, error_type string")
    got = P.validation_winners(df, ["model"], ["temperature"], "tests").first()
    assert (got.temperature, got.score) == (0.6, 1.0)


def test_layout_rows_of_the_result_table(spark):
    rows = [("m", f, s, t, 0.5 if t else None) for f in range(3) for s in (3, 75) for t in range(3)]
    df = spark.createDataFrame(rows, "model string, fold int, seed int, task_id int, layout_score double")
    got = P.layout_results(df, ["model"]).first()
    assert (got.metric, got.k, got["mean"], got["std"]) == ("nodes", "flow", 0.5, 0.0)


def test_other_defaults(spark):
    df = spark.createDataFrame([("a", 0, 0.9, 0.0)], "model string, grid_pos int, temperature double, value double")
    got = S.best_params(df, ["model"], ["temperature"], defaults={"temperature": 0.5}).first()
    assert (got.temperature, got.score) == (0.5, 0.0)


def test_unknown_model_has_no_token_figure(spark):
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    table = spark.createDataFrame([("a", 7)], "model string, max_tokens int")
    assert S.tokens_of_models(models.filter("model = 'a'"), table).first().max_tokens == 7
    with pytest.raises(Exception, match="no token figure for model: b"):
        S.tokens_of_models(models, table).collect()
    assert [r.model for r in S.models_without_tokens(models, table).collect()] == ["b"]
