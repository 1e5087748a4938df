"""The experiment store on disk, and error analytics on small tables."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import diagnosis as D
from tallyforge.operators import store as T
from tallyforge.session import scratch_path

SCHEMAS = {"errors": "model_name string, phase string, eval_method string, error_type string",
           "results": "model_name string, eval_method string, metric string, k int, mean double",
           "best_params": "model_name string, optimizer_metric string, eval_method string, score double"}


def new_store(spark):
    place = scratch_path(spark, "store-test")
    return T.ExperimentStore(spark, "test_" + place.rsplit("-", 1)[1], place)


@pytest.fixture()
def store(spark):
    made = new_store(spark)
    made.setup("exp", SCHEMAS)
    made.append("exp", "errors", spark.createDataFrame(
        [("a", "testing", "hold_out", "syntax"), ("a", "validation", "hold_out", None), ("b", "testing", "3_fold", "tests")], SCHEMAS["errors"]))
    made.append("exp", "best_params", spark.createDataFrame([("a", "tests", "hold_out", 0.5)], SCHEMAS["best_params"]))
    return made


def test_setup_and_existence(store):
    assert store.exists("exp") and not store.exists("other")
    with pytest.raises(FileExistsError):
        store.setup("exp", SCHEMAS)
    assert [r.experiment for r in store.experiments().collect()] == ["exp"]


def test_upsert_replaces_the_same_key(spark, store):
    store.upsert_best_params(spark.createDataFrame([("a", "tests", "hold_out", 0.9), ("b", "tests", "hold_out", 0.1)], SCHEMAS["best_params"]), "exp")
    got = {r.model_name: r.score for r in store.read("exp", "best_params").collect()}
    assert got == {"a": 0.9, "b": 0.1}


def test_upsert_into_several_experiments(spark, store):
    store.setup("more", SCHEMAS)
    rows = spark.createDataFrame([("a", "tests", "hold_out", 0.7, "exp"), ("a", "tests", "hold_out", 0.8, "more"), ("a", "syntax", "hold_out", 0.9, "new")],
                                 SCHEMAS["best_params"] + ", experiment string")
    store.upsert_best_params(rows)
    assert {(r.experiment, r.optimizer_metric): r.score for r in store.read_all("best_params").collect()} == {
        ("exp", "tests"): 0.7, ("more", "tests"): 0.8, ("new", "syntax"): 0.9}


def test_changes_leave_other_experiments_alone(spark, store):
    store.setup("other", SCHEMAS)
    rows = spark.createDataFrame([("z", "testing", "hold_out", "syntax")], SCHEMAS["errors"])
    store.append("other", "errors", rows)
    store.rewrite("errors", store.read("exp", "errors").withColumn("error_type", F.lit("x")), ["exp"])
    store.delete("errors", F.col("phase") == "validation", "exp")
    store.append("exp", "errors", rows)
    assert [r.error_type for r in store.read("other", "errors").collect()] == ["syntax"]
    assert sorted(r.error_type for r in store.read("exp", "errors").collect()) == ["syntax", "x", "x"]


def test_emptied_experiments_stay(store):
    store.delete("errors", F.lit(True))
    assert store.read("exp", "errors").count() == 0 and store.exists("exp", "errors")


def test_missing_field_is_set_only_where_absent(store):
    store.set_missing_field("error_type", F.lit("unknown"), "exp")
    store.set_missing_field("version", F.lit(1))
    rows = store.read("exp", "errors").collect()
    assert sorted(r.error_type for r in rows) == ["syntax", "tests", "unknown"] and {r.version for r in rows} == {1}


def test_odd_names_are_one_folder(spark, store):
    name = "a:b=c/d% e[1]+'x\\y"
    store.setup(name, SCHEMAS)
    rows = spark.createDataFrame([("a", "testing", "hold_out", "syntax")], SCHEMAS["errors"])
    store.append(name, "errors", rows)
    assert store.read(name, "errors").first().experiment == name
    assert {r.experiment for r in store.read_all("errors").collect()} == {name, "exp"}
    loaded = new_store(spark)
    loaded.load("errors", rows.withColumn("experiment", F.lit(name)))
    assert loaded.exists(name) and loaded.read(name, "errors").count() == 1


def test_new_columns_and_failed_rewrites(spark, store):
    store.append("exp", "errors", spark.createDataFrame([("c", 7)], "model_name string, extra int"))
    assert {r.model_name: r.extra for r in store.read("exp", "errors").collect()} == {"a": None, "b": None, "c": 7}
    broken = store.read("exp", "errors").withColumn("bad", F.raise_error(F.lit("on purpose")).cast("int"))
    with pytest.raises(Exception, match="on purpose"):
        store.rewrite("errors", broken, ["exp"])
    assert store.read("exp", "errors").count() == 4


def test_cleaning_removes_what_breaks_a_rule(spark, store):
    store.append("exp", "results", spark.createDataFrame([("d", "hold_out", "tests", 1, 0.5), ("a", "3_fold", "tests", 1, 0.5)], SCHEMAS["results"]))
    store.append("exp", "errors", spark.createDataFrame([("e", "validation", "hold_out", "x")], SCHEMAS["errors"]))
    store.clean("hold_out", "exp")
    assert sorted((r.model_name, r.phase) for r in store.read("exp", "errors").collect()) == [("a", "validation"), ("b", "testing")]
    assert [(r.model_name, r.eval_method) for r in store.read("exp", "results").collect()] == [("a", "3_fold")]


def test_delete_keeps_rows_with_null_tests(store):
    store.delete("errors", T.matches({"error_type": "syntax"}), "exp")
    assert sorted(str(r.error_type) for r in store.read("exp", "errors").collect()) == ["None", "tests"]


def test_drop_and_copy(store):
    assert store.copy_errors("exp", "copy") and not store.copy_errors("exp", "copy")
    assert store.read("copy", "errors").count() == 3
    store.drop("exp", "results")
    assert store.exists("exp")
    store.drop("exp")
    assert not store.exists("exp") and store.exists("copy")


def test_export_messages(spark, store, tmp_path):
    assert store.export("exp", "results", str(tmp_path / "r")) == "No data found."
    assert "Invalid format" in store.export("exp", "errors", str(tmp_path / "x"), "xml")
    assert not (tmp_path / "x").exists() and not (tmp_path / "r").exists()
    store.export("exp", "errors", str(tmp_path / "e"), "csv", ("phase",))
    back = spark.read.csv(str(tmp_path / "e"), header=True)
    assert back.columns == ["model_name", "eval_method", "error_type"] and back.count() == 3


def test_quality_checks_per_model(spark):
    errors = spark.createDataFrame([("e", "a", "validation", "hold_out"), ("e", "b", "testing", "hold_out"), ("e", "c", "testing", "hold_out"),
                                    ("e", "z", "testing", "3_fold")], "experiment string, model_name string, phase string, eval_method string")
    results = spark.createDataFrame([("e", "c", "hold_out"), ("e", "d", "hold_out")], "experiment string, model_name string, eval_method string")
    params = spark.createDataFrame([("e", "c", "hold_out"), ("e", "b", "hold_out")], "experiment string, model_name string, eval_method string")
    got = {r.model_name: r for r in T.quality_checks(errors, results, params, "hold_out").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"].orphan_validation and got["b"].orphan_testing and got["d"].results_without_params and got["c"].passed
    relaxed = {r.model_name: r.passed for r in T.quality_checks(errors, results, params, "hold_out", ignore_best_params=True).collect()}
    assert relaxed == {"a": False, "b": False, "c": True, "d": True}


def test_rerun_plan_cleans_on_request(spark):
    keys = "experiment string, model_name string, eval_method string"
    requested = spark.createDataFrame([("e", "a", "hold_out"), ("e", "b", "hold_out")], keys)
    stored = spark.createDataFrame([("e", "a", "hold_out")] * 2, keys)
    errors = spark.createDataFrame([("e", m, "hold_out", "testing") for m in "aab"], keys + ", phase string")
    plan = lambda rerun: {r.model_name: (r.action, r.delete_stored, r.delete_errors)
                          for r in T.rerun_plan(requested, stored, errors, "testing", rerun).collect()}
    assert plan(False) == {"a": ("skip", 0, 0), "b": ("run", 0, 1)}
    assert plan(True) == {"a": ("run", 2, 2), "b": ("run", 0, 1)}


def test_union_of_ragged_tables(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "t")], "x int, y string")
    assert sorted((r.x, r.y) for r in T.union_experiments([a, b]).collect()) == [(1, None), (2, "t")]


def test_category_counts_of_every_column_type(spark):
    df = spark.createDataFrame([(["a", "b"], "x, y", 1), (["a"], "x", None), (None, None, 1)], "arr array<string>, txt string, num int")
    counts = lambda c: {r.category: (r["count"], round(r.percentage, 1)) for r in D.category_counts(df, c).collect()}
    assert counts("arr") == {"a": (2, 50.0), "b": (1, 25.0), "None": (1, 25.0)}
    assert counts("txt") == {"x": (2, 50.0), "y": (1, 25.0), "None": (1, 25.0)}
    assert counts("num") == {"1": (2, 66.7), "None": (1, 33.3)}


def test_keyed_shares_keep_null_keys(spark):
    df = spark.createDataFrame([("m", "a"), ("m", "b"), (None, "a")], "model string, c string")
    got = {(r.model, r.category): r.percentage for r in D.category_counts(df, "c", ["model"]).collect()}
    assert got == {("m", "a"): 50.0, ("m", "b"): 50.0, (None, "a"): 100.0}


def test_row_percentages_sum_to_one_hundred(spark):
    rows = [("m", "signature", "Pass", 1, 1, 1, 0), ("m", "signature", "Tests", 0, 0, 0, 0), ("m", "regular", "Pass", 2, None, 1, 3)]
    df = spark.createDataFrame(rows, "model string, prompt string, initial string, Pass long, Tests long, Semantic long, Syntax long")
    got = {(r.prompt, r.initial): (r.Pass, r.Tests, r.Semantic, r.Syntax) for r in D.transition_row_pct(df, ["model", "prompt"]).collect()}
    assert got[("signature", "Pass")] == ("1 (33.3%)", "1 (33.3%)", "1 (33.4%)", "0 (0.0%)")
    assert got[("signature", "Tests")] == ("0 (—)",) * 4
    assert got[("regular", "Pass")] == ("2 (33.3%)", None, "1 (16.7%)", "3 (50.0%)")


def test_refinement_outcomes_skip_unknown_labels(spark):
    rows = [("m", "regular", 0, "Tests", ""), ("m", "regular", 1, "Syntax", ""), ("m", "signature", 2, "Odd", ""), ("m", "signature", 3, "Syntax", "Tests")]
    df = spark.createDataFrame(rows, "model string, prompt string, refinements_performed int, initial_error_category string, final_error_category string")
    got = {r.prompt: (r.total, r.improved, r.final_pass, r.ref3) for r in D.refinement_summary(df, ["model", "prompt"]).collect()}
    assert got == {"regular": (1, 1, 1, 0), "signature": (1, 1, 0, 1)}


def test_funnel_adds_up(spark):
    df = spark.createDataFrame([("m", t) for t in ["syntax"] * 3 + ["semantic"] * 2 + ["tests"]], "model_name string, error_type string")
    got = {(r.source, r.target): r.value for r in D.error_funnel(df).collect()}
    assert got[("Total Candidates", "Syntax Valid")] == 3 and got[("Syntax Valid", "Semantic Valid")] == 1
    assert got[("Semantic Valid", "Tests Passed")] == 0 and got[("Semantic Valid", "Tests Error")] == 1
