"""Queries: the experiment store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import store as T
from tallyforge.session import scratch_path
from workload import views as V
from workload.registry import query

# Three tables out of events: two experiments, errors for all, results and parameters for some models.
_BASE = """base AS (SELECT event_id, concat('m', cast(user_id % 7 AS string)) AS model_name,
        CASE WHEN user_id % 2 = 0 THEN 'regular_5_shot' ELSE 'signature_5_shot' END AS experiment,
        CASE event_id % 3 WHEN 0 THEN 'hold_out' ELSE '3_fold' END AS eval_method,
        CASE WHEN event_id % 5 = 0 THEN 'validation' ELSE 'testing' END AS phase, event_type, value, user_id FROM {source})"""
_ERRORS = """SELECT event_id, experiment, model_name, eval_method, phase, event_type AS error_type FROM base
        WHERE event_type IN ('error', 'view', 'signup') AND NOT (model_name = 'm6' AND phase = 'testing')"""
_RESULTS = """SELECT experiment, model_name, eval_method, 'tests' AS metric, cast(event_id % 3 AS int) AS k, round(max(value), 2) AS mean
        FROM base WHERE model_name NOT IN ('m1', 'm2') GROUP BY experiment, model_name, eval_method, event_id % 3"""
_PARAMS = """SELECT experiment, model_name, 'tests' AS optimizer_metric, eval_method, round(max(value), 2) AS score
        FROM base WHERE model_name NOT IN ('m2', 'm3') AND eval_method = 'hold_out' GROUP BY experiment, model_name, eval_method"""
_TABLES = f"""WITH {_BASE.format(source='events')}, errors AS ({_ERRORS}), results AS ({_RESULTS}), params AS ({_PARAMS})"""


def _tables(spark, d):
    V.table(spark, d, "events").createOrReplaceTempView("tallyforge_store_events")
    base = _BASE.format(source="tallyforge_store_events")
    return {kind: spark.sql(f"WITH {base} {sql}")
            for kind, sql in (("errors", _ERRORS), ("results", _RESULTS), ("best_params", _PARAMS))}


def _new_store(spark) -> T.ExperimentStore:
    place = scratch_path(spark, "store")
    return T.ExperimentStore(spark, "tallyforge_" + place.rsplit("-", 1)[1], place)


def _store(spark, d) -> T.ExperimentStore:
    """The three tables written into a new store, one partition per experiment."""
    store = _new_store(spark)
    for kind, rows in _tables(spark, d).items():
        store.load(kind, rows)
    return store


EXPERIMENTS = ("regular_5_shot", "signature_5_shot")


@query("union_experiments", f"""{_TABLES} SELECT event_id, model_name, eval_method, phase, error_type, experiment, NULL AS fold FROM errors
    WHERE experiment = 'regular_5_shot' UNION ALL
    SELECT event_id, model_name, eval_method, phase, error_type, experiment, event_id % 3 FROM errors WHERE experiment = 'signature_5_shot'""")
def union_experiments(spark, d):
    store = _store(spark, d)
    first, second = (store.read(e, "errors") for e in EXPERIMENTS)
    return T.union_experiments([first, second.withColumn("fold", F.col("event_id") % 3)])


@query("distinct_models", f"""{_TABLES} SELECT model_name FROM errors WHERE eval_method = 'hold_out'
    UNION SELECT model_name FROM results WHERE eval_method = 'hold_out' UNION SELECT model_name FROM params""")
def distinct_models(spark, d):
    return T.distinct_models(list(_tables(spark, d).values()), F.col("eval_method") == "hold_out")


@query("list_experiments", """
    SELECT DISTINCT concat(lang, '_', source) AS experiment FROM documents WHERE doc_id % 4 < 3""")
def list_experiments(spark, d):
    names = V.table(spark, d, "documents").selectExpr(
        "concat(lang, '_', source, CASE doc_id % 4 WHEN 0 THEN '_errors' WHEN 1 THEN '_results' WHEN 2 THEN '_best_params' "
        "ELSE '_other' END) AS name")
    return T.list_experiments(names)


@query("append_results", f"""{_TABLES} SELECT experiment, model_name, eval_method, metric, k, mean FROM results WHERE experiment = 'regular_5_shot'
    UNION ALL SELECT experiment, 'fresh', eval_method, metric, k, mean FROM results WHERE experiment = 'regular_5_shot'""")
def append_results(spark, d):
    store = _store(spark, d)
    fresh = store.read(EXPERIMENTS[0], "results").withColumn("model_name", F.lit("fresh"))
    store.append(EXPERIMENTS[0], "results", fresh.select("model_name", "eval_method", "metric", "k", "mean"))
    return store.read(EXPERIMENTS[0], "results")


@query("upsert_best_params", f"""{_TABLES} SELECT experiment, model_name, optimizer_metric, eval_method,
        CASE WHEN model_name IN ('m0', 'm4') THEN 1.5 ELSE score END AS score FROM params WHERE experiment = 'regular_5_shot'
    UNION ALL SELECT DISTINCT experiment, 'm9', 'tests', 'hold_out', 1.5 FROM params WHERE experiment = 'regular_5_shot'""")
def upsert_best_params(spark, d):
    store = _store(spark, d)
    old = store.read(EXPERIMENTS[0], "best_params")
    replaced = old.filter(F.col("model_name").isin("m0", "m4"))
    added = old.select("optimizer_metric", "eval_method", "experiment").distinct().withColumn("model_name", F.lit("m9"))
    fresh = replaced.drop("score").unionByName(added).withColumn("score", F.lit(1.5)).drop("experiment")
    store.upsert_best_params(fresh, EXPERIMENTS[0])
    return store.read(EXPERIMENTS[0], "best_params")


@query("get_results", f"""{_TABLES} SELECT experiment, model_name, eval_method, metric, k, mean FROM results
    WHERE model_name = 'm4' AND eval_method = '3_fold' AND metric IN ('tests', 'syntax') AND k IN (1, 2)""")
def get_results(spark, d):
    return T.get_results(_tables(spark, d)["results"], "m4", "3_fold", ["tests", "syntax"], [1, 2])


@query("set_missing_field", f"""{_TABLES} SELECT event_id, experiment, 'v1' AS version, CASE WHEN experiment = 'signature_5_shot' THEN error_type
        ELSE coalesce(CASE WHEN event_id % 2 = 0 THEN error_type END, 'unset') END AS error_type FROM errors
    UNION ALL SELECT NULL, experiment, 'v1', 'unset' FROM results UNION ALL SELECT NULL, experiment, 'v1', 'unset' FROM params""")
def set_missing_field(spark, d):
    store = _store(spark, d)
    holes = store.read(EXPERIMENTS[0], "errors").withColumn(
        "error_type", F.when(F.col("event_id") % 2 == 0, F.col("error_type")))
    store.rewrite("errors", holes, EXPERIMENTS[:1])
    store.set_missing_field("error_type", F.lit("unset"))
    store.set_missing_field("version", F.lit("v1"))
    return T.union_experiments([store.read_all(kind) for kind in T.KINDS]).select("event_id", "experiment", "version", "error_type")


@query("remove_field", f"{_TABLES} SELECT event_id, experiment, model_name, eval_method, phase FROM errors")
def remove_field(spark, d):
    return T.remove_field(T.remove_field(_tables(spark, d)["errors"], "error_type"), "absent")


@query("rename_field", f"{_TABLES} SELECT event_id, experiment, model_name AS model, eval_method, phase, error_type FROM errors")
def rename_field(spark, d):
    return T.rename_field(T.rename_field(_tables(spark, d)["errors"], "model_name", "model"), "absent", "still_absent")


@query("delete_docs", f"""{_TABLES} SELECT event_id, experiment, model_name, eval_method, phase, error_type FROM errors
    WHERE experiment = 'signature_5_shot' AND NOT (model_name = 'm0' AND phase = 'testing')""")
def delete_docs(spark, d):
    store = _store(spark, d)
    store.delete("errors", T.matches({"model_name": "m0", "phase": "testing"}), EXPERIMENTS[1])
    return store.read(EXPERIMENTS[1], "errors")


@query("copy_collection", f"""{_TABLES} SELECT event_id, 'copied' AS experiment, model_name, eval_method, phase, error_type FROM errors
    WHERE experiment = 'signature_5_shot'""")
def copy_collection(spark, d):
    store = _store(spark, d)
    if not store.copy_errors(EXPERIMENTS[1], "copied") or store.copy_errors(EXPERIMENTS[0], "copied"):
        raise RuntimeError("a copy must be made once and never over an existing experiment")
    return store.read("copied", "errors")


_QUALITY = f"""{_TABLES},
    m AS (SELECT experiment, model_name FROM errors WHERE eval_method = 'hold_out' UNION
          SELECT experiment, model_name FROM results WHERE eval_method = 'hold_out' UNION
          SELECT experiment, model_name FROM params WHERE eval_method = 'hold_out'),
    c AS (SELECT experiment, model_name,
        (SELECT count(*) FROM errors e WHERE e.experiment = m.experiment AND e.model_name = m.model_name AND phase = 'validation') AS validation_errors,
        (SELECT count(*) FROM errors e WHERE e.experiment = m.experiment AND e.model_name = m.model_name AND phase = 'testing'
            AND eval_method = 'hold_out') AS testing_errors,
        (SELECT count(*) FROM results e WHERE e.experiment = m.experiment AND e.model_name = m.model_name AND eval_method = 'hold_out') AS results,
        (SELECT count(*) FROM params e WHERE e.experiment = m.experiment AND e.model_name = m.model_name) AS best_params FROM m),
    q AS (SELECT *, best_params = 0 AND validation_errors > 0 AS orphan_validation, results = 0 AND testing_errors > 0 AS orphan_testing,
        best_params = 0 AND results > 0 AS results_without_params FROM c)
    SELECT *, NOT (orphan_validation OR orphan_testing OR results_without_params) AS passed FROM q"""


@query("quality_checks", _QUALITY)
def quality_checks(spark, d):
    tables = _tables(spark, d)
    return T.quality_checks(tables["errors"], tables["results"], tables["best_params"], "hold_out")


@query("quality_clean", f"""{_QUALITY[:_QUALITY.rindex("SELECT *, NOT")].rstrip()}
    SELECT 'errors' AS kind, experiment, model_name, count(*) AS rows FROM errors e LEFT JOIN q USING (experiment, model_name)
    WHERE NOT coalesce((orphan_validation AND phase = 'validation') OR (orphan_testing AND phase = 'testing' AND eval_method = 'hold_out'), false) GROUP BY 2, 3
    UNION ALL SELECT 'results', experiment, model_name, count(*) FROM results e LEFT JOIN q USING (experiment, model_name)
    WHERE NOT coalesce(results_without_params AND eval_method = 'hold_out', false) GROUP BY 2, 3""")
def quality_clean(spark, d):
    """The checks acted upon, in all experiments at once."""
    store = _store(spark, d)
    store.clean("hold_out")
    left = T.union_experiments([store.read_all(k).select("experiment", "model_name").withColumn("kind", F.lit(k)) for k in ("errors", "results")])
    return left.groupBy("kind", "experiment", "model_name").agg(F.count(F.lit(1)).alias("rows"))


@query("rerun_plan", f"""{_TABLES}, r AS (SELECT DISTINCT experiment, model_name, eval_method FROM base)
    SELECT experiment, model_name, eval_method, CASE WHEN n > 0 THEN 'skip' ELSE 'run' END AS action,
        cast(0 AS bigint) AS delete_stored, CASE WHEN n > 0 THEN 0 ELSE e END AS delete_errors FROM (SELECT *,
        (SELECT count(*) FROM results s WHERE (s.experiment, s.model_name, s.eval_method) = (r.experiment, r.model_name, r.eval_method)) AS n,
        (SELECT count(*) FROM errors s WHERE (s.experiment, s.model_name, s.eval_method) = (r.experiment, r.model_name, r.eval_method)
            AND phase = 'testing') AS e FROM r)""")
def rerun_plan(spark, d):
    tables = _tables(spark, d)
    base = _BASE.format(source="tallyforge_store_events")
    requested = spark.sql(f"WITH {base} SELECT DISTINCT experiment, model_name, eval_method FROM base")
    return T.rerun_plan(requested, tables["results"], tables["errors"], "testing")


@query("experiment_exists", "SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'regular_5_shot' ELSE 'signature_5_shot' END AS experiment FROM events")
def experiment_exists(spark, d):
    store = _store(spark, d)
    if store.exists("unknown") or not all(store.exists(e) for e in EXPERIMENTS):
        raise RuntimeError("existence of an experiment is reported wrongly")
    return store.experiments()


@query("setup", f"""{_TABLES} SELECT event_id, model_name, error_type, 'fresh' AS experiment FROM errors""")
def setup(spark, d):
    store = _new_store(spark)
    store.setup("fresh", {"errors": "event_id long, model_name string, error_type string",
                          "results": "model_name string, mean double", "best_params": "model_name string, score double"})
    store.append("fresh", "errors", _tables(spark, d)["errors"].select("event_id", "model_name", "error_type"))
    return store.read("fresh", "errors")


@query("export_all", f"""{_TABLES} SELECT 'errors' AS kind, model_name, eval_method, event_id, phase, error_type, NULL AS metric, NULL AS k, NULL AS mean,
        NULL AS optimizer_metric, NULL AS score FROM errors WHERE experiment = 'regular_5_shot'
    UNION ALL SELECT 'results', model_name, eval_method, NULL, NULL, NULL, metric, k, mean, NULL, NULL FROM results WHERE experiment = 'regular_5_shot'
    UNION ALL SELECT 'best_params', model_name, eval_method, NULL, NULL, NULL, NULL, NULL, NULL, optimizer_metric, score FROM params WHERE experiment = 'regular_5_shot'""")
def export_all(spark, d):
    store = _store(spark, d)
    folder = scratch_path(spark, "exports")
    store.export_all(EXPERIMENTS[0], folder)
    dumped = [spark.read.schema(store.read_all(k).drop("experiment").schema).json(f"{folder}/{EXPERIMENTS[0]}_{k}").withColumn("kind", F.lit(k)) for k in T.KINDS]
    return T.union_experiments(dumped)
