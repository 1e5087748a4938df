"""Queries: scoring, pass@k, roll-ups, best parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import errors as E
from tallyforge.functions import naming as N
from tallyforge.functions import text as X
from tallyforge.operators import context as C
from tallyforge.operators import scoring as S
from tallyforge.operators.ordering import numbered_in_order
from tallyforge.plans import experiments as P
from workload import views as V
from workload.registry import query

RUN = ["model", "fold", "seed"]
KS = (1, 2, 3, 5, 10)


def _counts(spark, d):
    return S.task_counts(V.trials(spark, d), RUN)


def _scores(spark, d):
    return S.pass_at_k(_counts(spark, d), RUN, KS)


def _fold_scores(spark, d):
    return S.mean_std_runs(_scores(spark, d), ["model", "fold", "metric", "k"])


@query("score_candidates", """
    SELECT event_id, model, fold, seed, task_id, prompt, metric,
           NOT list_contains(CASE metric WHEN 'syntax' THEN ['syntax'] WHEN 'semantic' THEN ['syntax', 'semantic']
               ELSE ['syntax', 'semantic', 'tests'] END, coalesce(error_type, '')) AS passed,
           CASE WHEN list_contains(CASE metric WHEN 'syntax' THEN ['syntax'] WHEN 'semantic' THEN ['syntax', 'semantic']
               ELSE ['syntax', 'semantic', 'tests'] END, coalesce(error_type, '')) THEN error_type END AS error_type
    FROM staged CROSS JOIN (VALUES ('syntax'), ('semantic'), ('tests')) AS m(metric)""", ("staged",))
def score_candidates(spark, d):
    return S.score_candidates(V.view(spark, d, "outputs"))


@query("task_counts", "SELECT model, fold, seed, task_id, metric, n, c FROM counts", ("counts",))
def task_counts(spark, d):
    return _counts(spark, d)


@query("pass_at_k", "SELECT model, fold, seed, metric, k, round(value, 6) AS value FROM scores", ("scores",))
def pass_at_k(spark, d):
    return _scores(spark, d).withColumn("value", F.round("value", 6))


@query("mean_std_runs", "SELECT model, fold, metric, k, mean, std FROM fold_scores", ("fold_scores",))
def mean_std_runs(spark, d):
    return _fold_scores(spark, d)


@query("mean_std_folds", """
    SELECT model, metric, k, round_even(avg(mean) * 100, 0) / 100 AS mean,
           round_even(stddev_pop(mean) * 100, 0) / 100 AS std
    FROM fold_scores WHERE model IN (SELECT model FROM fold_scores GROUP BY model HAVING count(DISTINCT fold) = 3)
    GROUP BY model, metric, k""", ("fold_scores",))
def mean_std_folds(spark, d):
    return S.mean_std_folds(_fold_scores(spark, d), ["model", "metric", "k"])


@query("evaluate_experiments", """
    WITH c AS (SELECT prompt, model, fold, seed, task_id, metric, count(*) AS n,
               count(*) FILTER (WHERE NOT list_contains(CASE metric WHEN 'syntax' THEN ['syntax']
                    WHEN 'semantic' THEN ['syntax', 'semantic'] ELSE ['syntax', 'semantic', 'tests'] END,
                    coalesce(error_type, ''))) AS c
        FROM staged CROSS JOIN (VALUES ('syntax'), ('semantic'), ('tests')) AS m(metric)
        GROUP BY prompt, model, fold, seed, task_id, metric),
    s AS (SELECT prompt, model, fold, seed, metric, k, avg(CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
                    ELSE 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i)) END) AS value
        FROM c CROSS JOIN (VALUES (1), (2), (3), (5), (10)) AS ks(k)
        GROUP BY prompt, model, fold, seed, metric, k HAVING min(n) >= k),
    f AS (SELECT prompt, model, fold, metric, k, round_even(avg(value) * 100, 0) / 100 AS mean
        FROM s GROUP BY prompt, model, fold, metric, k)
    SELECT prompt, model, metric, k, round_even(avg(mean) * 100, 0) / 100 AS mean,
           round_even(stddev_pop(mean) * 100, 0) / 100 AS std
    FROM f WHERE (prompt, model) IN (SELECT (prompt, model) FROM f GROUP BY prompt, model HAVING count(DISTINCT fold) = 3)
    GROUP BY prompt, model, metric, k""", ("staged",))
def evaluate_experiments(spark, d):
    return P.evaluate_experiments(V.view(spark, d, "outputs"), ["prompt", "model"])


@query("hold_out_results", """
    WITH c AS (SELECT prompt, model, seed, task_id, metric, count(*) AS n,
               count(*) FILTER (WHERE NOT list_contains(CASE metric WHEN 'syntax' THEN ['syntax']
                    WHEN 'semantic' THEN ['syntax', 'semantic'] ELSE ['syntax', 'semantic', 'tests'] END,
                    coalesce(error_type, ''))) AS c
        FROM staged CROSS JOIN (VALUES ('syntax'), ('semantic'), ('tests')) AS m(metric)
        GROUP BY prompt, model, seed, task_id, metric),
    s AS (SELECT prompt, model, seed, metric, k, avg(CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
                    ELSE 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i)) END) AS value
        FROM c CROSS JOIN (VALUES (1), (2), (3), (5), (10)) AS ks(k)
        GROUP BY prompt, model, seed, metric, k HAVING min(n) >= k)
    SELECT prompt, model, metric, k, round_even(avg(value) * 100, 0) / 100 AS mean, round_even(stddev_pop(value) * 100, 0) / 100 AS std
    FROM s GROUP BY prompt, model, metric, k""", ("staged",))
def hold_out_results(spark, d):
    return P.hold_out_results(V.view(spark, d, "outputs"), ["prompt", "model"])


@query("layout_results", """
    WITH t AS (SELECT prompt, model, fold, seed, task_id, avg(CASE WHEN error_type IS NULL THEN (event_id % 8) / 8.0 END) AS m
               FROM staged GROUP BY prompt, model, fold, seed, task_id),
    r AS (SELECT prompt, model, fold, seed, coalesce(avg(m), 0.0) AS value FROM t GROUP BY prompt, model, fold, seed),
    f AS (SELECT prompt, model, fold, round_even(avg(value) * 100, 0) / 100 AS mean FROM r GROUP BY prompt, model, fold)
    SELECT prompt, model, 'nodes' AS metric, 'flow' AS k, round_even(avg(mean) * 100, 0) / 100 AS mean, round_even(stddev_pop(mean) * 100, 0) / 100 AS std
    FROM f GROUP BY prompt, model HAVING count(DISTINCT fold) = 3""", ("staged",))
def layout_results(spark, d):
    """The nodes@flow rows of the result table; candidates that failed have no score."""
    staged = S.with_error_type(V.view(spark, d, "outputs"))
    scored = staged.withColumn("layout_score", F.when(F.col("error_type").isNull(), (F.col("event_id") % 8) / 8))
    return P.layout_results(scored, ["prompt", "model"])


@query("pass_at_k_containment", """
    WITH a AS (SELECT o_custkey % 7 AS run, o_custkey AS task_id,
               concat('L', cast(o_custkey % 5 AS string), ',L9') AS truth,
               concat('L', cast(o_orderkey % 5 AS string), CASE WHEN o_orderkey % 3 = 0 THEN ', L9' ELSE ',L9' END, ',L',
                      cast(o_custkey % 5 AS string)) AS answer FROM orders),
    c AS (SELECT run, task_id, count(*) AS n, count(*) FILTER (WHERE list_has_all(string_split(answer, ','),
               string_split(truth, ','))) AS c FROM a GROUP BY run, task_id)
    SELECT run, 'containment' AS metric, k, round(avg(CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
           ELSE 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i)) END), 6) AS value
    FROM c CROSS JOIN (VALUES (1), (2)) AS ks(k) GROUP BY run, k HAVING min(n) >= k""")
def pass_at_k_containment(spark, d):
    answers = V.table(spark, d, "orders").selectExpr(
        "o_custkey % 7 AS run", "o_custkey AS task_id", "concat('L', o_custkey % 5, ',L9') AS truth",
        "concat('L', o_orderkey % 5, CASE WHEN o_orderkey % 3 = 0 THEN ', L9' ELSE ',L9' END, ',L', o_custkey % 5) AS answer")
    return S.pass_at_k(S.containment_counts(answers, ["run"]), ["run"], (1, 2)).withColumn("value", F.round("value", 6))


@query("set_f1", """
    WITH a AS (SELECT p_partkey % 5 AS run, list_distinct(string_split(p_name, ' ')) AS t,
               list_distinct(string_split(concat(p_name, ' ', p_type), ' ')) AS g FROM part)
    SELECT run, round(avg(2.0 * len(list_intersect(t, g)) / (len(t) + len(g))), 6) AS f1 FROM a GROUP BY run""")
def set_f1(spark, d):
    answers = V.table(spark, d, "part").selectExpr(
        "p_partkey % 5 AS run", "p_partkey AS task_id", "replace(p_name, ' ', ', ') AS truth",
        "explode(map(3, 'neither', 1, concat(p_name, ', ', p_type), 2, p_type)) AS (candidate_id, answer)")
    return S.set_f1(answers, ["run"]).withColumn("f1", F.round("f1", 6))


@query("seed_union", "SELECT model, string_agg(cast(seed AS string), ',' ORDER BY seed) AS seeds "
       "FROM (SELECT DISTINCT model, seed FROM trials) GROUP BY model", ("trials",))
def seed_union(spark, d):
    return S.seed_union(V.trials(spark, d), ["model"]).withColumn("seeds", F.array_join("seeds", ","))


@query("f1_deviation", """
    SELECT model, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std
    FROM scores GROUP BY model""", ("scores",))
def f1_deviation(spark, d):
    scores = S.deviation(_scores(spark, d), ["model"], ["value"])
    return scores.withColumns({c: F.round(c, 6) for c in ("value_mean", "value_std")})


_GRID_SQL = """
    WITH g AS (SELECT model, metric, value, fold * 1000 + seed AS grid_pos, fold AS top_k, seed FROM scores WHERE k = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY model, metric ORDER BY round(value, 6) DESC, grid_pos) AS rn FROM g)
    SELECT model, metric, top_k, seed, round(value, 6) AS score FROM r WHERE rn = 1"""


def _grid(spark, d):
    return _scores(spark, d).filter("k = 1").select(
        "model", "metric", F.round("value", 6).alias("value"), (F.col("fold") * 1000 + F.col("seed")).alias("grid_pos"),
        F.col("fold").alias("top_k"), "seed")


def _best(spark, d):
    return S.best_params(_grid(spark, d), ["model", "metric"], ["top_k", "seed"])


@query("best_params", _GRID_SQL, ("scores",))
def best_params(spark, d):
    return _best(spark, d)


@query("best_params_for_model", f"""
    WITH stored AS ({_GRID_SQL}), m AS (SELECT DISTINCT concat('m', cast(user_id % 5 AS string)) AS model, 'tests' AS metric FROM events)
    SELECT m.model, m.metric, top_k, seed, score FROM m LEFT JOIN stored USING (model, metric)""", ("scores",))  # stored twice below
def best_params_for_model(spark, d):
    wanted = V.table(spark, d, "events").selectExpr("concat('m', user_id % 5) AS model", "'tests' AS metric").distinct()
    best = _best(spark, d)
    later = best.withColumns({"top_k": F.col("top_k") + 100, "score": F.lit(0.0)})
    stored = later.withColumn("pos", F.lit(2)).unionByName(best.withColumn("pos", F.lit(1)))
    return S.best_params_for_model(wanted, stored, ["model", "metric"], "pos")


@query("best_params_fallback", f"""
    WITH stored AS ({_GRID_SQL}),
    z AS (SELECT model, metric, top_k, seed, CASE WHEN metric = 'tests' AND model = 'm1' THEN 0.0 ELSE score END AS score FROM stored)
    SELECT model, metric, top_k, seed, score FROM z
    WHERE metric = CASE WHEN (SELECT score FROM z b WHERE b.model = z.model AND b.metric = 'tests') = 0.0
                        THEN 'semantic' ELSE 'tests' END""", ("scores",))
def best_params_fallback(spark, d):
    zeroed = _best(spark, d).withColumn("score", F.when(
        (F.col("metric") == "tests") & (F.col("model") == "m1"), 0.0).otherwise(F.col("score")))
    return S.best_params_fallback(zeroed, ["model"], ["top_k", "seed"])


@query("hyperparam_grid", """
    SELECT model, cast((ti * 9 + ki * 3 + pi) AS int) AS grid_pos, cast(t AS double) AS temperature, k AS top_k, cast(p AS double) AS top_p
    FROM (SELECT DISTINCT model FROM trials)
    CROSS JOIN (VALUES (0, 0.2), (1, 0.6), (2, 0.9)) AS a(ti, t) CROSS JOIN (VALUES (0, 10), (1, 50), (2, 100)) AS b(ki, k)
    CROSS JOIN (VALUES (0, 0.2), (1, 0.6), (2, 0.9)) AS c(pi, p)""", ("trials",))
def hyperparam_grid(spark, d):
    models = V.trials(spark, d).select("model").distinct()
    return S.hyperparam_grid(models, [0.2, 0.6, 0.9], [0.2, 0.6, 0.9], [10, 50, 100])


@query("attempt_seed", "SELECT event_id, cast(seed * candidate_id AS bigint) AS attempt_seed FROM attempts", ("attempts",))
def attempt_seed(spark, d):
    return V.attempts(spark, d).select("event_id", S.attempt_seed().cast("long").alias("attempt_seed"))


@query("flatten_metrics", """
    SELECT model, fold, seed, concat(metric, '@', cast(k AS string)) AS name, round(value, 6) AS value FROM scores""", ("scores",))
def flatten_metrics(spark, d):
    nested = S.nest_metrics(_scores(spark, d), RUN)
    return S.flatten_metrics(nested, RUN).withColumn("value", F.round("value", 6))


@query("skip_failed_attempts", """
    SELECT event_id, task_id, candidate_id, seed FROM attempts
    WHERE coalesce(error_type, '') NOT IN ('syntax', 'semantic')""", ("attempts",))
def skip_failed_attempts(spark, d):
    attempts = V.attempts(spark, d)
    return S.skip_failed_attempts(attempts, attempts, ("task_id", "seed", "candidate_id")).select(
        "event_id", "task_id", "candidate_id", "seed")


@query("attach_tests", """
    SELECT event_id, task_id, concat('code ', event_type, chr(10), CASE WHEN source IS NOT NULL THEN concat('module(doc: "tests of f") tests {',
           chr(10), '    instance(x: 1, y: 2) t_5 { name: "', source, '" }', chr(10), '  }') ELSE '' END) AS code
    FROM (SELECT event_id, user_id AS task_id, event_type FROM events)
    LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 > 0) ON doc_id = task_id""")
def attach_tests(spark, d):
    candidates = V.table(spark, d, "events").selectExpr(
        "event_id", "user_id AS task_id", "concat('code ', event_type) AS code")
    modules = V.view(spark, d, "programs").filter("task_id % 3 > 0").select("task_id", X.tests_module(F.col("code")).alias("tests_module"))
    return S.attach_tests(candidates, modules).select("event_id", "task_id", "code")


_TOKENS_SQL = r"len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f]'))"


@query("max_tokens_per_model", f"SELECT lang AS model, max({_TOKENS_SQL.format('text')}) AS max_tokens FROM documents GROUP BY lang")
def max_tokens_per_model(spark, d):
    docs = V.table(spark, d, "documents").withColumnRenamed("lang", "model")
    return S.max_tokens_per_model(docs, C.token_count(F.col("text")))


@query("models_without_tokens", """
    SELECT DISTINCT source AS model FROM documents
    WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def models_without_tokens(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.col("source").alias("model"))
    known = docs.join(V.table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("model")
    return S.models_without_tokens(docs, known)


@query("largest_context", """
    SELECT lang, max(greatest(cast(ceil(n_chars / 4.0) AS bigint) + 500, length(source) + 500)) AS largest_context
    FROM documents GROUP BY lang""")
def largest_context(spark, d):
    docs = V.table(spark, d, "documents")
    sizes = [F.ceil(F.col("n_chars") / 4.0).cast("long"), F.length("source").cast("long")]
    return S.largest_context(docs, ["lang"], sizes, F.lit(500))


@query("token_count", f"SELECT doc_id, {_TOKENS_SQL.format('text')} AS tokens FROM documents")
def token_count(spark, d):
    return V.table(spark, d, "documents").select("doc_id", C.token_count(F.col("text")).alias("tokens"))


# Two models with vocabularies, one of words, their beginnings and their ends, one of names of nations and regions, and one without.
_VOCABULARIES = """SELECT 'm0' AS model, lower(w) AS token FROM (SELECT {each}({split}(p_name, ' ')) AS w FROM {part}) x
    UNION SELECT 'm0', lower(left(w, 3)) FROM (SELECT {each}({split}(p_name, ' ')) AS w FROM {part}) x
    UNION SELECT 'm0', lower(right(w, 2)) FROM (SELECT {each}({split}(p_name, ' ')) AS w FROM {part}) x
    UNION SELECT 'm1', lower(left(n_name, 2)) FROM {nation} UNION SELECT 'm1', lower(substr(n_name, 2, 3)) FROM {nation}
    UNION SELECT 'm1', lower(left(r_name, 1)) FROM {region}"""


@query("token_count_by_model", f"""
    WITH RECURSIVE vocabulary AS ({_VOCABULARIES.format(each='unnest', split='string_split', part='part', nation='nation', region='region')}),
    rows AS (SELECT doc_id, concat('m', doc_id % 3) AS model, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r\\f]')) AS word FROM documents),
    words AS (SELECT DISTINCT model, word FROM rows),
    walk AS (
        SELECT model, word, 1::BIGINT AS place, 0::BIGINT AS tokens FROM words WHERE model <> 'm2'
        UNION ALL
        SELECT t.model, word, place + coalesce(max(length(v.token)), 1), tokens + 1
        FROM (SELECT model, word, place, tokens, unnest(range(1, least(20, length(word) - place + 1) + 1)) AS width FROM walk WHERE place <= length(word)) t
        LEFT JOIN vocabulary v ON v.model = t.model AND v.token = substr(word, place, width) GROUP BY t.model, word, place, tokens),
    cut AS (SELECT model, word, max(tokens) AS tokens FROM walk GROUP BY model, word)
    SELECT d.doc_id, coalesce(sum(coalesce(tokens, CASE WHEN word IS NULL THEN 0 ELSE 1 END)), 0)::BIGINT AS tokens
    FROM documents d LEFT JOIN rows r ON r.doc_id = d.doc_id LEFT JOIN cut USING (model, word) GROUP BY d.doc_id""")
def token_count_by_model(spark, d):
    for name in ("part", "nation", "region"):
        V.table(spark, d, name).createOrReplaceTempView(f"tallyforge_{name}")
    vocabularies = spark.sql(_VOCABULARIES.format(each="explode", split="split", part="tallyforge_part", nation="tallyforge_nation", region="tallyforge_region"))
    texts = V.table(spark, d, "documents").selectExpr("doc_id", "concat('m', doc_id % 3) AS model", "text")
    return C.token_count_by_model(texts, vocabularies, "doc_id")


@query("compile_ready", r"""
    SELECT task_id, CASE WHEN trim(response, concat(' ', chr(9), chr(10), chr(13))) = '' THEN false ELSE regexp_matches(
        regexp_extract(response, '[^ \t\n\r\f]+'),
        'import|func|module|Url|Std|Http|Strings|Time|Testing|Data|Json|CSV|List|Map|Iteration|Math|LinearAlgebra|Logic|Scheduling|Net|Image|File|Env|Buffer|Sets|Process|Base64|Hashing|instance|data_instance|getter|setter|in|out')
        END AS ready
    FROM responses""", ("responses",))
def compile_ready(spark, d):
    return V.view(spark, d, "responses").select("task_id", E.compile_ready(F.col("response")).alias("ready"))


@query("syntax_valid", "SELECT event_id, coalesce(error_type, '') <> 'syntax' AS valid FROM staged", ("staged",))
def syntax_valid(spark, d):
    return V.view(spark, d, "outputs").select("event_id", E.syntax_valid(F.col("stdout"), F.col("stderr")).alias("valid"))


@query("semantic_valid", "SELECT event_id, coalesce(error_type, '') NOT IN ('syntax', 'semantic') AS valid FROM staged", ("staged",))
def semantic_valid(spark, d):
    return V.view(spark, d, "outputs").select(
        "event_id", E.semantic_valid(F.col("stdout"), F.col("stderr"), F.col("returncode")).alias("valid"))


@query("all_tests_passed", """
    SELECT event_id, event_type IN ('click', 'purchase') AS passed FROM events""")
def all_tests_passed(spark, d):
    return V.view(spark, d, "outputs").select(
        "event_id", E.all_tests_passed(E.test_result(F.col("tests_stdout"))).alias("passed"))


@query("parse_experiment_name", r"""
    SELECT event_id, regexp_extract(regexp_replace(file_name, '\.json$', ''), '^((?:[^_]*_)*?[^_]*shot[^_]*)(?:_(.*))?$', 1) AS experiment,
           regexp_extract(regexp_replace(file_name, '\.json$', ''), '^((?:[^_]*_)*?[^_]*shot[^_]*)(?:_(.*))?$', 2) AS model
    FROM run_names""", ("run_names",))
def parse_experiment_name(spark, d):
    name = F.col("file_name")
    return V.view(spark, d, "run_names").select(
        "event_id", N.experiment_of(name).alias("experiment"), N.model_of(name).alias("model"))


@query("parse_experiment_settings", """
    SELECT event_id, split_part(file_name, '_', 1) AS prompt_type, split_part(file_name, '_', 2) = 'similarity' AS similarity,
           cast(split_part(file_name, '_', 3) AS int) AS shots FROM run_names""", ("run_names",))
def parse_experiment_settings(spark, d):
    name = F.col("file_name")
    return V.view(spark, d, "run_names").select(
        "event_id", N.prompt_type_of(name).alias("prompt_type"), N.is_similarity(name).alias("similarity"),
        N.shots_of(name).alias("shots"))


_SIZE_SQL = "CASE WHEN contains({0}, ':') THEN split_part(split_part({0}, ':', 2), '-', 1) ELSE 'N/A' END"


@query("model_size", f"SELECT event_id, {_SIZE_SQL.format('file_name')} AS size FROM run_names", ("run_names",))
def model_size(spark, d):
    return V.view(spark, d, "run_names").select("event_id", N.model_size(F.col("file_name")).alias("size"))


@query("sort_by_size_model", f"""
    SELECT size, file_name, runs, row_number() OVER (ORDER BY size, file_name) AS line FROM (
        SELECT {_SIZE_SQL.format('file_name')} AS size, file_name, count(*) AS runs FROM run_names GROUP BY file_name)""", ("run_names",))
def sort_by_size_model(spark, d):
    report = V.view(spark, d, "run_names").groupBy("file_name").agg(F.count(F.lit(1)).alias("runs"))
    sized = report.select(N.model_size(F.col("file_name")).alias("size"), "file_name", "runs")
    return numbered_in_order(sized, ["size", "file_name"], "line").orderBy("line")


@query("pivot_scores", """
    SELECT model, fold, seed, round(max(value) FILTER (WHERE metric = 'syntax' AND k = 1), 6) AS "syntax@1",
           round(max(value) FILTER (WHERE metric = 'tests' AND k = 5), 6) AS "tests@5",
           round(max(value) FILTER (WHERE metric = 'syntax' AND k = 5), 6) AS "syntax@5",
           round(max(value) FILTER (WHERE metric = 'tests' AND k = 1), 6) AS "tests@1"
    FROM scores GROUP BY model, fold, seed""", ("scores",))
def pivot_scores(spark, d):
    scores = _scores(spark, d).filter(F.col("metric").isin("syntax", "tests") & F.col("k").isin(1, 5))
    wide = S.pivot_scores(scores, RUN, ["syntax", "tests"], [1, 5])
    return wide.select(*RUN, *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns if "@" in c])
