"""Queries: error logs, categories, refinement outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import errors as E
from tallyforge.functions import text as X
from tallyforge.operators import diagnosis as D
from tallyforge.operators import scoring as S
from tallyforge.operators import store as T
from tallyforge.plans import experiments as P
from workload import views as V
from workload.registry import query

_SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def _strip(expr: str) -> str:
    return f"trim({expr}, {_SPACE})"


def _clean(expr: str) -> str:
    return _strip(rf"regexp_replace({expr}, '\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])', '', 'g')")


# The error table the checks read: failing rows only.
_ERRORS = """errors AS (SELECT event_id, model AS model_name, fold, seed, task_id, prompt, stdout, stderr, error_type,
                  CASE WHEN fold = 2 THEN 'validation' ELSE 'testing' END AS phase FROM staged WHERE error_type IS NOT NULL)"""


def _errors(spark, d):
    staged = S.with_error_type(V.view(spark, d, "outputs")).filter(F.col("error_type").isNotNull())
    return staged.select(
        "event_id", F.col("model").alias("model_name"), "fold", "seed", "task_id", "prompt", "stdout", "stderr",
        "tests_stdout", "error_type", F.when(F.col("fold") == 2, "validation").otherwise("testing").alias("phase"))


@query("clean_ansi", f"SELECT event_id, {_clean('stderr')} AS clean FROM diagnostics", ("diagnostics",))
def clean_ansi(spark, d):
    return V.view(spark, d, "diagnostics").select("event_id", X.clean_ansi(F.col("stderr")).alias("clean"))


@query("extract_error_lines", f"""
    SELECT event_id, array_to_string(list_transform(list_filter(string_split({_clean('stdout')}, chr(10)),
           lambda s: contains(lower(s), 'error')), lambda s: {_strip('s')}), '|') AS lines FROM outputs""", ("outputs",))
def extract_error_lines(spark, d):
    return V.view(spark, d, "outputs").select(
        "event_id", F.array_join(X.error_lines(F.col("stdout")), "|").alias("lines"))


@query("extract_test_json", r"""
    SELECT event_id, cast(j->>'num_tests' AS int) AS num_tests, cast(j->>'num_passed' AS int) AS num_passed,
           j->'test_results'->0->'assertions'->2->>'actual' AS last_actual
    FROM (SELECT event_id, regexp_extract(tests_stdout, '(?s)\{.*\}')::JSON AS j FROM outputs)""", ("outputs",))
def extract_test_json(spark, d):
    result = V.view(spark, d, "outputs").select("event_id", E.test_result(F.col("tests_stdout")).alias("r"))
    return result.select("event_id", "r.num_tests", "r.num_passed",
                         F.col("r.test_results")[0]["assertions"][2]["actual"].alias("last_actual"))


@query("syntax_category", r"""
    SELECT event_id, coalesce(nullif(trim(regexp_extract(stderr, 'Error:\s*([^\n]*?)(?:\n|:)', 1)), ''),
           'Other syntax error') AS category FROM diagnostics""", ("diagnostics",))
def syntax_category(spark, d):
    return V.view(spark, d, "diagnostics").select("event_id", E.syntax_category(F.col("stderr")).alias("category"))


@query("unexpected_tokens", r"""
    SELECT event_id, trim(regexp_extract(stderr, 'but got\s+(.*?)(?:$|\s|at)', 1)) AS tokens FROM diagnostics""", ("diagnostics",))
def unexpected_tokens(spark, d):
    return V.view(spark, d, "diagnostics").select(
        "event_id", F.array_join(E.unexpected_tokens(F.col("stderr")), "|").alias("tokens"))


_SEMANTIC_CASE = """CASE WHEN contains(lower({0}), 'unable to resolve type') THEN 'Type Resolution Error'
    WHEN contains(lower({0}), 'failed to resolve symbol') THEN 'Symbol Resolution Error'
    WHEN contains(lower({0}), 'arrow from') AND contains(lower({0}), 'is not allowed') THEN 'Invalid connection'
    WHEN contains(lower({0}), 'leaf node') THEN 'Invalid AST structure' ELSE 'Other Semantic Error' END"""


@query("semantic_categories", f"SELECT event_id, {_SEMANTIC_CASE.format('stdout')} AS categories FROM outputs", ("outputs",))
def semantic_categories(spark, d):
    return V.view(spark, d, "outputs").select("event_id", F.array_join(
        E.semantic_categories(X.error_lines(F.col("stdout"))), "|").alias("categories"))


@query("semantic_messages", r"""
    SELECT event_id, nullif(trim(regexp_extract(stdout, 'SemanticAnalysisError\(@\d+\): ([^\n]+?), backtrace', 1)), '') AS messages
    FROM outputs""", ("outputs",))
def semantic_messages(spark, d):
    return V.view(spark, d, "outputs").select("event_id", F.array_join(
        E.semantic_messages(X.error_lines(F.col("stdout"))), "|").alias("messages"))


_PASSED_OF_THREE = "(len(tests_stdout) - len(replace(tests_stdout, '\"kind\": \"Passed\"', ''))) / len('\"kind\": \"Passed\"')"


@query("tests_category", f"SELECT event_id, concat(cast({_PASSED_OF_THREE} AS int), '/3') AS category FROM outputs", ("outputs",))
def tests_category(spark, d):
    return V.view(spark, d, "outputs").select(
        "event_id", E.tests_category(E.test_result(F.col("tests_stdout"))).alias("category"))


_FAILED_SQL = """CASE WHEN event_type IN ('click', 'purchase') THEN 'All passed.' ELSE concat(
    CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('Failed test: expected `2`, got `', user_id, '`', chr(10)) END,
    'Failed test: expected `3`, got `', event_id, '`') END"""


@query("failed_test_messages", f"""
    SELECT event_id, concat(CASE WHEN event_type IN ('click', 'purchase') THEN '3' WHEN event_id % 2 = 0 THEN '2' ELSE '1' END,
           '/3 tests passed.', chr(10), ' Test results:', chr(10), {_FAILED_SQL}, chr(10), 'a', chr(10), 'b', chr(10), 'c',
           chr(10), 'd') AS message FROM events""")
def failed_test_messages(spark, d):
    result = E.test_result(F.col("tests_stdout"))
    lines = F.split(F.lit("a,b,c,d,e"), ",")
    rows = V.view(spark, d, "outputs").select("event_id", result.alias("r"))
    return rows.select("event_id", E.test_error_text(F.col("r"), E.tests_category(F.col("r")), lines).alias("message"))


@query("refinement_feedback", r"""
    SELECT event_id, CASE WHEN event_type = 'error' THEN concat('Error: Parsing failed: got ', cast(value AS string))
            WHEN event_type = 'view' THEN concat(CASE event_id % 5 WHEN 0 THEN 'Failed to resolve symbol S'
                              WHEN 1 THEN 'Unable to resolve type T' WHEN 2 THEN 'Arrow from A is not allowed'
                              WHEN 3 THEN 'Leaf node N' ELSE 'Something odd' END, cast(user_id AS string))
            WHEN event_type = 'signup' AND user_id % 2 = 1 THEN concat(
                'Tests failed, with one or more assertion errors. Here are the test results: ', chr(10),
                '  - Pseudocode assertion: ''assert f(1)''. Result: Passed. Expected ''1'', got ''1''', chr(10),
                '  - Pseudocode assertion: ''assert f(2)''. Result: ', CASE WHEN event_id % 2 = 0 THEN 'Passed' ELSE 'Failed' END,
                '. Expected ''2'', got ''', user_id, '''', chr(10),
                '  - Pseudocode assertion: ''assert f(3)''. Result: Failed. Expected ''3'', got ''', event_id, '''', chr(10))
            ELSE '' END AS message,
           CASE WHEN event_type = 'error' THEN 'Syntax' WHEN event_type = 'view' THEN 'Semantic'
                WHEN event_type = 'signup' AND user_id % 2 = 1 THEN 'Tests' ELSE '' END AS category
    FROM events""")
def refinement_feedback(spark, d):
    assertions = F.split(F.lit("assert f(1),assert f(2),assert f(3)"), ",")
    feedback = E.refinement_feedback(F.col("stdout"), F.col("stderr"), F.col("returncode"), F.col("tests_stdout"),
                                     assertions, F.col("prompt"))
    return V.view(spark, d, "outputs").select("event_id", feedback.alias("f")).select("event_id", "f.*")


@query("categorize_errors", f"""
    WITH {_ERRORS} SELECT event_id, model_name, {_SEMANTIC_CASE.format('stdout')} AS semantic_category
    FROM errors WHERE error_type = 'semantic'""", ("staged",))
def categorize_errors(spark, d):
    errors = _errors(spark, d).filter("error_type = 'semantic'").withColumn("error_msg", X.error_lines(F.col("stdout")))
    return D.categorize_errors(errors, "semantic").select(
        "event_id", "model_name", F.array_join("semantic_category", "|").alias("semantic_category"))


@query("error_log_build", """
    SELECT event_id, task_id, candidate_id, 'tests' AS metric, error_type, cast(seed * candidate_id AS bigint) AS seed,
           CASE WHEN task_id % 2 = 0 THEN '3_fold' ELSE 'hold_out' END AS eval_method,
           CASE WHEN task_id % 2 = 0 THEN fold END AS fold
    FROM attempts WHERE error_type IS NOT NULL""", ("attempts",))
def error_log_build(spark, d):
    scored = S.score_candidates(V.attempts(spark, d)).filter("metric = 'tests'")
    method = F.when(F.col("task_id") % 2 == 0, "3_fold").otherwise("hold_out")
    return D.error_log(scored, method).select(
        "event_id", "task_id", "candidate_id", "metric", "error_type", F.col("seed").cast("long").alias("seed"),
        "eval_method", "fold")


_TOKEN_SQL = r"trim(regexp_extract(stderr, 'but got\s+(.*?)(?:$|\s|at)', 1))"
_CATEGORY_SQL = r"trim(regexp_extract(stderr, 'Error:\s*([^\n]*?)(?:\n|:)', 1))"
_PANEL = "model, prompt, experiment_type, shots"


@query("category_counts", f"""
    SELECT CASE WHEN event_id % 7 = 0 THEN 'None' ELSE {_CATEGORY_SQL} END AS category, count(*) AS count,
           round(100.0 * count(*) / (SELECT count(*) FROM diagnostics), 6) AS percentage
    FROM diagnostics GROUP BY 1""", ("diagnostics",))
def category_counts(spark, d):
    rows = V.view(spark, d, "diagnostics").select(  # some rows have no categories at all
        F.when(F.col("event_id") % 7 != 0, F.array(E.syntax_category(F.col("stderr")))).alias("category_set"))
    return D.category_counts(rows, "category_set").withColumn("percentage", F.round("percentage", 6))


_COMPARISON = f"""
    WITH c AS (SELECT {_PANEL}, {{category}} AS category, count(*) AS count FROM diagnostics {{where}} GROUP BY ALL)
    SELECT {_PANEL}, category, count, round(100.0 * count / sum(count) OVER (PARTITION BY {_PANEL}), 6) AS percentage FROM c"""
_PARSING = _COMPARISON.format(category=_TOKEN_SQL, where=f"WHERE {_CATEGORY_SQL} = 'Parsing failed'")
_PANEL_KEYS = ["model", "prompt", "experiment_type", "shots"]


@query("category_comparison", _COMPARISON.format(category=_CATEGORY_SQL, where=""), ("diagnostics",))
def category_comparison(spark, d):
    compared = D.category_comparison(V.view(spark, d, "diagnostics"), "syntax", _PANEL_KEYS)
    return compared.withColumn("percentage", F.round("percentage", 6))


@query("category_comparison_tokens", _PARSING, ("diagnostics",))
def category_comparison_tokens(spark, d):
    compared = D.category_comparison(V.view(spark, d, "diagnostics"), "syntax", _PANEL_KEYS, parsing_tokens=True)
    return compared.withColumn("percentage", F.round("percentage", 6))


@query("top5_categories", f"""
    WITH c AS (SELECT model, fold, CASE WHEN error_type = 'semantic' THEN {_SEMANTIC_CASE.format('stdout')} ELSE 'none' END AS category,
               count(*) AS count FROM staged WHERE error_type = 'semantic' GROUP BY ALL),
    p AS (SELECT *, 100.0 * count / sum(count) OVER (PARTITION BY model, fold) AS pct FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY round(pct, 9) DESC, category) AS rank FROM p)
    SELECT model, fold, category, count, round(pct, 6) AS percentage, cast(rank AS int) AS rank FROM r WHERE rank <= 5""", ("staged",))
def top5_categories(spark, d):
    errors = S.with_error_type(V.view(spark, d, "outputs")).withColumn("error_msg", X.error_lines(F.col("stdout")))
    report = P.error_report(errors, "semantic", ["model", "fold"])
    return report.withColumn("percentage", F.round("percentage", 6))


@query("errors_by_type", f"WITH {_ERRORS} SELECT error_type, count(*) AS count FROM errors GROUP BY error_type", ("staged",))
def errors_by_type(spark, d):
    return D.errors_by_type(_errors(spark, d))


@query("error_funnel", f"""
    WITH {_ERRORS}, c AS (SELECT model_name, count(*) AS t, count(*) FILTER (WHERE error_type = 'syntax') AS a,
        count(*) FILTER (WHERE error_type = 'semantic') AS b, count(*) FILTER (WHERE error_type = 'tests') AS c FROM errors GROUP BY 1)
    SELECT model_name, 'Total Candidates' AS source, 'Syntax Valid' AS target, t - a AS value FROM c
    UNION ALL SELECT model_name, 'Total Candidates', 'Syntax Error', a FROM c
    UNION ALL SELECT model_name, 'Syntax Valid', 'Semantic Valid', t - a - b FROM c
    UNION ALL SELECT model_name, 'Syntax Valid', 'Semantic Error', b FROM c
    UNION ALL SELECT model_name, 'Semantic Valid', 'Tests Passed', t - a - b - c FROM c
    UNION ALL SELECT model_name, 'Semantic Valid', 'Tests Error', c FROM c""", ("staged",))
def error_funnel(spark, d):
    return D.error_funnel(_errors(spark, d))


@query("model_doc_counts", f"""
    WITH {_ERRORS} SELECT model_name, count(*) AS count, count(*) FILTER (WHERE phase = 'validation') AS validation,
        count(*) FILTER (WHERE phase = 'testing') AS testing FROM errors GROUP BY ROLLUP (model_name)""", ("staged",))
def model_doc_counts(spark, d):
    return D.model_doc_counts(_errors(spark, d), ["validation", "testing"])


@query("error_count_model", f"""
    WITH {_ERRORS} SELECT count(*) AS count FROM errors WHERE model_name = 'm1' AND phase = 'validation'""", ("staged",))
def error_count_model(spark, d):
    return D.error_count_model(_errors(spark, d), "m1", "validation")


@query("find_docs", f"""
    WITH {_ERRORS} SELECT event_id, model_name, fold, seed, task_id, prompt, error_type, phase FROM errors
    WHERE model_name = 'm0' AND error_type IN ('syntax', 'tests') AND seed IS NOT NULL""", ("staged",))
def find_docs(spark, d):
    condition = T.matches({"model_name": "m0"}, {"error_type": ["syntax", "tests"]}, {"seed": True})
    return T.find_docs(_errors(spark, d), condition, ["stdout", "stderr", "tests_stdout"], order=["event_id"])


@query("skip_models", "SELECT model, count(*) AS candidates FROM trials WHERE model = 'm2' GROUP BY model", ("trials",))
def skip_models(spark, d):
    rows = T.find_docs(V.trials(spark, d), T.matches({"model": "m2"}))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("candidates"))


_OUTCOMES = ("Pass", "Tests", "Semantic", "Syntax")
_MATRIX = """SELECT model, prompt, i.initial, {cells}
    FROM outcomes o RIGHT JOIN (SELECT * FROM (SELECT DISTINCT model AS m, prompt AS p FROM outcomes)
        CROSS JOIN (VALUES ('Pass'), ('Tests'), ('Semantic'), ('Syntax')) AS v(initial)) i
    ON o.model = i.m AND o.prompt = i.p AND o.initial = i.initial
    WHERE NOT (i.p = 'regular' AND i.initial = 'Tests') GROUP BY i.m, i.p, i.initial""".replace(
    "SELECT model, prompt, i.initial", "SELECT i.m AS model, i.p AS prompt, i.initial").format(cells=", ".join(
        f"CASE WHEN i.p = 'regular' AND '{c}' = 'Tests' THEN NULL ELSE count(*) FILTER (WHERE o.final = '{c}') END AS \"{c}\""
        for c in _OUTCOMES))


@query("transition_matrix", _MATRIX, ("outcomes",))
def transition_matrix(spark, d):
    return D.transition_matrix(V.refined(spark, d), ["model", "prompt"])


def _pct_sql() -> str:
    n = {c: f'coalesce("{c}", 0)' for c in _OUTCOMES}
    total = " + ".join(n.values())
    rounded = {c: f"round_even({n[c]} / t * 1000, 0) / 10" for c in _OUTCOMES}
    residual = "100.0 - (" + " + ".join(f'"r{c}"' for c in _OUTCOMES) + ")"
    last = "CASE " + " ".join(f"WHEN {n[c]} > 0 THEN '{c}'" for c in reversed(_OUTCOMES)) + " END"
    cells = ", ".join(
        f"""CASE WHEN "{c}" IS NULL THEN NULL WHEN t = 0 THEN concat("{c}", ' (—)')
            ELSE printf('%d (%.1f%%)', "{c}", "r{c}" + CASE WHEN l = '{c}' THEN {residual} ELSE 0.0 END) END AS "{c}" """
        for c in _OUTCOMES)
    return (f"WITH m AS ({_MATRIX}), a AS (SELECT *, {total} AS t, {last} AS l FROM m), "
            f"b AS (SELECT *, {', '.join(f'{rounded[c]} AS \"r{c}\"' for c in _OUTCOMES)} FROM a) "
            f"SELECT model, prompt, initial, {cells} FROM b")


@query("transition_row_pct", _pct_sql(), ("outcomes",))
def transition_row_pct(spark, d):
    keys = ["model", "prompt"]
    return D.transition_row_pct(D.transition_matrix(V.refined(spark, d), keys), keys)


_RANK = "CASE {} WHEN 'Pass' THEN 4 WHEN 'Tests' THEN 3 WHEN 'Semantic' THEN 2 ELSE 1 END"


@query("refinement_summary", f"""
    WITH g AS (SELECT *, {_RANK.format('final')} - {_RANK.format('initial')} AS gain FROM outcomes),
    s AS (SELECT model, prompt, count(*) AS total, count(*) FILTER (WHERE gain > 0) AS improved,
        count(*) FILTER (WHERE gain < 0) AS worse, count(*) FILTER (WHERE gain = 0) AS same,
        count(*) FILTER (WHERE final = 'Pass') AS final_pass,
        {', '.join(f'count(*) FILTER (WHERE refinements_performed = {r}) AS ref{r}' for r in range(4))}
        FROM g GROUP BY model, prompt)
    SELECT *, {', '.join(f'round_even(100.0 * {c} / total * 10, 0) / 10 AS {c}_pct' for c in ('improved', 'worse', 'same', 'final_pass'))}
    FROM s""", ("outcomes",))
def refinement_summary(spark, d):
    return D.refinement_summary(V.refined(spark, d), ["model", "prompt"])


@query("pass_share_by_refinements", """
    SELECT model, prompt, r AS refinements, count(*) FILTER (WHERE refinements_performed = r) AS passes,
           round(100.0 * count(*) FILTER (WHERE refinements_performed = r) / count(*), 6) AS share
    FROM outcomes CROSS JOIN (VALUES (0), (1), (2), (3)) AS b(r) WHERE final = 'Pass' GROUP BY model, prompt, r""", ("outcomes",))
def pass_share_by_refinements(spark, d):
    shares = D.pass_share_by_refinements(V.refined(spark, d), ["model", "prompt"])
    return shares.withColumn("share", F.round("share", 6))
