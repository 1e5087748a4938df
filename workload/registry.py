"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import ROWWISE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_CATEGORY = ("CASE {} WHEN 'error' THEN 'Syntax' WHEN 'view' THEN 'Semantic' WHEN 'signup' THEN 'Tests' ELSE '' END")

# Check-side views: the row-wise ones plus those with an order inside a group.
_SQL_VIEWS = {name: sql.replace("{%s}" % source, source) for name, (source, sql) in ROWWISE.items()}
_SQL_VIEWS |= {
    "attempts": "SELECT * EXCLUDE (ts), row_number() OVER (PARTITION BY task_id, seed ORDER BY ts, event_id) "
                "AS candidate_id FROM trials",
    "refined": f"""
        SELECT event_id, concat('m', cast(user_id % 3 AS string)) AS model,
               CASE WHEN user_id % 2 = 0 THEN 'regular' ELSE 'signature' END AS prompt,
               event_id % 4 AS refinements_performed, {_CATEGORY.format('event_type')} AS initial_error_category,
               {_CATEGORY.format('lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)')}
               AS final_error_category FROM events""",
    "outcomes": """
        SELECT model, prompt, refinements_performed, i AS initial, f AS final FROM (
            SELECT *, CASE initial_error_category WHEN '' THEN 'Pass' ELSE initial_error_category END AS i,
                   CASE final_error_category WHEN '' THEN 'Pass' ELSE final_error_category END AS f FROM refined)
        WHERE NOT (prompt = 'regular' AND (i = 'Tests' OR f = 'Tests'))""",
    "task_labels": "SELECT DISTINCT task_id, label FROM task_label_rows",
    "staged": """
        SELECT *, CASE WHEN regexp_matches(lower(concat(stdout, ' ', stderr)),
                            'parsing failed|error during parsing|tokenizing|compilererror') THEN 'syntax'
                       WHEN returncode = 1 OR contains(lower(concat(stdout, ' ', stderr)), 'error') THEN 'semantic'
                       WHEN NOT contains(tests_stdout, '"num_passed": 1') THEN 'tests' END AS error_type FROM outputs""",
    "counts": """
        SELECT model, fold, seed, task_id, metric, count(*) AS n,
               count(*) FILTER (WHERE NOT list_contains(CASE metric WHEN 'syntax' THEN ['syntax']
                    WHEN 'semantic' THEN ['syntax', 'semantic'] ELSE ['syntax', 'semantic', 'tests'] END,
                    coalesce(error_type, ''))) AS c
        FROM trials CROSS JOIN (VALUES ('syntax'), ('semantic'), ('tests')) AS m(metric)
        GROUP BY model, fold, seed, task_id, metric""",
    "scores": """
        SELECT model, fold, seed, metric, k, avg(CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
                    ELSE 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i)) END) AS value
        FROM counts CROSS JOIN (VALUES (1), (2), (3), (5), (10)) AS ks(k)
        GROUP BY model, fold, seed, metric, k HAVING min(n) >= k""",
    "fold_scores": """
        SELECT model, fold, metric, k, round_even(avg(value) * 100, 0) / 100 AS mean,
               round_even(stddev_pop(value) * 100, 0) / 100 AS std FROM scores GROUP BY model, fold, metric, k""",
}
_NEEDS = {"attempts": ["trials"], "outcomes": ["refined"], "task_labels": ["task_label_rows"], "staged": ["outputs"],
          "counts": ["trials"], "scores": ["counts"], "fold_scores": ["scores"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix a statement with the check-side views it uses."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return sql
    views = ",\n".join(f"{n} AS ({_SQL_VIEWS[n]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query and, if SQL can express it, its check."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register
