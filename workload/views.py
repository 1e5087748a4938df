"""The test tables seen through the shapes the operators work on.

Row-wise views are SQL that any engine reads alike (``ROWWISE``); views that need
an order inside a group are built with the bucketed helpers.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.ordering import next_in_order, row_numbers

_CATEGORY = ("CASE {} WHEN 'error' THEN 'Syntax' WHEN 'view' THEN 'Semantic' "
             "WHEN 'signup' THEN 'Tests' ELSE '' END")

ROWWISE = {
    "trials": ("events", """
        SELECT event_id, ts, concat('m', cast(user_id % 3 AS string)) AS model,
               cast(floor(user_id / 3) AS bigint) % 3 AS fold,
               CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 75 ELSE 346 END AS seed, user_id AS task_id,
               CASE event_type WHEN 'error' THEN 'syntax' WHEN 'view' THEN 'semantic'
                    WHEN 'signup' THEN 'tests' END AS error_type
        FROM {events}"""),
    "diagnostics": ("events", """
        SELECT event_id, concat(chr(27), '[31mERROR', chr(27), '[0m Error: ',
               CASE event_type WHEN 'error' THEN 'Parsing failed' WHEN 'view' THEN 'Unknown item'
                    ELSE 'Tokenizing failed' END,
               ': expected name but got ', CASE WHEN value > 100 THEN '}' ELSE '->' END, ' at line ',
               cast(event_id % 40 AS string)) AS stderr,
               CASE event_type WHEN 'view' THEN 1 ELSE 0 END AS returncode,
               concat('m', cast(user_id % 3 AS string)) AS model,
               CASE WHEN user_id % 2 = 0 THEN 'regular' ELSE 'signature' END AS prompt,
               CASE WHEN event_id % 2 = 0 THEN 'similarity' ELSE 'coverage' END AS experiment_type,
               CASE WHEN event_id % 4 < 2 THEN 5 ELSE 10 END AS shots
        FROM {events}"""),
    "outputs": ("events", """
        SELECT event_id, concat('m', cast(user_id % 3 AS string)) AS model,
               cast(floor(user_id / 3) AS bigint) % 3 AS fold,
               CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 75 ELSE 346 END AS seed, user_id AS task_id,
               CASE WHEN user_id % 2 = 0 THEN 'regular' ELSE 'signature' END AS prompt,
               CASE event_type WHEN 'view' THEN 1 ELSE 0 END AS returncode,
               CASE event_type
                    WHEN 'error' THEN concat(chr(27), '[31mError: Parsing failed: got ', cast(value AS string))
                    ELSE '' END AS stderr,
               CASE event_type
                    WHEN 'view' THEN concat('building', chr(10), chr(27), '[1merror',
                         chr(27), '[0m: SemanticAnalysisError(@', cast(event_id AS string), '): ',
                         CASE event_id % 5 WHEN 0 THEN 'Failed to resolve symbol S'
                              WHEN 1 THEN 'Unable to resolve type T' WHEN 2 THEN 'Arrow from A is not allowed'
                              WHEN 3 THEN 'Leaf node N' ELSE 'Something odd' END,
                         cast(user_id AS string), ', backtrace: none', chr(10), 'done')
                    ELSE 'building' END AS stdout,
               concat(chr(27), '[32mtesting', chr(27), '[0m ', chr(10), '{"num_tests": 1, "num_passed": ',
                    CASE WHEN event_type IN ('click', 'purchase') THEN '1' ELSE '0' END,
                    ', "test_results": [{"name": "t", "passed": ',
                    CASE WHEN event_type IN ('click', 'purchase') THEN 'true' ELSE 'false' END,
                    ', "assertions": [{"kind": "Passed", "expect": "1", "actual": "1"}, {"kind": "',
                    CASE WHEN event_type IN ('click', 'purchase') OR event_id % 2 = 0 THEN 'Passed' ELSE 'Failed' END,
                    '", "expect": "2", "actual": "', cast(user_id AS string), '"}, {"kind": "',
                    CASE WHEN event_type IN ('click', 'purchase') THEN 'Passed' ELSE 'Failed' END,
                    '", "expect": "3", "actual": "', cast(event_id AS string), '"}]}]}', chr(10), ' end')
                    AS tests_stdout
        FROM {events}"""),
    "task_label_rows": ("lineitem", """
        SELECT l_orderkey AS task_id, concat('L', cast(l_partkey % 25 AS string)) AS label FROM {lineitem}"""),
    "catalog": ("nation", """
        SELECT concat('L', cast(n_nationkey AS string)) AS function_name, n_name AS doc
        FROM {nation} WHERE n_nationkey < 20"""),
    "placed_nodes": ("lineitem", """
        SELECT l_orderkey AS program_id,
               CASE l_returnflag WHEN 'A' THEN 'in' WHEN 'R' THEN 'out' ELSE 'instance' END AS type,
               l_extendedprice / 100 AS x, l_quantity * 10 AS y FROM {lineitem}"""),
    "chunks": ("documents", """
        SELECT doc_id AS chunk_id, lang AS corpus, text AS content,
               cast(ceil(n_chars / 4.0) AS bigint) AS tokens FROM {documents}"""),
    "programs": ("documents", """
        SELECT doc_id AS task_id, concat('import("std", Std_a1)', chr(10), 'module() main {', chr(10),
               '  func(doc: "', source, '") f', cast(doc_id AS string), ' {', chr(10),
               '    in(x: ', cast(doc_id % 7 * 50 AS string), ', y: 10, name: "a") property(Number) a_1', chr(10),
               '    instance(x: ', cast(100 + doc_id % 5 * 40 AS string), '.5, y: -20) n_2 root.std.L',
               cast(doc_id % 25 AS string), ' { name: "', lang, '" }', chr(10),
               '    data_instance(x: 260, y: 40, stableId: 3) d_3 {', chr(10), '      getter(x: 300, y: 40) { }',
               chr(10), '    }', chr(10), '    // ', translate(text, '{}', '()'), chr(10),
               '    out(x: ', cast(200 + doc_id % 3 * 200 AS string), ', y: 12) property(Number) o_4', chr(10),
               '  }', chr(10), '  module(doc: "tests of f") tests {', chr(10), '    instance(x: 1, y: 2) t_5 { name: "',
               source, '" }', chr(10), '  }', chr(10), '}', chr(10)) AS code
        FROM {documents}"""),
    "responses": ("documents", """
        SELECT doc_id AS task_id, concat(
               CASE doc_id % 3 WHEN 0 THEN '<think>plan ```midx draft``` done</think>' WHEN 1 THEN '' ELSE '<think>open ' END,
               'Answer ', lang, chr(10),
               CASE WHEN doc_id % 4 < 3 THEN concat('```midx', chr(10), 'func() f', cast(doc_id AS string), ' { } // note',
                    chr(10), translate(text, '`#/', '   '), chr(10), '# comment', chr(10), '```', chr(10)) ELSE text END,
               CASE WHEN doc_id % 4 = 1 THEN concat('more ```midx second ', source, '```') ELSE '' END) AS response
        FROM {documents}"""),
    "assertion_rows": ("orders", """
        SELECT o_orderkey AS task_id, concat('assert f', cast(o_custkey % 10 AS string), '(', cast(o_custkey AS string), ', [1, 2]) == ',
               CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN cast(o_custkey AS string) WHEN 2 THEN '[1, 2, 3]'
                    WHEN 3 THEN '"abc"' WHEN 4 THEN '-3' ELSE '1.5' END) AS assertion
        FROM {orders}"""),
    "run_names": ("events", """
        SELECT event_id, concat(CASE user_id % 3 WHEN 0 THEN 'regular' WHEN 1 THEN 'signature' ELSE 'cot' END, '_',
               CASE WHEN event_id % 2 = 0 THEN 'similarity' ELSE 'coverage' END, '_',
               CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '5' ELSE '10' END, '_shot_',
               CASE user_id % 4 WHEN 0 THEN 'phi:14b-fp16' WHEN 1 THEN 'lm_3:70b-instruct' WHEN 2 THEN 'gp-4' ELSE 'x:3b' END,
               CASE WHEN event_id % 5 = 0 THEN '' ELSE '.json' END) AS file_name
        FROM {events}"""),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A row-wise view as a DataFrame."""
    source, sql = ROWWISE[name]
    alias = f"tallyforge_{source}_{zlib.crc32(folder.encode()):08x}"
    table(spark, folder, source).createOrReplaceTempView(alias)
    return spark.sql(sql.replace("{%s}" % source, alias))


def _minute(df: DataFrame, ts: str = "ts") -> Column:
    """Minutes in time order, for both timestamp types."""
    if df.schema[ts].dataType.typeName() == "timestamp":
        return F.floor(F.unix_micros(ts) / 60_000_000)
    return F.unix_date(F.to_date(ts)) * 1440 + F.hour(ts) * 60 + F.minute(ts)


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with their position per (task, seed)."""
    rows = view(spark, folder, "trials")
    return row_numbers(rows, ["task_id", "seed"], ["ts", "event_id"], _minute(rows), "candidate_id").drop("ts")


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates without their position; enough for everything that only counts."""
    return view(spark, folder, "trials").drop("ts")


def refined(spark: SparkSession, folder: str) -> DataFrame:
    """Refinement records: first and last error category of a candidate."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    chained = next_in_order(events, ["user_id"], ["ts", "event_id"], _minute(events), "event_type", "following")
    return chained.select(
        "event_id", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.when(F.col("user_id") % 2 == 0, "regular").otherwise("signature").alias("prompt"),
        (F.col("event_id") % 4).alias("refinements_performed"),
        F.expr(_CATEGORY.format("event_type")).alias("initial_error_category"),
        F.expr(_CATEGORY.format("following")).alias("final_error_category"))


def task_labels(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "task_label_rows").distinct()


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")
