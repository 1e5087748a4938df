"""Queries: text extraction, record shaping, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import catalog as K
from tallyforge.operators import context as C
from tallyforge.operators import layout as L
from tallyforge.operators import samples as M
from tallyforge.operators import splits as P
from tallyforge.operators.ordering import id_bucket, mixed_key, numbered_in_order
from tallyforge.session import scratch_path
from tallyforge.sources import readers as R
from tallyforge.sources import runs as U
from tallyforge.sources import schemas as H
from tallyforge.sources import sinks as W
from workload import views as V
from workload.registry import query

_SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def _strip(expr: str) -> str:
    return f"trim({expr}, {_SPACE})"


# ---- text extraction -------------------------------------------------------------------------

_SECTION = "regexp_extract(response, '(?s)^(?:.*</think>)?(.*)$', 1)"
_BLOCK = f"regexp_extract_all({_SECTION}, '(?s)```mid\\w*(.*?)(?:```|$)', 1)"


@query("extract_response_code", f"""
    WITH b AS (SELECT task_id, {_SECTION} AS section, {_BLOCK} AS blocks,
               contains(response, '<think>') AND NOT contains(response, '</think>') AS unfinished FROM responses)
    SELECT task_id, {_strip("regexp_replace(coalesce(CASE WHEN unfinished THEN blocks[-1] ELSE blocks[1] END, section), '(?m)(?://|#).*$', '', 'g')")} AS code
    FROM b""", ("responses",))
def extract_response_code(spark, d):
    return V.view(spark, d, "responses").select("task_id", X.response_code(F.col("response")).alias("code"))


@query("extract_fenced_nodes", f"""
    SELECT task_id, {_strip("coalesce(regexp_extract_all(response, '(?s)```mid[a-z]*(.*?)```', 1)[1], response)")} AS nodes
    FROM responses""", ("responses",))
def extract_fenced_nodes(spark, d):
    return V.view(spark, d, "responses").select("task_id", X.fenced_block(F.col("response"), r"mid[a-z]*").alias("nodes"))


_BODY = """concat(chr(10), '    in(x: ', cast(doc_id % 7 * 50 AS string), ', y: 10, name: "a") property(Number) a_1', chr(10),
    '    instance(x: ', cast(100 + doc_id % 5 * 40 AS string), '.5, y: -20) n_2 root.std.L', cast(doc_id % 25 AS string),
    ' { name: "', lang, '" }', chr(10), '    data_instance(x: 260, y: 40, stableId: 3) d_3 {', chr(10),
    '      getter(x: 300, y: 40) { }', chr(10), '    }', chr(10), '    // ', translate(text, '{}', '()'), chr(10),
    '    out(x: ', cast(200 + doc_id % 3 * 200 AS string), ', y: 12) property(Number) o_4', chr(10), '  ')"""
_TESTS = """concat('module(doc: "tests of f") tests {', chr(10), '    instance(x: 1, y: 2) t_5 { name: "', source,
    '" }', chr(10), '  }')"""


@query("extract_function_block", f"SELECT doc_id AS task_id, {_BODY} AS block FROM documents")
def extract_function_block(spark, d):
    return V.view(spark, d, "programs").select("task_id", X.function_block(F.col("code")).alias("block"))


@query("extract_tests_module", f"SELECT doc_id AS task_id, {_TESTS} AS block FROM documents")
def extract_tests_module(spark, d):
    return V.view(spark, d, "programs").select("task_id", X.tests_module(F.col("code")).alias("block"))


@query("extract_signature", """
    SELECT doc_id AS task_id, concat('func(doc: "', source, '") f', cast(doc_id AS string), ' {', chr(10),
           chr(9), 'in(x: ', cast(doc_id % 7 * 50 AS string), ', y: 10, name: "a") property(Number) a_1', chr(10), '}') AS signature
    FROM documents""")
def extract_signature(spark, d):
    return V.view(spark, d, "programs").select("task_id", X.inline_signature(F.col("code")).alias("signature"))


@query("split_code_and_tests", f"""
    SELECT task_id, replace(code, tests, '') AS code, tests FROM programs JOIN
    (SELECT doc_id AS task_id, {_TESTS} AS tests FROM documents) USING (task_id)""", ("programs",))
def split_code_and_tests(spark, d):
    split = V.view(spark, d, "programs").withColumn("tests", X.tests_module(F.col("code"))).withColumn(
        "code", F.replace("code", "tests"))
    path = scratch_path(spark, "split-code")
    split.write.parquet(path)
    return spark.read.schema(split.schema).parquet(path)


_NODES = """WITH n AS (
    SELECT doc_id AS task_id, 'in' AS type, cast(doc_id % 7 * 50 AS double) AS x, 10.0 AS y, 'a' AS name FROM documents
    UNION ALL SELECT doc_id, 'instance', 100.5 + doc_id % 5 * 40, -20.0, NULL FROM documents
    UNION ALL SELECT doc_id, 'getter', 300.0, 40.0, NULL FROM documents
    UNION ALL SELECT doc_id, 'out', cast(200 + doc_id % 3 * 200 AS double), 12.0, NULL FROM documents)"""


@query("extract_layout_nodes", f"{_NODES} SELECT task_id, type, cast(x AS double) AS x, cast(y AS double) AS y, name FROM n")
def extract_layout_nodes(spark, d):
    return L.explode_layout(V.view(spark, d, "programs"), ["task_id"])


@query("extract_doc_args", rf"""
    SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(
           string_split(replace(replace(text, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)), chr(10)), lambda s: {_strip('s')}),
           lambda s: starts_with(s, 'in') OR starts_with(s, 'out')),
           lambda s: trim(regexp_extract(s, '(?:^|[ \t\n\r\f\v])([^ \t\n\r\f\v]+)$', 1), '.,;:')), '|') AS args
    FROM (SELECT doc_id, concat('in ', source, '.', chr(10), text, chr(10), '  out(x) ', lang, ';:', chr(10), 'other') AS text FROM documents)""")
def extract_doc_args(spark, d):
    content = F.concat(F.lit("in "), F.col("source"), F.lit(".\n"), F.col("text"), F.lit("\n  out(x) "), F.col("lang"),
                       F.lit(";:\nother"))
    return V.table(spark, d, "documents").select("doc_id", F.array_join(X.doc_args(content), "|").alias("args"))


@query("truncate_text", rf"""
    WITH h AS (SELECT doc_id, text, substr(text, 1, 300) AS head FROM documents),
    c AS (SELECT *, regexp_extract(CASE WHEN ends_with(head, chr(10)) AND regexp_matches(substr(head, 1, len(head) - 1), '[.\n]')
                 THEN substr(head, 1, len(head) - 1) ELSE head END, '(?s)^(.*[.\n])', 1) AS cut FROM h)
    SELECT doc_id, CASE WHEN len(text) <= 300 THEN text WHEN len(cut) > 0 THEN {_strip('cut')}
           ELSE concat({_strip('head')}, chr(10), ' (code has been truncated)....') END AS short FROM c""")
def truncate_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.truncate_text(F.col("text"), 300).alias("short"))


@query("close_fences", """
    SELECT task_id, CASE WHEN (len(response) - len(replace(response, '```', ''))) // 3 % 2 <> 0
           THEN concat(response, chr(10), '```') ELSE response END AS closed
    FROM (SELECT task_id, concat(response, CASE WHEN task_id % 5 = 0 THEN ' ```x' ELSE '' END) AS response FROM responses)""", ("responses",))
def close_fences(spark, d):
    text = F.concat("response", F.when(F.col("task_id") % 5 == 0, " ```x").otherwise(""))
    return V.view(spark, d, "responses").select("task_id", X.close_fences(text).alias("closed"))


_FILES_SQL = """SELECT p_partkey, concat('module Std {', chr(10), '  type Ctx Number', chr(10), '  module ', replace(p_brand, '#', '_'),
    ' {', chr(10), '    type Item Any', chr(10), '    extern func(doc: "', p_name, ' (', p_type, ')") F', cast(p_partkey AS string), ' {', chr(10),
    '      in(x: 0) a { b }', chr(10), '    }', chr(10), '    event(x: 1) E', cast(p_size AS string), ' {', chr(10),
    '      out(x: 2) c', chr(10), '    }', chr(10), '  }', chr(10), '  func G {', chr(10), '  }', chr(10), '}') AS text FROM part"""


@query("extract_catalog", """
    WITH p AS (SELECT *, replace(p_brand, '#', '_') AS b, concat('part-', cast(p_partkey AS string)) AS path FROM part)
    SELECT path, 1 AS position, 'function' AS type, concat('Std.', b, '.F', p_partkey) AS function_name, concat('Std.', b) AS module_path,
        concat(p_name, ' (', p_type, ')') AS doc, concat('extern func(doc: "', p_name, ' (', p_type, ')") F', p_partkey, ' {', chr(10),
        '      in(x: 0) a { b }', chr(10), '    }') AS body, concat('type Ctx Number', chr(10), 'type Item Any') AS types FROM p
    UNION ALL SELECT path, 2, 'event', concat('Std.', b, '.E', p_size), concat('Std.', b), '',
        concat('event(x: 1) E', p_size, ' {', chr(10), '      out(x: 2) c', chr(10), '    }'),
        concat('type Ctx Number', chr(10), 'type Item Any') FROM p
    UNION ALL SELECT path, 3, 'function', 'Std.G', 'Std', '', concat('func G {', chr(10), '  }'), 'type Ctx Number' FROM p""")
def extract_catalog(spark, d):
    V.table(spark, d, "part").createOrReplaceTempView("tallyforge_part")
    files = spark.sql(_FILES_SQL.replace("FROM part", "FROM tallyforge_part")).select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("path"), "text")
    return K.extract_catalog(files)


# ---- record shaping --------------------------------------------------------------------------

def _tasks(spark, d):
    """Nested benchmark tasks out of documents."""
    return V.table(spark, d, "documents").select(
        F.array("text", "lang").alias("prompts"), F.col("doc_id").alias("task_id"),
        (F.col("doc_id") + 600).alias("MBPP_task_id"),
        F.struct(F.concat(F.lit("func() f"), F.col("doc_id").cast("string")).alias("function_signature"),
                 F.concat(F.lit("pre "), "lang").alias("preconditions"),
                 F.concat(F.lit("post "), "source").alias("postconditions")).alias("specification"),
        F.array(F.concat(F.lit("root.std.L"), (F.col("doc_id") % 25).cast("string")), F.concat(F.lit("root."), "lang"),
                F.lit("root.std.List.Map")).alias("external_functions"),
        F.struct(F.array(F.concat(F.lit("assert f("), F.col("n_chars").cast("string"), F.lit(") == 1"))).alias("python_tests"),
                 F.concat(F.lit('{"n": '), F.col("n_chars").cast("string"), F.lit("}")).alias("tests")).alias("testing"),
        F.concat(F.lit("flow "), "source").alias("flow_description"))


_LABELS = "concat('L', cast(doc_id % 25 AS string), ', root.', lang, ', List.Map')"


@query("flatten_code_sample", f"""
    SELECT cast(doc_id + 600 AS string) AS "MBPP_task_id", cast(doc_id AS string) AS task_id, text AS task,
        CASE WHEN lang = 'fr' THEN 'File not found' ELSE concat('code ', source) END AS response, {_LABELS} AS external_functions,
        concat('assert f(', n_chars, ') == 1') AS python_tests, concat('{{"n": ', n_chars, '}}') AS tests,
        concat('func() f', doc_id) AS function_signature, concat('pre ', lang) AS preconditions,
        concat('post ', source) AS postconditions, concat('flow ', source) AS flow_description FROM documents""")
def flatten_code_sample(spark, d):
    code = V.table(spark, d, "documents").filter("lang <> 'fr'").selectExpr("doc_id AS task_id", "concat('code ', source) AS code")
    flat = M.flatten_code_sample(R.code_by_task(_tasks(spark, d), code))
    return flat.withColumn("python_tests", F.array_join("python_tests", "|"))


@query("flatten_node_sample", f"""
    SELECT cast(doc_id + 600 AS string) AS "MBPP_task_id", cast(doc_id AS string) AS task_id, text AS task,
        {_LABELS} AS response, {_LABELS} AS external_functions FROM documents""")
def flatten_node_sample(spark, d):
    return M.flatten_node_sample(_tasks(spark, d))


@query("code_to_node_sample", f"""
    SELECT cast(doc_id AS string) AS task_id, {_LABELS} AS response, {_LABELS} AS external_functions FROM documents""")
def code_to_node_sample(spark, d):
    tasks = _tasks(spark, d).withColumn("code", F.lit("code"))
    return M.code_to_node_sample(M.flatten_code_sample(tasks)).select("task_id", "response", "external_functions")


@query("split_label_string", """
    SELECT p_partkey, concat(replace(p_name, ' ', '|'), '|', p_type) AS labels FROM part""")
def split_label_string(spark, d):
    parts = V.table(spark, d, "part").selectExpr("p_partkey", "concat(replace(p_name, ' ', ' , '), ',', p_type) AS labels")
    return M.split_label_string(parts, "labels").withColumn("labels", F.array_join("labels", "|"))


@query("drop_nested_field", """
    SELECT doc_id AS task_id, concat('{"python_tests":["assert f(', n_chars, ') == 1"]}') AS testing FROM documents""")
def drop_nested_field(spark, d):
    return M.drop_nested_field(_tasks(spark, d)).select("task_id", F.to_json("testing").alias("testing"))


_ASSERTION = r"""^assert\s+(\w+)\((.*?)\)\s*==\s*(True|False|\d+|\[.*?\]|".*?")"""


_CASES = rf"""a AS (SELECT task_id, regexp_extract(assertion, '{_ASSERTION}', 1) AS function,
        concat('(', regexp_extract(assertion, '{_ASSERTION}', 2), ')') AS input, regexp_extract(assertion, '{_ASSERTION}', 3) AS e
        FROM assertion_rows WHERE regexp_matches(assertion, '{_ASSERTION}')),
    typed AS (SELECT *, replace(replace(replace(input, '(', '['), ')', ']'), ' ', '') AS input_value,
        CASE WHEN e IN ('True', 'False') THEN lower(e) ELSE replace(e, ' ', '') END AS expected_value FROM a)"""


@query("parse_assertions", f"""
    WITH {_CASES} SELECT task_id, function, input, CASE WHEN e IN ('True', 'False') THEN 'bool' WHEN e[1] = '[' THEN 'list'
        WHEN e[1] = '"' THEN 'string' ELSE 'int' END AS kind,
        CASE WHEN e IN ('True', 'False') THEN lower(e) ELSE trim(e, '"') END AS expected, input_value, expected_value,
        CASE WHEN e IN ('True', 'False') THEN 'BOOLEAN' WHEN e[1] = '[' THEN 'ARRAY<BIGINT>' WHEN e[1] = '"' THEN 'STRING' ELSE 'BIGINT' END AS expected_type
    FROM typed""", ("assertion_rows",))
def parse_assertions(spark, d):
    rows = V.view(spark, d, "assertion_rows").select("task_id", F.array("assertion").alias("tests"))
    parsed = rows.select("task_id", F.explode(F.arrays_zip(X.parsed_assertions(F.col("tests")).alias("p"), X.typed_cases(F.col("tests")).alias("t"))).alias("z"))
    return parsed.select("task_id", "z.p.*", F.to_json("z.t.input").alias("input_value"), F.to_json("z.t.expected_output").alias("expected_value"),
                         F.schema_of_variant("z.t.expected_output").alias("expected_type"))


@query("assertion_cases", f"""
    WITH {_CASES} SELECT r.task_id % 1000 AS group_id, count(function) AS cases,
        coalesce(string_agg(function || ' ' || input_value || ' ' || expected_value, chr(10) ORDER BY r.task_id), '') AS test_cases
    FROM assertion_rows r LEFT JOIN typed t ON t.task_id = r.task_id GROUP BY r.task_id % 1000""", ("assertion_rows",))
def assertion_cases(spark, d):
    """The test cases of a task, collected in order."""
    rows = V.view(spark, d, "assertion_rows")
    lists = rows.groupBy(F.expr("task_id % 1000").alias("group_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("task_id", "assertion"))), lambda r: r["assertion"]).alias("tests"))
    cases = lists.select("group_id", X.typed_cases(F.col("tests")).alias("cases"))
    written = F.transform("cases", lambda c: F.concat_ws(" ", c["function"], F.to_json(c["input"]), F.to_json(c["expected_output"])))
    return cases.select("group_id", F.size("cases").cast("long").alias("cases"), F.array_join(written, "\n").alias("test_cases"))


@query("catalog_text", """
    WITH p AS (SELECT p_brand, p_partkey >> 12 AS stretch, row_number() OVER (PARTITION BY p_brand, p_partkey >> 12 ORDER BY p_partkey) AS pos,
        concat('Function node name: F', p_partkey, chr(10), ' Documentation: ', p_name, chr(10), chr(10)) AS t FROM part)
    SELECT p_brand, stretch, cast((pos - 1) // 50 AS bigint) AS part, count(*) AS chunks, string_agg(t, '' ORDER BY pos) AS text FROM p GROUP BY ALL""")
def catalog_text(spark, d):
    entry = M.catalog_entry_text(F.concat(F.lit("F"), F.col("p_partkey").cast("string")), F.col("p_name"))
    entries = V.table(spark, d, "part").select("p_brand", "p_partkey", entry.alias("content"))
    return C.ordered_concat(entries, ["p_brand"], ["p_partkey"], id_bucket("p_partkey", 12), per_part=50, separator="")


# ---- sources and sinks -----------------------------------------------------------------------

_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
_ORDERS_DDL = "o_orderkey long, o_orderstatus string, o_totalprice double"


def _orders(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _write_array(rows, order: str | None, separator: str, path: str) -> None:
    """One file with one array: that a file is large is what its reader is for, so one task writes it (and sorts only where the order counts)."""
    if order:
        made = rows.repartitionByRange(1, order).sortWithinPartitions(order).select(F.to_json(F.struct("*")).alias("json"))
    else:
        made = rows.select(F.to_json(F.struct("*")).alias("json")).repartition(1)
    made = made.select("json", F.monotonically_increasing_id().alias("i"))
    first = made.select(F.concat(F.when(F.col("i") == 0, F.lit("[")).otherwise(F.lit(separator)), "json").alias("value"))
    first.union(rows.sparkSession.range(1).select(F.lit("]"))).coalesce(1).write.option("lineSep", " ").text(path)


@query("scan_json_array", _ORDERS)
def scan_json_array(spark, d):
    path = scratch_path(spark, "json-array")
    _write_array(_orders(spark, d), None, ",", path)
    return R.read_json_array(spark, path, _ORDERS_DDL)


@query("scan_jsonl", "SELECT source AS file, cast(doc_id AS string) AS chunk_id, text AS content FROM documents")
def scan_jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    V.table(spark, d, "documents").selectExpr(
        "source AS file", "cast(doc_id AS string) AS chunk_id", "text AS content").write.json(path)
    return R.read_jsonl(spark, path, H.CHUNKS)


@query("distinct_task_ids", """
    SELECT user_id AS task_id, row_number() OVER (ORDER BY min(struct_pack(form := event_id % 2, event := event_id))) AS place FROM events GROUP BY user_id""")
def distinct_task_ids(spark, d):
    """A folder of both forms: an array of the even events, then lines of the odd ones."""
    path = scratch_path(spark, "task-ids")
    events = V.table(spark, d, "events").select("event_id", F.col("user_id").alias("task_id"))
    _write_array(events.filter("event_id % 2 = 0"), "event_id", ",\n", f"{path}/form=0")
    events.filter("event_id % 2 = 1").repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("task_id").write.json(f"{path}/form=1")
    found = R.read_task_ids(spark, path)
    return numbered_in_order(found, ["first_pos"], "place").select("task_id", "place")


@query("scan_code_files", """
    SELECT s_suppkey AS task_id, CASE WHEN s_acctbal > 0 THEN concat('func() f', s_suppkey, ' {', chr(10), '  ', s_name, chr(10), '}')
           ELSE 'File not found' END AS code FROM supplier""")
def scan_code_files(spark, d):
    path = scratch_path(spark, "code-files")
    suppliers = V.table(spark, d, "supplier")
    programs = suppliers.filter("s_acctbal > 0").selectExpr(
        "s_suppkey AS task_id", "concat('\\n func() f', s_suppkey, ' {\\n  ', s_name, '\\n}\\n ') AS value")
    # Files take long to make, so their programs are dealt to many tasks, however few the table's are.
    programs.repartition(4 * spark.sparkContext.defaultParallelism, "task_id").write.partitionBy("task_id").text(path)
    return R.code_by_task(suppliers.select(F.col("s_suppkey").alias("task_id")), R.read_code_files(spark, f"{path}/*"))


def _write_runs(spark, d, candidates: str, tag: str) -> str:
    path = scratch_path(spark, tag)
    V.table(spark, d, "events").selectExpr(
        "'e' AS experiment_name", "event_id AS seed", "concat('m', user_id % 3) AS model", "100 AS largest_context",
        f"map(cast(user_id AS string), {candidates}) AS task_candidates").write.json(path)
    return path


_EXPLODED = """
    SELECT event_id AS seed, concat('m', cast(user_id % 3 AS string)) AS model, user_id AS task_id, c AS candidate_id,
           concat(event_type, '-', cast(c AS string)) AS code FROM events CROSS JOIN (VALUES (1), (2)) AS v(c)"""
_EXPLODED_COLUMNS = ("seed", "model", "task_id", "candidate_id", "code")


@query("explode_runs", _EXPLODED)
def explode_runs(spark, d):
    path = _write_runs(spark, d, "array(concat(event_type, '-1'), concat(event_type, '-2'))", "runs")
    return U.explode_runs(spark.read.schema(H.RUNS).json(path)).select(*_EXPLODED_COLUMNS)


@query("normalize_refined_runs", _EXPLODED)
def normalize_refined_runs(spark, d):
    record = ("named_struct('task_id', cast(user_id AS string), 'n', {0}, 'final_code_candidate', concat(event_type, '-{0}'), "
              "'initial_code_candidate', 'x')")
    path = _write_runs(spark, d, f"array({record.format(1)}, {record.format(2)})", "refined-runs")
    return U.explode_runs(U.normalize_refined_runs(spark.read.schema(H.REFINED_RUNS).json(path))).select(*_EXPLODED_COLUMNS)


@query("repair_run_records", """
    SELECT event_id AS seed, CASE WHEN event_id % 2 = 0 THEN cast(user_id * 10 + 2012 AS bigint) ELSE 100 END AS largest_context,
           user_id AS task_id, c AS candidate_id, concat(event_type, '-', cast(c AS string)) AS code
    FROM events CROSS JOIN (VALUES (1), (2)) AS v(c)""")
def repair_run_records(spark, d):
    path = scratch_path(spark, "malformed-runs")
    V.table(spark, d, "events").selectExpr("""concat('{"seed": ', event_id, ', "largest_context": 100, "task_candidates": {"', user_id,
        '": ', CASE WHEN event_id % 2 = 0 THEN '[' ELSE '' END, '["', event_type, '-1", "', event_type, '-2"]',
        CASE WHEN event_id % 2 = 0 THEN concat(', ', user_id * 10, ']') ELSE '' END, '}}') AS value""").write.text(path)
    repaired = U.repair_run_records(spark.read.schema(H.MALFORMED_RUNS).json(path))
    return U.explode_runs(repaired).select("seed", "largest_context", "task_id", "candidate_id", "code")


@query("sink_json", _ORDERS)
def sink_json(spark, d):
    path = scratch_path(spark, "sink")
    W.write_json(_orders(spark, d).select("o_orderkey"), path)
    W.write_json(_orders(spark, d), path)
    return R.read_jsonl(spark, path, _ORDERS_DDL)


@query("sink_append", _ORDERS)
def sink_append(spark, d):
    path = scratch_path(spark, "append")
    orders = _orders(spark, d)
    W.append_json(orders.filter("o_orderstatus = 'O'"), path)
    W.append_json(orders.filter("o_orderstatus <> 'O'"), path)
    orders.selectExpr("concat('{\"o_orderkey\": ', o_orderkey, ', broken') AS value").write.mode("append").text(path)
    return R.read_clean_jsonl(spark, path, _ORDERS_DDL)


@query("export_collection", """
    SELECT cast(c_custkey AS string) AS c_custkey, c_name, concat('["', c_mktsegment, '","x, y"]') AS tags FROM customer""")
def export_collection(spark, d):
    path = scratch_path(spark, "export-csv")
    rows = V.table(spark, d, "customer").select(
        "c_custkey", "c_name", "c_acctbal", F.array("c_mktsegment", F.lit("x, y")).alias("tags"))
    W.export_table(rows, path, "csv", ("c_acctbal",))
    return spark.read.schema("c_custkey string, c_name string, tags string").csv(path, header=True, escape='"')


@query("write_split_files", """
    WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY (doc_id % 2147483647) * 1103515245 % 2147483647, doc_id) - 1) % 3 AS own FROM documents)
    SELECT doc_id, cast(f AS int) AS fold, CASE WHEN own = f THEN 'test' ELSE 'train' END AS role
    FROM p CROSS JOIN (VALUES (0), (1), (2)) AS v(f)""")
def write_split_files(spark, d):
    path = scratch_path(spark, "splits")
    folded = P.kfold_split(V.table(spark, d, "documents").select("doc_id"), "doc_id", 3, key=mixed_key("doc_id"))
    W.write_splits(P.fold_roles(folded, 3), path, ("fold", "role"))
    return spark.read.schema("doc_id long, fold int, role string").json(path)
