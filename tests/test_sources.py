"""Readers, run files, sinks and the catalog on hand-made files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.catalog import extract_catalog
from tallyforge.operators.samples import catalog_frame
from tallyforge.session import scratch_path, shared_folder
from tallyforge.sources import readers as R
from tallyforge.sources import runs as U
from tallyforge.sources import schemas as H
from tallyforge.sources import sinks as W


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_task_ids_of_both_file_forms(spark, tmp_path):
    array, lines = tmp_path / "a.json", tmp_path / "b.jsonl"
    array.write_text(json.dumps([{"task_id": "7"}, {"task_id": 3}, {"task_id": 7}, {"task_id": 1}], indent=2))
    lines.write_text('{"task_id": 7}\n\n{"task_id": "3"}\n{"task_id": 7}\n{"task_id": 1}\n')
    for path in (array, lines):
        assert [r.task_id for r in R.read_task_ids(spark, str(path)).orderBy("first_pos").collect()] == [7, 3, 1]
    many = tmp_path / "many"
    many.mkdir()
    (many / "a.json").write_text('\n [{"task_id": 9}]')
    (many / "b.jsonl").write_text("\n" + "".join(f'{{"task_id": {i}, "pad": "{"x" * 900}"}}\n' for i in range(50, 0, -1)))
    assert [r.task_id for r in R.read_task_ids(spark, str(many)).orderBy("first_pos").collect()] == [9, *[i for i in range(50, 0, -1) if i != 9]]


def awkward_records(n):
    rng = random.Random(n)
    parts = ["}", "{", '"', "\\", "]", "[", ",", "\n", "é", "{}", '"}', "\\\\", "x" * 50]
    return [{"id": i, "text": "".join(rng.choices(parts, k=rng.randrange(8))), "list": [{"a": "}"}, {"a": rng.choice(parts)}][:rng.randrange(3)]} for i in range(n)]


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False)])
def test_large_arrays_are_read_by_many_tasks(spark, tmp_path, indent, ascii_only):
    """Strings full of braces and quotes, cut anywhere."""
    records = awkward_records(3000)
    (tmp_path / "a.json").write_text(json.dumps(records, indent=indent, ensure_ascii=ascii_only))
    (tmp_path / "b.json").write_text(" []\n")
    (tmp_path / "c.json").write_text(json.dumps(records[:2]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        pieces = R._pieces(spark, str(tmp_path))
        tasks = pieces.filter(F.col("file").endswith("a.json")).select("start").distinct().count()
        rows = R.read_json_array(spark, str(tmp_path), "id int, text string, list array<struct<a:string>>").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert tasks > 5
    found = sorted(json.dumps({"id": r.id, "text": r.text, "list": [{"a": x.a} for x in r.list]}) for r in rows)
    assert found == sorted(map(json.dumps, records + records[:2]))


def test_nested_tasks(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{
        "prompts": ["p"], "task_id": 1, "MBPP_task_id": 2, "external_functions": ["root.std.A"],
        "testing": {"python_tests": ["assert x"], "tests": {"test_cases": [{"input": [1], "expected_output": True}]}}}]))
    row = R.read_json_array(spark, str(tmp_path / "t.json"), H.TASKS).first()
    assert json.loads(row.testing.tests) == {"test_cases": [{"input": [1], "expected_output": True}]}
    assert row.specification is None


def test_code_files_by_task(spark, tmp_path):
    (tmp_path / "task_id_4.src").write_text("\n code {\n}\n ")
    tasks = spark.createDataFrame([(4,), (5,)], "task_id long")
    got = {r.task_id: r.code for r in R.code_by_task(tasks, R.read_code_files(spark, str(tmp_path))).collect()}
    assert got == {4: "code {\n}", 5: "File not found"}


def test_many_code_folders_are_written_and_listed_by_shared_tasks(spark, tmp_path, monkeypatch):
    from workload import text_queries

    spark.range(90).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "double(id % 3) AS s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(text_queries, "scratch_path", lambda spark, tag: str(tmp_path / tag))
    spark.sparkContext.setJobGroup("code-files", "")
    got = {r.task_id: r.code for r in text_queries.scan_code_files(spark, str(tmp_path)).collect()}
    spark.sparkContext.setJobGroup("", "")
    assert got == {i: f"func() f{i} {{\n  S{i}\n}}" if i % 3 else "File not found" for i in range(90)}
    writers = {f.name[:10] for f in (tmp_path / "code-files").glob("*/part-*")}
    assert len(writers) > 4   # 1 before
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("code-files") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism < 60   # 60, one a folder, before


def test_runs_count_candidates_from_one(spark, tmp_path):
    run = {"experiment_name": "e", "seed": 3, "model": "m", "task_candidates": {"8": ["a", "b"], "9": []}}
    (tmp_path / "r.json").write_text(json.dumps([run]))
    runs = R.read_json_array(spark, str(tmp_path / "r.json"), H.RUNS)
    assert [(r.task_id, r.candidate_id, r.code) for r in U.explode_runs(runs).collect()] == [(8, 1, "a"), (8, 2, "b")]


def test_repair_only_touches_malformed_entries(spark, tmp_path):
    rows = [{"seed": 1, "largest_context": 5, "task_candidates": {"1": [["a", "b"], 900], "2": [["c"], 70], "3": ["d", "e"]}},
            {"seed": 2, "largest_context": 6, "task_candidates": {"1": ["a", "12"]}}]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in rows))
    fixed = {r.seed: r for r in U.repair_run_records(spark.read.schema(H.MALFORMED_RUNS).json(str(tmp_path / "r.json"))).collect()}
    assert fixed[1].largest_context == 900 + 2012
    assert fixed[1].task_candidates == {"1": ["a", "b"], "2": ["c"], "3": ["d", "e"]}
    assert (fixed[2].largest_context, fixed[2].task_candidates) == (6, {"1": ["a", "12"]})


def test_corrupt_lines_are_left_out(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1}\n{"a": 2, broken\n[]\n{"a": 3}\n')
    assert sorted(r.a for r in R.read_clean_jsonl(spark, str(tmp_path), "a int").collect() if r.a is not None) == [1, 3]


def test_split_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    W.write_splits(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train", "split=test"}


def test_csv_export_keeps_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b "q", c'])], "id int, tags array<string>")
    W.export_table(df, str(tmp_path / "c"), "csv")
    row = spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first()
    assert json.loads(row.tags) == ["a", 'b "q", c']


LIBRARY = '''
@version("1")
module Std {
    type Count Number
    extern func(doc: "Calls (it) `x`.") Call {
        in(x: 0) a
    }

    module Math {
        type Num Any
        func Add {
            body { nested }
            func Inner {
            }
        }
        extern event(doc: "Tick") Tick {
        }
    }
    event(x: 1) Done {
        out(x: 1) b
    }
}
module Http {
    extern func NoDoc {
    }
}
'''


def test_catalog_rows(spark, tmp_path):
    (tmp_path / "lib").write_text(LIBRARY)
    rows = catalog_frame(spark, str(tmp_path / "lib")).orderBy("position").collect()
    assert [(r.type, r.function_name, r.module_path, r.doc) for r in rows] == [
        ("function", "Std.Call", "Std", "Calls (it) `x`."), ("function", "Std.Math.Add", "Std.Math", ""),
        ("event", "Std.Math.Tick", "Std.Math", "Tick"), ("event", "Std.Done", "Std", ""), ("function", "Http.NoDoc", "Http", "")]
    assert rows[1].types == "type Count Number\ntype Num Any" and rows[3].types == "type Count Number" and rows[4].types == ""
    assert rows[1].body.startswith("func Add {") and rows[1].body.count("{") == rows[1].body.count("}") == 3


def test_catalog_of_many_files(spark):
    files = spark.range(0, 500, numPartitions=4).select(
        F.col("id").cast("string").alias("path"), F.lit("module M {\nfunc F {\n}\n}").alias("text"))
    got = extract_catalog(files)
    assert got.count() == 500 and got.select("function_name").distinct().collect()[0][0] == "M.F"


def test_array_is_written_without_sorting_it(spark, tmp_path):
    """The one task that writes a large array streams it unless an order is asked for."""
    from workload.text_queries import _write_array

    rows = spark.range(500).selectExpr("id", "concat('x', id) AS s").repartition(7)
    _write_array(rows, None, ",", str(tmp_path / "a"))
    texts = [p.read_text() for p in (tmp_path / "a").glob("part-*") if p.stat().st_size]
    assert len(texts) == 1 and sorted(r["id"] for r in json.loads(texts[0])) == list(range(500))
    found = R.read_json_array(spark, str(tmp_path / "a"), "id long, s string")
    assert sorted(map(tuple, found.collect())) == [(i, f"x{i}") for i in range(500)]


def test_pieces_are_summed_in_stretches(spark, tmp_path, monkeypatch):
    """A file's part is many stretches; their number changes nothing about the records."""
    rows = [{"id": i, "s": "{}\"" * (i % 4) + "x"} for i in range(300)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.json").write_text(json.dumps(rows))
    (tmp_path / "b" / "two.json").write_text(json.dumps(rows[::-1], indent=1))
    monkeypatch.setattr(R, "_STRETCH_BITS", 3)
    found = R.read_json_array(spark, str(tmp_path / "b"), "id long, s string")
    assert sorted(map(tuple, found.collect())) == sorted(2 * [(r["id"], r["s"]) for r in rows])
