"""Text columns on hand-made rows."""

import ast
import json
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import errors as E
from tallyforge.functions import naming as N
from tallyforge.functions import text as X


def _apply(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_ansi(spark):
    assert _apply(spark, ["\x1b[31mERR\x1b[0m \n", "\x1bMx", " plain\t"], X.clean_ansi) == ["ERR", "x", "plain"]


def test_response_code_picks_the_right_block(spark):
    texts = [
        "<think>```mid a```</think>x ```midx\nfirst // c\n``` ```midx second```",
        "<think>```mid a``` ```mid b\n# gone\nkept",
        "no block # c\nline",
        "```mid unclosed\nbody",
    ]
    assert _apply(spark, texts, X.response_code) == ["first", "b\n\nkept", "no block \nline", "unclosed\nbody"]
    assert _apply(spark, texts[:1], lambda c: X.response_code(c, True)) == ["second"]


def test_fenced_block(spark):
    assert _apply(spark, ["a ```mid A, B\n``` ```mid C```", " plain "], X.fenced_block) == ["A, B", "plain"]


def test_function_block_counts_braces(spark):
    texts = ['x func(doc: "d") f { a { b } c } tail }', "func() g { open { }", "none", 'func( doc:"two\nlines" ) h {}']
    assert _apply(spark, texts, X.function_block) == [" a { b } c ", " open { ", "", ""]


def test_function_block_on_deep_nesting(spark):
    deep = "func() f {" + "{" * 5000 + "}" * 5000 + "}rest"
    assert _apply(spark, [deep], X.function_block) == ["{" * 5000 + "}" * 5000]


def test_tests_module(spark):
    texts = ['a module(doc: "t") tests { x { y } } b', "module() tests { open", "module() other { }"]
    assert _apply(spark, texts, X.tests_module) == ['module(doc: "t") tests { x { y } }', "", ""]


def test_signature_keeps_top_level_ports(spark):
    code = 'func(doc: "d") f {\n    in(x: 1) a\n    inner(x: 2) b\n    out(x: 3) c\n    instance(x: 4) n {\n      in(x: 5) z\n    }\n}'
    assert _apply(spark, [code, "nothing"], X.signature) == [
        'func(doc: "d") f {\n    in(x: 1) a\n    out(x: 3) c\n}', "Not found"]
    assert _apply(spark, [code], X.inline_signature) == ['func(doc: "d") f {\n\tin(x: 1) a\n\tout(x: 3) c\n}']


def test_layout_nodes(spark):
    code = 'in(x: -1.5, y: +2, name: "a b") out(x: 3, y: 4) instance(x: 5, y: 6, stableId: 1) odd(x: 7,y:8, name = "q")'
    rows = _apply(spark, [code], X.layout_nodes)[0]
    assert [(r.type, r.x, r.y, r.name) for r in rows] == [("in", -1.5, 2.0, "a b"), ("out", 3.0, 4.0, None), ("odd", 7.0, 8.0, "q")]


def test_doc_args(spark):
    text = "  in(x: 0) property handler,\nout value.;:\ninstance n\nother thing\nin"
    assert _apply(spark, [text], X.doc_args) == [["handler", "value", "n", "in"]]


def _safe_truncate(text, limit):
    if len(text) <= limit:
        return text
    head = text[:limit]
    found = re.search(r"[.\n][^.\n]*$", head)
    return head[: found.start() + 1].strip() if found else head.strip() + X.TRUNCATION_NOTE


@pytest.mark.parametrize("limit", [3, 4, 5, 8])
def test_truncate_text(spark, limit):
    texts = ["abc", "a.bc def", "a.b\nccc", "a.b\n", "abcdefghij", "ab\n\ncdefg", "....x....", "\n\n\n\n\n\n", "a b.\nc d.\n"]
    assert _apply(spark, texts, lambda c: X.truncate_text(c, limit)) == [_safe_truncate(t, limit) for t in texts]


def test_close_fences(spark):
    assert _apply(spark, ["a ```x", "```a```", "none"], X.close_fences) == ["a ```x\n```", "```a```", "none"]


def test_assertions(spark):
    texts = ["assert f(1,-2) == True", "assert f(1) == -3", "assert f(1) == 1.5", 'assert g("a") == "x y"',
             "assert f([1, 2]) == [3, [4]]", "x assert f(1) == 1", "assert f('a')=='b'", "assert f() == False"]
    rows = _apply(spark, [texts], X.parsed_assertions, "array<string>")[0]
    assert [(r.function, r.input, r.kind, r.expected) for r in rows] == [
        ("f", "(1,-2)", "bool", "true"), ("f", "(1)", "int", "1"), ("g", '("a")', "string", "x y"),
        ("f", "([1, 2])", "list", "[3, [4]"), ("f", "()", "bool", "false")]


LITERALS = ["(1,-2)", "[1, [2, 3,], ]", "[True, None]", "([1, 2], [3],)", "([], )", "( )", "12", '"plain"', "(None, [False])", "([[1], 2], 3)", "(1)", "()", "(1,)", "((1))", "([1, 2],)", "('a', \"b c\")", "([1, (2, 3), [4, (5,)]], None, True)", "('it\\'s', \"say 'hi'\")", "('quote \"x\"')",
            "({'a': [1, 2.5], \"b\": {'c': False}},)", "('True, (x) [y]', .5, 5., -1e3)", "([[1, 2, ], []], 'ü😀\\n\\t\\\\')", "('\\x41', \"\")", "(' a , b ')", "(  1 ,  2  )"]


def test_literals_have_their_values(spark):
    found = _apply(spark, LITERALS, lambda c: F.to_json(X.literal_value(c)))
    as_json = lambda v: json.loads(json.dumps(v))
    assert [json.loads(f) for f in found] == [as_json(ast.literal_eval(t)) for t in LITERALS]


def test_unreadable_literals_are_null(spark):
    texts = ["({1, 2})", "({1: 2})", "(x)", "(1 + 2)", "('open)", "([1, 2)", "(f(1))", "('a' 'b')", "('\\q')", "(1))"]
    assert _apply(spark, texts, lambda c: F.to_json(X.literal_value(c))) == [None] * len(texts)


def test_typed_cases_in_order(spark):
    texts = ["assert f(1,-2) == True", "no test", "assert f([10, 20, 1]) == 45", 'assert g("a", (1, 2)) == "x y"', "assert f(x + 1) == [3, 'b']", "assert f() == False",
             "assert f(' a') == [1, x]", 'assert h(None) == "say \\"']
    rows = _apply(spark, [texts], lambda c: F.transform(X.typed_cases(c), lambda t: F.struct(t["function"], F.to_json(t["input"]), F.to_json(t["expected_output"]))), "array<string>")[0]
    assert [(r[0], json.loads(r[1]), json.loads(r[2])) for r in rows] == [
        ("f", [1, -2], True), ("f", [10, 20, 1], 45), ("g", ["a", [1, 2]], "x y"), ("f", ["x + 1"], [3, "b"]), ("f", [], False),
        ("f", " a", "[1, x]"), ("h", None, "say \\")]


def test_error_lines(spark):
    assert _apply(spark, ["ok\n \x1b[1mError: a\nfine\nsome errors ", "", None], X.error_lines) == [["Error: a", "some errors"], [], []]


def test_syntax_category_and_tokens(spark):
    texts = ["Error: Parsing failed: expected x but got } at 3\nUnexpected token while parsing root: foo: bar",
             "Error: \n", "nothing", "but got 'attr'"]
    assert _apply(spark, texts, E.syntax_category) == ["Parsing failed", "Other syntax error", "Other syntax error", "Other syntax error"]
    assert _apply(spark, texts, E.unexpected_tokens) == [["}", "bar"], [], [], ["'"]]


def test_semantic_categories_and_messages(spark):
    messages = [["Error x: Unable to resolve type T", "failed to resolve symbol", "leaf node and function header"],
                ["arrow from a", "nothing"], []]
    assert _apply(spark, messages, E.semantic_categories, "array<string>") == [
        ["Type Resolution Error", "Symbol Resolution Error", "Invalid function header"], ["Other Semantic Error"], ["Other Semantic Error"]]
    raw = [["SemanticAnalysisError(@3): one , backtrace: x SemanticAnalysisError(@4): two, backtrace"],
           ["Error here: three, backtrace"], ["plain"]]
    assert _apply(spark, raw, E.semantic_messages, "array<string>") == [["one", "two"], ["three"], None]


def test_test_results(spark):
    passed = ('{"num_tests":1,"num_passed":1,"test_results":[{"name":"t","passed":true,"assertions":['
              '{"kind":"Passed","expect":"1","actual":"1"},{"kind":"Passed","expect":"1","actual":"1"},'
              '{"kind":"Passed","expect":"1","actual":"1"}]}]}')
    failed = passed.replace('"passed":true', '"passed":false').replace('"Passed"', '"Failed"', 1).replace('"num_passed":1', '"num_passed":0')
    texts = [passed, failed, "broken {", None]
    assert _apply(spark, texts, lambda c: E.tests_category(E.test_result(c))) == ["3/3", "2/3", "0/3", "0/3"]
    assert _apply(spark, texts, lambda c: E.all_tests_passed(E.test_result(c))) == [True, False, False, False]
    shown = _apply(spark, texts, lambda c: E.failed_tests_text(E.test_result(c), E.tests_category(E.test_result(c))))
    assert shown[:2] == ["All passed.", "Failed test: expected `1`, got `1`"] and shown[3] == "No test results found."


def test_feedback_pairs_assertions_with_sources(spark):
    result = ('{"num_tests":1,"num_passed":0,"test_results":[{"name":"t","passed":false,"assertions":['
              '{"kind":"Failed","expect":"1","actual":"2"},{"kind":"Passed","expect":"3","actual":"3"}]}]}')
    rows = [("", "", 0, result, ["assert a", "assert b"], "signature"), ("", "", 0, result, ["assert a"], "regular"),
            ("", "Parsing failed", 0, "", [], "signature"), ("odd", "", 1, "", [], "signature"),
            ("", "", 0, "", ["assert a", "assert b"], "signature")]
    df = spark.createDataFrame(rows, "o string, e string, rc int, t string, a array<string>, p string")
    got = [r.f for r in df.select(E.refinement_feedback(F.col("o"), F.col("e"), F.col("rc"), F.col("t"), F.col("a"), F.col("p")).alias("f")).collect()]
    assert [g.category for g in got] == ["Tests", "", "Syntax", "Semantic", "Tests"]
    assert "'assert a'. Result: Failed. Expected '1', got '2'\n" in got[0].message
    assert got[3].message == "odd\n" and got[4].message.startswith("Runned these pseudocode tests: ['assert a', 'assert b']")


def test_compile_ready(spark):
    assert _apply(spark, ["func() x", "  print(1)", "hello world", "", "\n\t", "xMathy z"], E.compile_ready) == [
        True, True, False, False, False, True]


def test_names(spark):
    names = ["regular_coverage_1_shot_phi4:14b-fp16.json", "signature_RAG_5_shot_a_b", "regular_similarity_10_shot"]
    assert _apply(spark, names, N.experiment_of) == ["regular_coverage_1_shot", "signature_RAG_5_shot", "regular_similarity_10_shot"]
    assert _apply(spark, names, N.model_of) == ["phi4:14b-fp16", "a_b", ""]
    assert _apply(spark, names, N.prompt_type_of) == ["regular", "signature", "regular"]
    assert _apply(spark, names, N.is_similarity) == [False, False, True]
    assert _apply(spark, names, N.shots_of) == [1, 5, 10]
    assert _apply(spark, ["phi4:14b-fp16", "gpt-4o", "x:3b"], N.model_size) == ["14b", "N/A", "3b"]
    with pytest.raises(Exception, match="no shot part"):
        _apply(spark, ["nothing_here"], N.experiment_of)
