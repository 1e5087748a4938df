"""Checker-output predicates and error categories as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import clean_ansi, error_lines, strip

TEST_RESULT = ("struct<num_tests:int,num_passed:int,test_results:array<struct<name:string,passed:boolean,"
               "assertions:array<struct<kind:string,expect:string,actual:string>>>>>")
TEST_TOTALS = "struct<num_tests:int,num_passed:int>"

# Indicators, keywords, patterns, categories and messages the results depend on.
SYNTAX_INDICATORS = ("parsing failed", "error during parsing", "tokenizing", "compilererror")
READY_STARTS = ("import", "func", "module")
READY_LIBRARIES = (
    "Url", "Std", "Http", "Strings", "Time", "Testing", "Data", "Json", "CSV", "List", "Map", "Iteration",
    "Math", "LinearAlgebra", "Logic", "Scheduling", "Net", "Image", "File", "Env", "Buffer", "Sets",
    "Process", "Base64", "Hashing",
)
READY_KEYWORDS = ("instance", "data_instance", "getter", "setter", "in", "out")
SYNTAX_GROUP = r"(?d)Error:\s*(.*?)(?:\n|:)"
GOT_TOKEN = r"(?d)but got\s+(.*?)(?:$|\s|at)"
ROOT_TOKEN = "Unexpected token while parsing root"
SEMANTIC_MESSAGE = r"(?d)SemanticAnalysisError\(@\d+\): (.+?)(?:, backtrace|$)"
OTHER_MESSAGE = r"(?d)Error\s+.*?:\s*(.+?)(?:, backtrace|$)"
OTHER_SYNTAX = "Other syntax error"
OTHER_SEMANTIC = "Other Semantic Error"
SEMANTIC_RULES = (
    (("unable to resolve type",), "Type Resolution Error"),
    (("failed to reify declaration path",), "Type Resolution Error"),
    (("failed to resolve symbol",), "Symbol Resolution Error"),
    (("arrow from", "is not allowed"), "Invalid connection"),
    (("function header",), "Invalid function header"),
    (("leaf node",), "Invalid AST structure"),
    (("expected function or event",), "Expected function or event"),
    (("compiler plugin encountered errors",), "Compiler plugin error"),
    (("already exists in the symbol table",), "Duplicate symbol"),
)
ASSERTIONS_PER_TASK = 3


def compile_ready(code: Column) -> Column:
    """Whether the first word contains any keyword; blank text is not ready."""
    first = F.element_at(F.split(strip(code), r"\s+"), 1)
    keywords = READY_STARTS + READY_LIBRARIES + READY_KEYWORDS
    return first.rlike("|".join(keywords))


def lowered_output(stdout: Column, stderr: Column) -> Column:
    """Both streams as one lower-case text, for the predicates below."""
    return F.lower(F.concat_ws("\n", stdout, stderr))


def names_syntax_error(lowered: Column) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(i) for i in SYNTAX_INDICATORS])


def syntax_valid(stdout: Column, stderr: Column) -> Column:
    return ~names_syntax_error(lowered_output(stdout, stderr))


def semantic_valid(stdout: Column, stderr: Column, returncode: Column) -> Column:
    lowered = lowered_output(stdout, stderr)
    return ~names_syntax_error(lowered) & (returncode != 1) & ~lowered.contains("error")


def test_result(stdout: Column, schema: str = TEST_RESULT) -> Column:
    """Outermost ``{...}`` of the cleaned output as a struct, null when it is no JSON."""
    return F.from_json(F.regexp_extract(clean_ansi(stdout), r"(?s)\{.*\}", 0), schema)


def all_tests_passed(result: Column) -> Column:
    # Looking into a one-element array parses the text once, not once per field.
    return F.coalesce(F.exists(F.array(result), lambda r: r["num_passed"] == r["num_tests"]), F.lit(False))


def syntax_category(stderr: Column) -> Column:
    found = strip(F.regexp_extract(clean_ansi(stderr), SYNTAX_GROUP, 1))
    return F.when(F.length(found) > 0, found).otherwise(OTHER_SYNTAX)


def unexpected_tokens(stderr: Column) -> Column:
    """Tokens the parser complained about, line by line."""
    def tokens(line: Column) -> Column:
        got = F.when(line.rlike(GOT_TOKEN), strip(F.regexp_extract(line, GOT_TOKEN, 1)))
        root = F.when(line.contains(ROOT_TOKEN) & line.contains(":"), strip(F.substring_index(line, ":", -1)))
        return F.array_compact(F.array(got, root))

    return F.flatten(F.transform(F.split(clean_ansi(stderr), "\n"), tokens))


def semantic_category(message: Column) -> Column:
    """Category of one message by the first matching rule, null if none matches."""
    lowered = F.lower(message)
    picked = None
    for needles, category in SEMANTIC_RULES:
        hit = reduce(lambda a, b: a & b, [lowered.contains(n) for n in needles])
        picked = F.when(hit, category) if picked is None else picked.when(hit, category)
    return picked


def semantic_categories(messages: Column) -> Column:
    """Distinct categories of a message array; never empty."""
    found = F.array_distinct(F.array_compact(F.transform(messages, semantic_category)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER_SEMANTIC)))


def semantic_messages(messages: Column) -> Column:
    """Message texts found in an array of error lines, null when there is none."""
    def texts(message: Column) -> Column:
        first = F.regexp_extract_all(message, F.lit(SEMANTIC_MESSAGE), F.lit(1))
        second = F.regexp_extract_all(message, F.lit(OTHER_MESSAGE), F.lit(1))
        return F.transform(F.when(F.size(first) > 0, first).otherwise(second), strip)

    found = F.flatten(F.transform(messages, texts))
    return F.when(F.size(found) > 0, found)


def _assertions(result: Column) -> Column:
    tests = F.coalesce(result["test_results"], F.array())
    return F.flatten(F.transform(tests, lambda t: F.coalesce(t["assertions"], F.array())))


def tests_category(result: Column) -> Column:
    """``passed/3`` over all assertions; no result counts as ``0/3``."""
    passed = F.size(F.filter(_assertions(result), lambda a: a["kind"] == "Passed"))
    return F.concat(F.when(result.isNull(), 0).otherwise(passed).cast("string"),
                    F.lit(f"/{ASSERTIONS_PER_TASK}"))


def _or_none(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def failed_tests_text(result: Column, category: Column) -> Column:
    failed = F.filter(_assertions(result), lambda a: a["kind"] == "Failed")
    texts = F.transform(failed, lambda a: F.concat(
        F.lit("Failed test: expected `"), _or_none(a["expect"]), F.lit("`, got `"), _or_none(a["actual"]), F.lit("`")))
    return (F.when(result.isNull(), "No test results found.")
            .when((F.size(failed) == 0) & (category == f"{ASSERTIONS_PER_TASK}/{ASSERTIONS_PER_TASK}"), "All passed.")
            .otherwise(F.array_join(texts, "\n")))


def test_error_text(result: Column, category: Column, error_msg: Column) -> Column:
    """Header, failed assertions and the first four error lines."""
    return F.concat(category, F.lit(" tests passed.\n Test results:\n"), failed_tests_text(result, category),
                    F.lit("\n"), F.array_join(F.slice(error_msg, 1, 4), "\n"))


def test_feedback(result: Column, assertions: Column) -> Column:
    """Feedback text on failed tests; empty as soon as one test passed.

    The i-th assertion of a test is shown with the i-th source assertion.  A report
    without tests falls back to naming both sides.
    """
    def shown(test: Column) -> Column:
        # A test with more assertions than source texts stops at the last source text.
        paired = F.filter(
            F.arrays_zip(test["assertions"].alias("a"), assertions.alias("s")),
            lambda z: z["a"].isNotNull() & z["s"].isNotNull())
        rows = F.transform(paired, lambda z: F.concat(
            F.lit("  - Pseudocode assertion: '"), z["s"], F.lit("'. Result: "), z["a"]["kind"],
            F.lit(". Expected '"), _or_none(z["a"]["expect"]), F.lit("', got '"), _or_none(z["a"]["actual"]),
            F.lit("'\n")))
        return F.concat(
            F.lit("Tests failed, with one or more assertion errors. Here are the test results: \n"),
            F.array_join(rows, ""))

    tests = result["test_results"]
    listed = F.concat(F.lit("['"), F.array_join(assertions, "', '"), F.lit("']"))
    fallback = F.concat(F.lit("Runned these pseudocode tests: "), listed,
                        F.lit("\n But go these test results: "), F.coalesce(F.to_json(result), F.lit("{}")))
    return (F.when(F.coalesce(F.size(tests), F.lit(0)) <= 0, fallback)
            .when(F.exists(tests, lambda t: t["passed"]), "")
            .otherwise(F.array_join(F.transform(tests, shown), "")))


def refinement_feedback(stdout: Column, stderr: Column, returncode: Column, tests_stdout: Column,
                        assertions: Column, prompt_type: Column) -> Column:
    """``struct<message, category>`` used to ask for a repair of a candidate.

    Category is Syntax, Semantic, Tests or empty.  Regular prompts run no tests.
    """
    lines = error_lines(stdout)
    semantic_text = F.array_join(semantic_messages(lines), "\n")
    semantic = F.coalesce(
        F.nullif(semantic_text, F.lit("")),
        F.nullif(F.array_join(lines, "\n"), F.lit("")),
        F.nullif(F.array_join(error_lines(stderr), "\n"), F.lit("")),
        F.concat(stdout, F.lit("\n"), stderr))
    tests = test_feedback(test_result(tests_stdout), assertions)
    return (F.when(~syntax_valid(stdout, stderr),
                   F.struct(clean_ansi(stderr).alias("message"), F.lit("Syntax").alias("category")))
            .when(~semantic_valid(stdout, stderr, returncode),
                  F.struct(semantic.alias("message"), F.lit("Semantic").alias("category")))
            .when(F.lower(prompt_type) == "regular",
                  F.struct(F.lit("").alias("message"), F.lit("").alias("category")))
            .otherwise(F.struct(tests.alias("message"),
                                F.when(F.length(tests) > 0, "Tests").otherwise("").alias("category"))))
