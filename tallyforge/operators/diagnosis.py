"""Error analytics: category counts, comparisons, funnels and refinement outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import errors as E
from tallyforge.functions.rounding import round_half_even
from tallyforge.functions.text import split_labels
from tallyforge.operators.scoring import METRICS

# Outcome classes in display order with their rank, and the most refinements made.
OUTCOMES = ("Pass", "Tests", "Semantic", "Syntax")
OUTCOME_RANK = {"Pass": 4, "Tests": 3, "Semantic": 2, "Syntax": 1}
REFINEMENT_BUCKETS = (0, 1, 2, 3)
PARSING_FAILED = "Parsing failed"


def _with_share(counts: DataFrame, keys: Sequence[str], count: str = "count", out: str = "percentage") -> DataFrame:
    """Add the share of ``count`` in the total of its key, in percent."""
    if not keys:
        total = counts.agg(F.sum(count)).scalar()
        return counts.withColumn(out, F.col(count) / total * 100)
    totals = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum(count).alias("__total"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return counts.join(totals, same).select(*counts.columns, (F.col(count) / F.col("__total") * 100).alias(out))


def _categories(df: DataFrame, column: str) -> Column:
    """Any category column as an array: arrays stay, text is a comma list, the rest becomes text; null is ``None``."""
    kind = df.schema[column].dataType.typeName()
    if kind == "array":
        return F.coalesce(F.col(column), F.array(F.lit("None")))
    if kind == "string":
        return split_labels(F.coalesce(F.col(column), F.lit("None")))
    return F.array(F.coalesce(F.col(column).cast("string"), F.lit("None")))


def category_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and percentage of each category, overall or per key."""
    rows = df.select(*keys, F.explode(_categories(df, column)).alias("category"))
    counts = rows.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("count"))
    return _with_share(counts, keys)


def errors_by_type(errors: DataFrame, model: str | None = None, metric: str | None = None) -> DataFrame:
    rows = errors if model is None else errors.filter(F.col("model_name") == model)
    rows = rows if metric is None else rows.filter(F.col("metric") == metric)
    return rows.groupBy("error_type").agg(F.count(F.lit(1)).alias("count"))


def error_funnel(errors: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Flow total -> syntax -> semantic -> tests as (source, target, value) rows per key.

    The total is the number of error rows of the key.
    """
    by_key = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__total"), *[F.count_if(F.col("error_type") == m).alias(m) for m in METRICS])
    valid_syntax = F.col("__total") - F.col("syntax")
    valid_semantic = valid_syntax - F.col("semantic")
    links = [
        ("Total Candidates", "Syntax Valid", valid_syntax), ("Total Candidates", "Syntax Error", F.col("syntax")),
        ("Syntax Valid", "Semantic Valid", valid_semantic), ("Syntax Valid", "Semantic Error", F.col("semantic")),
        ("Semantic Valid", "Tests Passed", valid_semantic - F.col("tests")),
        ("Semantic Valid", "Tests Error", F.col("tests")),
    ]
    cells = F.explode(F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), v.alias("value")) for s, t, v in links]))
    return by_key.select(*keys, cells.alias("__link")).select(*keys, "__link.*")


def categorize_errors(errors: DataFrame, metric: str) -> DataFrame:
    """Add the category columns that belong to a metric."""
    if metric == "syntax":
        return errors.select(
            "*", F.col("stderr").alias("syntax_error"), E.unexpected_tokens(F.col("stderr")).alias("syntax_parsing_error"),
            E.syntax_category(F.col("stderr")).alias("syntax_category"))
    if metric == "semantic":
        return errors.select(
            "*", E.semantic_messages(F.col("error_msg")).alias("semantic_error"),
            E.semantic_categories(F.col("error_msg")).alias("semantic_category"))
    if metric == "tests":
        staged = errors.withColumn("tests_category", E.tests_category(F.col("test_result")))
        return staged.withColumn("tests_error", E.test_error_text(
            F.col("test_result"), F.col("tests_category"), F.col("error_msg")))
    raise ValueError(f"unknown metric: {metric}")


def category_comparison(errors: DataFrame, metric: str, keys: Sequence[str],
                        parsing_tokens: bool = False) -> DataFrame:
    """Category counts and percentages for every key combination in one aggregation.

    ``parsing_tokens`` breaks failed parses down by unexpected token instead.
    """
    rows = categorize_errors(errors, metric)
    if "error_type" in errors.columns:
        rows = rows.filter(F.col("error_type") == metric)
    if parsing_tokens and metric == "syntax":
        return category_counts(rows.filter(F.col("syntax_category") == PARSING_FAILED), "syntax_parsing_error", keys)
    return category_counts(rows, f"{metric}_category", keys)


def top_categories(comparison: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` largest categories per key with their rank; ties go by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc("percentage"), "category")
    return comparison.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def model_doc_counts(docs: DataFrame, phases: Sequence[str] = ()) -> DataFrame:
    """Documents per model plus a row with the grand total (model null)."""
    return docs.rollup("model_name").agg(
        F.count(F.lit(1)).alias("count"), *[F.count_if(F.col("phase") == p).alias(p) for p in phases])


def error_count_model(errors: DataFrame, model: str, phase: str) -> DataFrame:
    return errors.filter((F.col("model_name") == model) & (F.col("phase") == phase)).agg(
        F.count(F.lit(1)).alias("count"))


def error_log(scored: DataFrame, eval_method: Column, fold: str | None = "fold") -> DataFrame:
    """Failing candidates as stored error rows, with the seed of the attempt and the time.

    The fold is kept for k-fold runs only.
    """
    rows = scored.filter(~F.col("passed")).withColumn("eval_method", eval_method)
    if fold:
        rows = rows.withColumn(fold, F.when(F.col("eval_method") == "3_fold", F.col(fold)))
    return rows.withColumns({"seed": F.col("seed") * F.col("candidate_id"), "created_at": F.current_timestamp()})


def _outcome(column: str) -> Column:
    return F.when(F.col(column) == "", "Pass").otherwise(F.col(column))


def _rank(outcome: Column) -> Column:
    expr = F.lit(None).cast("int")
    for name, rank in OUTCOME_RANK.items():
        expr = F.when(outcome == name, rank).otherwise(expr)
    return expr


def refinement_outcomes(refined: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Refinement records with both outcomes named and ranked.

    Records with an unknown outcome are left out; regular prompts know no ``Tests``.
    """
    rows = refined.withColumn("initial", _outcome("initial_error_category")).withColumn(
        "final", _outcome("final_error_category"))
    known = F.col("initial").isin(*OUTCOMES) & F.col("final").isin(*OUTCOMES)
    tests = (F.col("initial") == "Tests") | (F.col("final") == "Tests")
    return rows.filter(known & ~(tests & (F.col(prompt) == "regular")))


def transition_matrix(refined: DataFrame, keys: Sequence[str], prompt: str = "prompt") -> DataFrame:
    """Counts from initial (rows) to final outcome (columns) per key, zeros included.

    For regular prompts the ``Tests`` row is left out and the ``Tests`` column is null.
    """
    rows = refinement_outcomes(refined, prompt)
    cells = rows.groupBy(*keys).agg(*[
        F.count_if((F.col("initial") == a) & (F.col("final") == b)).alias(f"__{a}_{b}")
        for a in OUTCOMES for b in OUTCOMES])
    lines = F.explode(F.array(*[
        F.struct(F.lit(a).alias("initial"), *[F.col(f"__{a}_{b}").alias(b) for b in OUTCOMES]) for a in OUTCOMES]))
    matrix = cells.select(*keys, lines.alias("__line")).select(*keys, "__line.*")
    regular = F.col(prompt) == "regular"
    return matrix.filter(~(regular & (F.col("initial") == "Tests"))).withColumn(
        "Tests", F.when(~regular, F.col("Tests")))


def transition_row_pct(matrix: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    """Cells as ``count (pct%)``; the rounding residual goes to the last non-zero cell.

    Works inside each row; no shuffle.
    """
    count = {c: F.coalesce(F.col(c), F.lit(0)) for c in OUTCOMES}
    total = reduce(lambda a, b: a + b, count.values())
    rounded = {c: round_half_even(n / F.nullif(total, F.lit(0)) * 100, digits) for c, n in count.items()}
    residual = F.lit(100.0) - reduce(lambda a, b: a + b, rounded.values())
    last = F.lit(None).cast("string")
    for c in OUTCOMES:
        last = F.when(count[c] > 0, c).otherwise(last)
    staged = matrix.select(*keys, "initial", *OUTCOMES, total.alias("__total"), residual.alias("__residual"),
                           last.alias("__last"), *[rounded[c].alias(f"__{c}") for c in OUTCOMES])

    def cell(c: str) -> Column:
        pct = F.col(f"__{c}") + F.when(F.col("__last") == c, F.col("__residual")).otherwise(0.0)
        return (F.when(F.col(c).isNull(), F.lit(None))
                .when(F.col("__total") == 0, F.concat(F.col(c).cast("string"), F.lit(" (—)")))
                .otherwise(F.format_string(f"%d (%.{digits}f%%)", F.col(c), pct)))

    return staged.select(*keys, "initial", *[cell(c).alias(c) for c in OUTCOMES])


def refinement_summary(refined: DataFrame, keys: Sequence[str], prompt: str = "prompt") -> DataFrame:
    """Improved, worse, same and final-pass counts with percentages, and records per refinement count."""
    rows = refinement_outcomes(refined, prompt).withColumn(
        "__gain", _rank(F.col("final")) - _rank(F.col("initial")))
    counts = {"improved": F.col("__gain") > 0, "worse": F.col("__gain") < 0, "same": F.col("__gain") == 0,
              "final_pass": F.col("final") == "Pass"}
    summed = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()],
        *[F.count_if(F.col("refinements_performed") == r).alias(f"ref{r}") for r in REFINEMENT_BUCKETS])
    return summed.select("*", *[
        round_half_even(F.lit(100.0) * F.col(n) / F.col("total"), 1).alias(f"{n}_pct") for n in counts])


def pass_share_by_refinements(refined: DataFrame, keys: Sequence[str], prompt: str = "prompt") -> DataFrame:
    """Share of the passing records that took 0, 1, 2 or 3 refinements."""
    rows = refinement_outcomes(refined, prompt)
    final_pass = F.col("final") == "Pass"
    summed = rows.groupBy(*keys).agg(F.count_if(final_pass).alias("__passes"), *[
        F.count_if(final_pass & (F.col("refinements_performed") == r)).alias(f"__r{r}") for r in REFINEMENT_BUCKETS])
    cells = F.explode(F.array(*[
        F.struct(F.lit(r).alias("refinements"), F.col(f"__r{r}").alias("passes"),
                 F.coalesce(F.lit(100.0) * F.col(f"__r{r}") / F.nullif("__passes", F.lit(0)), F.lit(0.0)).alias("share"))
        for r in REFINEMENT_BUCKETS]))
    return summed.select(*keys, cells.alias("__cell")).select(*keys, "__cell.*")
