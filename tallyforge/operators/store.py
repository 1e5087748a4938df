"""The experiment store: errors, results and best parameters as tables.

The functions work on any DataFrame; :class:`ExperimentStore` keeps the three tables
in a database of Spark's catalog, partitioned by experiment.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import materialize
from tallyforge.sources.sinks import export_table

KINDS = ("errors", "results", "best_params")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not replaced, plus the new rows."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def get_results(results: DataFrame, model: str, eval_method: str, metrics: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Stored scores of a model, limited to the wanted metrics and ks (long form)."""
    return results.filter(
        (F.col("model_name") == model) & (F.col("eval_method") == eval_method)
        & F.col("metric").isin(list(metrics)) & F.col("k").isin(list(ks)))


def set_missing_field(df: DataFrame, field: str, value: Column) -> DataFrame:
    """Set a field where it is absent: the column is missing or null."""
    present = F.coalesce(F.col(field), value) if field in df.columns else value
    return df.withColumn(field, present)


def remove_field(df: DataFrame, field: str) -> DataFrame:
    return df.drop(field)


def rename_field(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def matches(equal: dict | None = None, isin: dict | None = None, exists: dict | None = None) -> Column:
    """A filter from equality, membership and presence conditions."""
    tests = [F.col(c) == v for c, v in (equal or {}).items()]
    tests += [F.col(c).isin(list(v)) for c, v in (isin or {}).items()]
    tests += [F.col(c).isNotNull() if v else F.col(c).isNull() for c, v in (exists or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def delete_docs(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not match; a null test does not match."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def find_docs(df: DataFrame, condition: Column, exclude: Sequence[str] = (), limit: int | None = None,
              order: Sequence[Column | str] = ()) -> DataFrame:
    """Matching rows without the excluded columns; the limit is taken before the sort."""
    rows = df.filter(condition).drop(*exclude)
    rows = rows if limit is None else rows.limit(limit)
    return rows.orderBy(*order) if order else rows


def union_experiments(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_models(tables: Sequence[DataFrame], condition: Column | None = None) -> DataFrame:
    """Distinct model names over several tables."""
    names = [(t if condition is None else t.filter(condition)).select("model_name").distinct() for t in tables]
    return reduce(lambda a, b: a.unionByName(b), names).distinct()


def experiment_name(collection: Column) -> Column:
    return F.regexp_replace(collection, r"_(best_params|results|errors)$", "")


def list_experiments(collections: DataFrame, name: str = "name", kind: str | None = None) -> DataFrame:
    """Distinct experiments behind collection names, optionally of one kind only."""
    rows = collections.filter(F.col(name).rlike(r"_(best_params|results|errors)$" if kind is None else f"_{kind}$"))
    return rows.select(experiment_name(F.col(name)).alias("experiment")).distinct()


def _counts(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    named = df.select(*keys, *[c.cast("int").alias(n) for n, c in columns.items()])
    return named.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in columns])


def quality_checks(errors: DataFrame, results: DataFrame, best_params: DataFrame, eval_method: str,
                   keys: Sequence[str] = ("experiment", "model_name"), ignore_best_params: bool = False) -> DataFrame:
    """Per model: counts in the three tables and the three consistency rules.

    A rule column is true when the rule is broken.  Only models with a row for the
    evaluation method in any of the tables are checked.
    """
    method = F.coalesce(F.col("eval_method") == eval_method, F.lit(False))
    listed = {"__listed": method}
    sides = [
        _counts(errors, keys, {
            "validation_errors": F.col("phase") == "validation",
            "testing_errors": (F.col("phase") == "testing") & method, **listed}),
        _counts(results, keys, {"results": method, **listed}),
        _counts(best_params, keys, {"best_params": F.lit(True), **listed}),
    ]
    counts = ("validation_errors", "testing_errors", "results", "best_params")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    merged = stacked.groupBy(*keys).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*counts, "__listed")]).filter(F.col("__listed") > 0)
    no_best, no_results = F.col("best_params") == 0, F.col("results") == 0
    checked = merged.drop("__listed").withColumns({
        "orphan_validation": no_best & (F.col("validation_errors") > 0),
        "orphan_testing": no_results & (F.col("testing_errors") > 0),
        "results_without_params": F.lit(False) if ignore_best_params else no_best & (F.col("results") > 0)})
    return checked.withColumn(
        "passed", ~(F.col("orphan_validation") | F.col("orphan_testing") | F.col("results_without_params")))


def rerun_plan(requested: DataFrame, stored: DataFrame, errors: DataFrame, phase: str, rerun: bool = False) -> DataFrame:
    """What to do for each requested (experiment, model, eval_method): run or skip, and what to delete.

    Stored results are skipped, or cleaned with their errors when a rerun is wanted;
    missing ones run after stale errors of the phase are removed.
    """
    keys = ["experiment", "model_name", "eval_method"]
    have = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("stored_rows"))
    stale = errors.filter(F.col("phase") == phase).groupBy(*keys).agg(F.count(F.lit(1)).alias("error_rows"))
    plan = requested.join(have, keys, "left").join(stale, keys, "left").na.fill(0, ["stored_rows", "error_rows"])
    skip = (F.col("stored_rows") > 0) & (not rerun)
    return plan.select(
        *keys, F.when(skip, "skip").otherwise("run").alias("action"),
        F.when(skip, 0).otherwise(F.col("stored_rows")).alias("delete_stored"),
        F.when(skip, 0).otherwise(F.col("error_rows")).alias("delete_errors"))


class ExperimentStore:
    """Three tables of Spark's catalog in one database, partitioned by experiment.

    The catalog keeps columns and partitions, so an experiment may be empty.  Changes go over all
    wanted experiments in one job per table, and replace just the partitions that they touch.  How long
    the tables stay known depends on the session's catalog; their files stay at ``location``.
    """

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark, self.database = spark, database
        place = "" if location is None else f" LOCATION '{self._quoted(location)}'"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{place}")

    @staticmethod
    def _quoted(text: str) -> str:
        return text.replace("\\", "\\\\").replace("'", "\\'")

    def _table(self, kind: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown table: {kind}")
        return f"`{self.database}`.`{kind}`"

    def _has(self, kind: str) -> bool:
        return self.spark.catalog.tableExists(self._table(kind))

    def _partition(self, kind: str, experiment: str, change: str) -> None:
        self.spark.sql(f"ALTER TABLE {self._table(kind)} {change} PARTITION (experiment = '{self._quoted(experiment)}')")

    def _fit(self, kind: str, rows: DataFrame) -> DataFrame:
        """Rows with the table's columns, in its order; the table gets the columns that only the rows have."""
        table = self.spark.table(self._table(kind))
        added = [f for f in rows.schema.fields if f.name not in table.columns]
        if added:
            names = ", ".join(f"`{f.name}` {'string' if f.dataType.typeName() == 'void' else f.dataType.simpleString()}" for f in added)
            self.spark.sql(f"ALTER TABLE {self._table(kind)} ADD COLUMNS ({names})")
            table = self.spark.table(self._table(kind))
        return rows.select(*[F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields])

    def exists(self, experiment: str, kind: str | None = None) -> bool:
        return not self.experiments(kind).filter(F.col("experiment") == experiment).isEmpty()

    def setup(self, experiment: str, schemas: dict[str, str]) -> None:
        """Create an empty experiment; an existing one is an error."""
        if self.exists(experiment):
            raise FileExistsError(f"experiment '{experiment}' already exists")
        for kind in KINDS:
            empty = self.spark.createDataFrame([], schemas[kind]).withColumn("experiment", F.lit(experiment))
            if self._has(kind):
                self._fit(kind, empty)
            else:
                self.load(kind, empty)
            self._partition(kind, experiment, "ADD IF NOT EXISTS")

    def load(self, kind: str, rows: DataFrame) -> None:
        """Write a table of several experiments (column ``experiment``) into a store that hasn't that table."""
        # The table's own option: overwriting replaces just the partitions of the new rows.
        rows.write.format("parquet").option("partitionOverwriteMode", "dynamic").partitionBy("experiment").saveAsTable(self._table(kind))

    def read(self, experiment: str, kind: str) -> DataFrame:
        return self.read_all(kind).filter(F.col("experiment") == experiment)

    def read_all(self, kind: str) -> DataFrame:
        """All experiments of a table; a filter on ``experiment`` prunes partitions."""
        return self.spark.table(self._table(kind))

    def append(self, experiment: str, kind: str, rows: DataFrame) -> None:
        """Add rows to an experiment; columns that are new to the table are null in all others."""
        self._fit(kind, rows.withColumn("experiment", F.lit(experiment))).write.insertInto(self._table(kind))

    def rewrite(self, kind: str, rows: DataFrame, experiments: Sequence[str]) -> None:
        """Replace the partitions of ``experiments`` by rows (column ``experiment``) that may derive from them.

        The rows are written aside first; then one job overwrites the partitions they belong to.
        """
        rows = materialize(self._fit(kind, rows), f"store-{kind}")
        rows.write.insertInto(self._table(kind), overwrite=True)
        left = {r["experiment"] for r in rows.select("experiment").distinct().collect()}
        for emptied in sorted(set(experiments) - left):  # overwriting leaves partitions without new rows as they are
            self._partition(kind, emptied, "DROP IF EXISTS")
            self._partition(kind, emptied, "ADD IF NOT EXISTS")

    def _of(self, kind: str, experiment: str | None) -> tuple[DataFrame, list[str]]:
        """A table's rows of one experiment or of all, and these experiments."""
        if experiment is not None:
            return self.read(experiment, kind), [experiment]
        return self.read_all(kind), [r["experiment"] for r in self.experiments(kind).collect()]

    def upsert_best_params(self, rows: DataFrame, experiment: str | None = None) -> None:
        """Replace the parameters of the same (experiment, model, optimizer metric), add the others.

        ``rows`` may belong to several experiments (column ``experiment``), or to the one named.
        """
        rows = rows if experiment is None else rows.withColumn("experiment", F.lit(experiment))
        touched = [r["experiment"] for r in rows.select("experiment").distinct().collect()]
        old = self.read_all("best_params").filter(F.col("experiment").isin(touched))
        self.rewrite("best_params", upsert(old, rows, ["experiment", "model_name", "optimizer_metric"]), touched)

    def set_missing_field(self, field: str, value: Column, experiment: str | None = None) -> None:
        """Set a field where it is absent, in every table of one experiment or of all: one job per table."""
        for kind in KINDS:
            if self._has(kind):
                rows, touched = self._of(kind, experiment)
                self.rewrite(kind, set_missing_field(rows, field, value), touched)

    def delete(self, kind: str, condition: Column, experiment: str | None = None) -> None:
        rows, touched = self._of(kind, experiment)
        self.rewrite(kind, delete_docs(rows, condition), touched)

    def clean(self, eval_method: str, experiment: str | None = None, ignore_best_params: bool = False) -> None:
        """Delete what breaks the rules of ``quality_checks``: orphaned errors and results without parameters.

        Only models that break a rule lose rows, and only rows of the table the rule is about.
        """
        tables = {k: self._of(k, experiment)[0] for k in KINDS}
        checked = materialize(quality_checks(tables["errors"], tables["results"], tables["best_params"], eval_method,
                                             ignore_best_params=ignore_best_params).filter(~F.col("passed")), "offenders")
        keys = ["experiment", "model_name"]
        offends = checked.select(*keys, *[F.col(r).alias(f"__{r}") for r in ("orphan_validation", "orphan_testing", "results_without_params")])
        method = F.col("eval_method") == eval_method
        rules = {"errors": (F.col("__orphan_validation") & (F.col("phase") == "validation")) | (F.col("__orphan_testing") & (F.col("phase") == "testing") & method),
                 "results": F.col("__results_without_params") & method}
        for kind, broken in rules.items():
            rows, touched = self._of(kind, experiment)
            self.rewrite(kind, delete_docs(rows.join(offends, keys, "left"), broken).select(*rows.columns), touched)

    def drop(self, experiment: str, kind: str | None = None) -> None:
        """Drop one table of an experiment, or all of it."""
        for each in KINDS if kind is None else (kind,):
            if self._has(each):
                self._partition(each, experiment, "DROP IF EXISTS")

    def copy_errors(self, source: str, target: str) -> bool:
        """Copy the errors of an experiment under another name unless that exists already."""
        if self.exists(target, "errors"):
            return False
        self._partition("errors", target, "ADD IF NOT EXISTS")
        self.append(target, "errors", self.read(source, "errors").drop("experiment"))
        return True

    def experiments(self, kind: str | None = None) -> DataFrame:
        """Distinct experiment names, from the catalog's partitions."""
        found = [self.spark.sql(f"SHOW PARTITIONS {self._table(k)}") for k in KINDS if (kind is None or k == kind) and self._has(k)]
        if not found:
            return self.spark.createDataFrame([], "experiment string")
        # Partition names are percent-encoded, a plus sign isn't.
        name = F.url_decode(F.replace(F.substring("partition", len("experiment=") + 1, 1 << 30), F.lit("+"), F.lit("%2B")))
        return reduce(lambda a, b: a.unionByName(b), found).select(name.alias("experiment")).distinct()

    def export(self, experiment: str, kind: str, path: str, file_format: str = "json",
               exclude: tuple[str, ...] = ()) -> str:
        return export_table(self.read(experiment, kind).drop("experiment"), path, file_format, exclude)

    def export_all(self, experiment: str, folder: str, file_format: str = "json") -> dict[str, str]:
        return {k: self.export(experiment, k, f"{folder}/{experiment}_{k}", file_format) for k in KINDS}
