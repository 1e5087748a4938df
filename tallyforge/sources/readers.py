"""Readers of record files and program files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import strip
from tallyforge.operators.ordering import running_totals
from tallyforge.session import known_size, materialize

# Fixed value: what a task without a program file shows.
FILE_NOT_FOUND = "File not found"
_STRETCH_BITS = 14  # pieces that are summed in one go, as a power of two
LISTING_TASKS = 4  # tasks that list folders, for each core


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Files cut behind every closing brace, wherever it stands (written): files are split among tasks like lines.

    ``file, start, place`` order the pieces of a file.  ``quotes`` are its unescaped ones; ``outside`` and ``inside`` tell for a
    piece that begins outside and inside of a string by how much braces open and close in it.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.regexp_count(plain, F.lit('"'))

    def braces(text: Column, ends_inside: Column) -> Column:
        bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
        return F.regexp_count(bare, F.lit(r"\{")) - F.when(ends_inside, 0).otherwise(1)

    odd = quotes % 2 == 1
    return materialize(raw.select(
        "*", quotes.alias("quotes"), braces(plain, odd).alias("outside"), braces(F.concat(F.lit('"'), plain), ~odd).alias("inside")), "pieces")


def _array_files(pieces: DataFrame) -> DataFrame:
    """Files whose first character, blanks aside, opens an array."""
    first = pieces.groupBy("file").agg(F.min_by(F.substr(F.ltrim(F.col("value"), F.lit(" \t\r\n\ufeff")), F.lit(1), F.lit(1)), F.struct("start", "place")).alias("first"))
    return known_size(first.filter("first = '['").select("file"), "array-files")


def _records(pieces: DataFrame, schema: str) -> DataFrame:
    """Records of files that each hold one array of objects: ``file``, ``record`` (from 0) and ``row``.

    Running sums over the pieces tell whether a piece begins in a string and how deep it ends; a record
    ends where the depth comes back to zero.  Only numbers are summed, texts join last.  Files go by
    numbers: a path beside every piece would be most of what is moved and sorted.
    """
    files = known_size(pieces.select("file").distinct().withColumn("no", F.row_number().over(Window.orderBy("file"))), "file-numbers")
    paths, pieces = files.select(F.col("file").alias("path"), F.col("no").alias("file")), pieces.join(files, "file").drop("file").withColumnRenamed("no", "file")
    order, at = ["start", "place"], ["file", "start", "place"]
    numbers = pieces.select(*at, F.col("quotes").cast("long").alias("quotes"), "outside", "inside")
    # Stretches of a file's part: as a part is no shorter than its pieces are many, its last stretch is numbered below the next part's first.
    stretch = F.col("start") + F.shiftright(F.pmod("place", F.lit(1 << 33)), _STRETCH_BITS)
    counted = running_totals(numbers, ["file"], order, stretch, {"q": F.col("quotes")})
    change = F.when((F.col("q") - F.col("quotes")) % 2 == 0, F.col("outside")).otherwise(F.col("inside")).cast("long")
    closes = F.when((F.col("q") % 2 == 0) & (F.col("depth") == 0), 1).otherwise(0).cast("long")
    deep = running_totals(counted.select(*at, "q", change.alias("change")), ["file"], order, stretch, {"depth": F.col("change")})
    ended = running_totals(deep.select(*at, closes.alias("end"), "depth"), ["file"], order, stretch, {"ends": F.col("end")})
    owned = ended.filter("depth >= 0").select(*at, (F.col("ends") - F.col("end")).alias("record"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "value"))), lambda p: p["value"])
    texts = pieces.select(*at, "value").join(owned, at).groupBy("file", "record").agg(F.concat(F.array_join(whole, "}"), F.lit("}")).alias("text"))
    row = F.from_json(F.regexp_replace("text", r"^[^{]*", ""), schema)
    return texts.join(paths, "file").select(F.col("path").alias("file"), "record", row.alias("row"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of objects; large files are split among tasks (runs a job).

    A file may be one line.  A record that can't be read has null fields.
    """
    return _records(_pieces(spark, path), schema).select("row.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited records; files are split among tasks."""
    return spark.read.schema(schema).json(path)


def read_clean_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_jsonl`` but unreadable lines are left out instead of becoming null rows."""
    marked = spark.read.schema(f"{schema}, _corrupt_record string").json(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return marked.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def distinct_task_ids(tasks: DataFrame, position: Column, id_col: str = "task_id") -> DataFrame:
    """Distinct ids with the position of their first appearance, to sort by ``first_pos``."""
    placed = tasks.select(F.col(id_col).cast("long").alias("task_id"), position.alias("__pos"))
    return placed.groupBy("task_id").agg(F.min("__pos").alias("first_pos"))


def read_task_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct task ids of files that are JSON arrays or JSON lines, in order of first appearance.

    A file's form is told by its first character; a folder may hold both.  The order is kept in ``first_pos`` as
    (file, start of its part, place in the part), whatever way files are packed into tasks.
    """
    def place(start: Column, at: Column) -> Column:
        return F.struct("file", start.alias("start"), at.alias("place"))

    pieces = _pieces(spark, path)
    arrays = _array_files(pieces)
    of_arrays = _records(pieces.join(arrays, "file", "left_semi"), "task_id string").select(
        F.col("row.task_id").alias("task_id"), place(F.lit(0).cast("long"), F.col("record")).alias("place"))
    lines = spark.read.schema("task_id string").json(path).select("task_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                                                 F.monotonically_increasing_id().alias("id"))
    of_lines = lines.join(arrays, "file", "left_anti").select("task_id", place(F.col("start"), F.col("id")).alias("place"))
    rows = of_arrays.union(of_lines).filter(F.col("task_id").isNotNull())
    return distinct_task_ids(rows, F.col("place"))


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Meanwhile folders are listed by ``LISTING_TASKS`` for each core, many in a task; by itself Spark takes a task a folder, up to ten thousand."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), LISTING_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_code_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole program files as (task_id, code); the id is read off the path, ``task_id_7`` or ``task_id=7``."""
    with _few_listing_tasks(spark):
        raw = spark.read.text(path, wholetext=True)
    files = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"task_id[_=](\d+)", 1).alias("id"),
        strip(F.col("value")).alias("code"))
    return files.select(F.col("id").try_cast("long").alias("task_id"), "code").filter(F.col("task_id").isNotNull())


def code_by_task(tasks: DataFrame, code_files: DataFrame) -> DataFrame:
    """Every task with its program text, or the marker text when the file is missing."""
    return (tasks.join(code_files, "task_id", "left")
            .withColumn("code", F.coalesce("code", F.lit(FILE_NOT_FOUND))))
