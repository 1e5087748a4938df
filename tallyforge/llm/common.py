"""Words, reading and raw file output shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.session import scratch_path

# Runs of characters other than the six ASCII blanks; one definition for every operator.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text; an empty array for null and for texts without words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where the texts of ``column`` add up to about ``limit`` bytes.

    No row is cut, so a single longer text makes a slice of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def write_raw(files: DataFrame, tag: str, last_byte: str) -> str:
    """Write each row's bytes as one file of its own below the shared folder; gives the folder.

    ``files`` has one binary column ``content``: whole files, each without its last byte,
    which is the same for all of them (``last_byte``, a Latin-1 character).  Spark's text
    writer puts it behind each row and its committer drops what lost tasks left, so this
    works on every file system Spark can write to.
    """
    path = scratch_path(files.sparkSession, tag)
    (files.select(F.col("content").cast("string").alias("value")).write
     .option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", last_byte).text(path))
    return path


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Files written by ``write_raw``: ``path`` and ``content``.  Empty files of empty tasks are left out."""
    return (spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content"))


# What worker processes keep from task to task, by module.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """A dictionary that outlives tasks in a worker process, until the worker gets a task of another module's."""
    return _KEPT.setdefault(owner, {})


def make_room(owner: str) -> None:
    """Drop what other modules keep in this process."""
    for name, held in _KEPT.items():
        if name != owner:
            held.clear()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` on workers that can import this package; a task begins without what other modules kept and returns unused memory."""
    from tallyforge.session import ship_package

    ship_package(df.sparkSession)
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
