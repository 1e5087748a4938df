"""Writers of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_splits(df: DataFrame, path: str, by: tuple[str, ...] = ("split",)) -> None:
    """One folder per split, or per (fold, role)."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since CSV holds scalars only."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields])


def export_table(df: DataFrame, path: str, file_format: str = "json", exclude: tuple[str, ...] = ()) -> str:
    """Dump a table minus some columns; returns a message and writes nothing on bad input.

    Runs a job to see whether there are any rows.
    """
    kind = file_format.lower()
    if kind not in ("json", "csv"):
        return f"Invalid format '{file_format}'. Choose 'json' or 'csv'."
    rows = df.drop(*exclude)
    if rows.isEmpty():
        return "No data found."
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    else:
        flat_for_csv(rows).write.mode("overwrite").csv(path, header=True, escape='"')
    return f"Data exported to {path}"
