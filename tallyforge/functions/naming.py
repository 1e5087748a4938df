"""Columns that read experiment settings out of run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt types in the order they are tried.
PROMPT_TYPES = ("regular", "signature", "cot", "debug")

_NAME = r"^((?:[^_]*_)*?[^_]*shot[^_]*)(?:_(.*))?$"


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.json$", "")


def experiment_of(name: Column) -> Column:
    """Parts up to and including the first one that contains ``shot``; raises if there is none."""
    stem = _stem(name)
    return F.when(stem.rlike(_NAME), F.regexp_extract(stem, _NAME, 1)).otherwise(
        F.raise_error(F.concat(F.lit("no shot part in run name: "), name)))


def model_of(name: Column) -> Column:
    """Everything after the experiment part of a run name."""
    return F.regexp_extract(_stem(name), _NAME, 2)


def _part(name: Column, number: int) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(number))


def prompt_type_of(name: Column) -> Column:
    """First prompt type, in enumeration order, that occurs in the leading part of the name."""
    head = _part(name, 1)
    picked = F.when(head.contains(PROMPT_TYPES[0]), PROMPT_TYPES[0])
    for kind in PROMPT_TYPES[1:]:
        picked = picked.when(head.contains(kind), kind)
    return picked


def is_similarity(name: Column) -> Column:
    """Whether the second part names the similarity selector."""
    return _part(name, 2) == "similarity"


def shots_of(name: Column) -> Column:
    """Third part as a number, null when it is none."""
    return _part(name, 3).try_cast("int")


def model_size(model: Column) -> Column:
    """``family:14b-variant`` gives ``14b``; no colon gives ``N/A``."""
    tag = F.trim(F.split_part(model, F.lit(":"), F.lit(2)))
    return F.when(model.contains(":"), F.split_part(tag, F.lit("-"), F.lit(1))).otherwise("N/A")
