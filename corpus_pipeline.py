"""Corpus pipeline: from documents to token files, one operator a stage.

Every stage works on all rows its predecessor kept, and all but the last return the
columns of ``documents``.  ``run`` writes each stage's rows to the shared folder and reads them again,
so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, mixing, quality, simhash, tokens
from tallyforge.llm.common import read
from tallyforge.llm.queries import tokenizer_definition
from tallyforge.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model predicts to be good."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.with_scores(docs, model).filter(quality.predicted(F.col("score")) == 1).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, and aren't most of one."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"), short_texts=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; later stages don't keep the training order.

    A pass that the mix cuts short counts if it takes at least half of the document: texts stay whole.
    """
    taken = mixing.training_order(docs)
    return taken.filter(F.col("words") * 2 >= F.col("size")).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: one row per document that the mix gave."""
    return tokens.read_documents(spark, tokens.write_tokens(docs, tokenizer_definition()))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

# Trained weights, XXH64 and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)
