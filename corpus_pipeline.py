"""A training corpus from the table documents, in five stages.

Each stage takes what its predecessor kept, as reread from Parquet, and works on all
of it. All but the last return the columns of documents; the last adds finish_time.

Edge cases: empty tables pass through all stages. Null and empty texts are kept by all
of them (they finish at once in the last); rows without doc_id are kept by the stages
that compare documents. Rows that repeat are one document to the third stage, which
keeps one of them. Further columns pass through, whatever their names; an empty
benchmark takes nothing out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bough.llm import decontamination, line_dedup, mixing, quality_rules, simhash
from bough.llm.shared import spill


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, weighed together, reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred before go, and documents of nothing else."""
    return line_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the table benchmark go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to equal weights, up to half of the tokens that are left."""
    return mixing.mix(docs, fraction=0.5)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("decontamination", benchmark), ("mixing", mixture)]

#: SQL can express neither the estimates of the first stage nor the third and fourth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
