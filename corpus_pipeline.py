"""A corpus pipeline made of the operators in tabsight.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsight.llm import stages
from tabsight.session import materialise

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_leaks),
    ("personal_data", stages.mask_personal_data),
    ("packing", stages.pack),
]

# The learned stages and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
