"""The operators as stages of a corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of their input, with the rows that stay. Each bounds
the session's rows a batch for Python workers (``common.bound_batches``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import alike, latent, packing, pii, simhash, toxicity
from .common import bound_batches, bounded, row_key, table
from .components import connected_components
from .tokens import tokenizer_path

KEY = "tabsight row"
# Bytes of text encoded at once by the last stage and pieces in each half of its memo: less
# than op8 takes for itself, as reused workers keep it beside an executor that has run all stages.
PACK_BYTES, PACK_MEMO = 1 << 20, 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.7 or more; nothing is shuffled. Null texts stay."""
    bound_batches(spark)
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    place, threshold = docs.columns.index("text"), toxicity.THRESHOLD

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [model.score(t.as_py() or "")[0] < threshold for t in batch.column(place)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _joined(*groupings: DataFrame) -> DataFrame:
    """(doc_id, component_id): documents that any grouping puts together, directly or by steps."""
    # Each is read twice, and costs much to make.
    saved = [materialise(g.select("doc_id", "component_id").distinct(), "grouping") for g in groupings]
    rows = reduce(DataFrame.unionByName, saved)
    links = rows.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    named = connected_components(links).withColumnRenamed("node", "doc_id")
    ids = rows.select("doc_id").distinct()
    return ids.join(named, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id (null
    ids last): texts whose fingerprints differ in at most 3 bits, found by the trees of
    ``simhash``, or whose five-word shingles have a Jaccard similarity of 0.8 or more (most of
    these differ in more bits), directly or by steps. Rows are told apart by id and text, so rows without an id and rows
    that share one are judged like others; a repeated row stays once. The rows to leave out
    are few and broadcast where their number is bounded, so no other text is sent."""
    bound_batches(spark)
    keyed = docs.withColumn(KEY, row_key(docs))
    named = keyed.select(F.col(KEY).alias("doc_id"), "text")
    groups = _joined(simhash.near_duplicates(named), alike.alike_groups(named))
    own = keyed.groupBy(KEY).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = materialise(own.join(groups.select(F.col("doc_id").alias(KEY), "component_id"), KEY), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", KEY)
    first = rows.groupBy("component_id").agg(F.min(order)[KEY].alias("first"))
    gone = materialise(rows.join(first, "component_id").where(F.col(KEY) != F.col("first")).select(KEY), "gone")
    repeated = materialise(rows.where("n > 1").select(KEY), "repeated")
    left = keyed.join(bounded(gone), KEY, "left_anti")
    again = bounded(repeated)
    once = left.join(again, KEY, "left_semi").dropDuplicates([KEY])
    return left.join(again, KEY, "left_anti").unionByName(once).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item; rows are told apart by id and text."""
    bound_batches(spark)
    keyed = docs.withColumn(KEY, row_key(docs))
    found = latent.find_leaks(keyed.select(F.col(KEY).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaking = materialise(found.select(F.col("doc_id").alias(KEY)).distinct(), "leaking")
    return keyed.join(bounded(leaking), KEY, "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind in brackets, n_chars counted anew."""
    bound_batches(spark)
    masked = pii.redact(docs, pii.find_personal_data(docs))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return masked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    bound_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, slice_bytes=PACK_BYTES, memo_words=PACK_MEMO)
