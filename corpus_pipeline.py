"""The corpus pipeline: five stages over documents, each written and reread before the next.

Quality classification rejects documents, line deduplication rewrites texts and drops what is left of copies, near-deduplication keeps one document of each
group, decontamination drops documents that leak a benchmark item, and packing lays the rest out in windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import cgk, cotraining, fuzzy_lines, odd_sketch, packing
from tracefold.llm.common import fresh, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


#: A document that keeps less than this share of its characters says hardly anything that others don't.
LEAST_LEFT = 0.25


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites text and, with it, n_chars.

    A document of which less than ``LEAST_LEFT`` is left, so that what is left is scraps of a copy, is dropped, an emptied one
    too. Documents that nothing is taken from stay as they are, empty ones included.
    """
    was, now = fresh(docs.columns, "was", "now")
    out = fuzzy_lines.dedup_lines(docs.withColumn(was, F.length("text"))).withColumn(now, F.length("text"))
    changed = F.coalesce(F.col(now) < F.col(was), F.lit(False))
    kept = out.where(~changed | (F.col(now) >= LEAST_LEFT * F.col(was)))
    return kept.withColumn("n_chars", F.when(changed, F.col(now).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return odd_sketch.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cgk.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]

#: None: neither training nor LSH nor online packing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all stages over documents; every stage's rows are written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
