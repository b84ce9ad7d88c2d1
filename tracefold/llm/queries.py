"""Queries of the operators of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cgk, cotraining, flat_graph, ftrl, fuzzy_lines, odd_sketch, packing, pii, rotation, warc
from .common import table


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.report(table(spark, sf_dir, "documents"))


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.reconstruct(*warc.archive(table(spark, sf_dir, "pages")))


def op7_embedding_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def embedding_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over all vectors and as many altered ones: of every third two that differ by a tenth in each number, of every other a multiple."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    made = e
    for k in (1, 2):
        near = F.transform("embedding", lambda x, i: x * (1 + 0.1 * (F.pmod(i + F.col("vec_id").cast("int") + k, F.lit(3)) - 1)))  # noqa: B023 - used at once
        changed = F.when(F.col("vec_id") % 3 == 0, near).otherwise(F.transform("embedding", lambda x: x * (k + 1)))  # noqa: B023
        made = made.unionByName(e.select((F.col("vec_id") + k * 1_000_000).alias("vec_id"), changed.alias("embedding")))
    return flat_graph.near_duplicates(made).select("vec_id", "dup_of")


def op8_packing_bounded_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.rotate(table(spark, sf_dir, "conversations"))


def op10_decontamination_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {
        "op1_pii_weak_supervision": op1_pii_weak_supervision,
        "op2_fuzzy_lines": op2_fuzzy_lines,
        "op3_quality_cotraining": op3_quality_cotraining,
        "op4_minhash_odd_sketch": op4_minhash_odd_sketch,
        "op5_toxicity_ftrl": op5_toxicity_ftrl,
        "op6_warc_content_addressed": op6_warc_content_addressed,
        "op7_embedding_flat_graph": op7_embedding_flat_graph,
        "embedding_near_copies": embedding_near_copies,
        "op8_packing_bounded_space": op8_packing_bounded_space,
        "op9_perspective_rotation": op9_perspective_rotation,
        "op10_decontamination_cgk": op10_decontamination_cgk,
    }


def oracle_sql() -> dict[str, str]:
    near = ", ".join(f"SELECT vec_id + {k} * 1000000, CASE WHEN vec_id % 3 = 0 THEN list_transform(e, lambda x, i: x * (1 + 0.1 * ((i - 1 + vec_id + {k}) % 3 - 1))) ELSE list_transform(e, lambda x: x * {k + 1}) END FROM b" for k in (1, 2)).replace(", SELECT vec_id + 2", " UNION ALL SELECT vec_id + 2")
    return {
        "embedding_near_copies": f"WITH RECURSIVE b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v AS (SELECT vec_id, e FROM b UNION ALL {near}), p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95), r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node WHERE r.root < p.b) SELECT node AS vec_id, min(root) AS dup_of FROM r GROUP BY node HAVING min(root) <> node",
        "op6_warc_content_addressed": warc.ARCHIVE_SQL,
        "op9_perspective_rotation": rotation.ROTATION_SQL,
    }
