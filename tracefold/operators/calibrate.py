"""Calibration of the filler weights: which clauses can be deleted without loss is tried out, and the weights are fitted on that."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefold.functions import decide as D
from tracefold.operators import compress as C
from tracefold.operators import filler as L

LABEL = "clause string, is_filler boolean"
NOT_ENGLISH = ("arabic", "chinese", "french", "german", "japanese", "russian", "spanish")


def candidates(messages: DataFrame, per_form: int = 15, seed: int = 0) -> DataFrame:
    """(trace_id, msg_idx, clause_no, clause, form): of the clauses of like features at most ``per_form`` a trace, in a seeded order (a sampling operator)."""
    c = L.clauses(messages)
    form = F.concat_ws("", *(F.lower("clause").rlike(r).cast("int").cast("string") for r in L.FEATURES.values()))
    order = W.partitionBy("trace_id", "form").orderBy(F.xxhash64(F.lit(seed), "msg_idx", "clause_no"), "msg_idx", "clause_no")
    return c.withColumn("form", form).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_form).drop("r")


def deletable(rows: list[dict], msg_idx: int, clause: str, floor: float = 1.0) -> bool:
    """Whether the critical values of a trace's decisions are still read off it, compressed, once a clause is deleted."""
    values = list(dict.fromkeys(v for d in C.decisions_of(rows) for v in D.critical(d)))
    cut = [r | {"content": (r["content"] or "").replace(clause, "", 1)} if r["msg_idx"] == msg_idx else r for r in rows]
    text = "\n".join(C.footprint(r) for r in C.compress_trace(cut))
    return not values or sum(D.readable(v, text) for v in values) >= floor * len(values)


def labels(messages: DataFrame, per_form: int = 15, floor: float = 1.0, seed: int = 0) -> DataFrame:
    """(clause, is_filler) of the candidates of every trace, each deleted by itself; one grouped pass."""
    tried = candidates(messages, per_form, seed).groupBy("trace_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("msg_idx", "clause_no", "clause")))).alias("tool_args"))
    asked = tried.select("trace_id", F.lit(-1).alias("msg_idx"), F.lit("candidates").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("tool_name"), "tool_args")

    def kernel(rows):
        real = [r for r in rows if r["role"] != "candidates"]
        for r in rows:
            if r["role"] == "candidates":
                for c in json.loads(r["tool_args"]):
                    yield {"clause": c["clause"], "is_filler": deletable(real, c["msg_idx"], c["clause"], floor)}

    return C._grouped(messages.select(*asked.columns).unionByName(asked), kernel, LABEL)


def append_labels(found: DataFrame, path: str) -> None:
    found.write.mode("append").json(path)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL).json(path).where("clause is not null")


def with_decisions(messages: DataFrame) -> DataFrame:
    """Traces that have any decision."""
    return messages.join(C.extract(messages).select("trace_id").distinct(), "trace_id", "left_semi")


def english(messages: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose domain names no other language."""
    return messages.where(~F.coalesce(F.lower(domain).rlike("|".join(NOT_ENGLISH)), F.lit(False)))


def calibrate(messages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """The weights fitted on what deleting showed; with ``path`` labels are kept there, and older ones count too."""
    found = labels(with_decisions(messages), **kw)
    if path:
        append_labels(found, path)
        found = load_labels(messages.sparkSession, path)
    return L.filler_weights(found)


def diagnosed(found: DataFrame, weights: DataFrame, least: int = 5) -> DataFrame:
    """(feature, support, weight, thin, labels, filler): the weights next to the balance of the labels."""
    n = found.agg(F.count("*").alias("labels"), F.sum(F.col("is_filler").cast("long")).alias("filler"))
    return weights.crossJoin(F.broadcast(n)).select("feature", "support", "weight", (F.col("support") < least).alias("thin"), "labels", "filler")


def weights_to_json(weights: DataFrame) -> str:
    """One row a feature."""
    return json.dumps({r.feature: [r.support, r.weight] for r in weights.orderBy("feature").collect()})


def weights_from_json(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(k, int(n), float(w)) for k, (n, w) in sorted(json.loads(text).items())], "feature string, support long, weight double")


def carries_judgment(clause: str) -> bool:
    """Whether a clause decides, confirms or gives a reason, so that it is never filler."""
    return D.decisive(clause) is not None or D._CONFIRMED.search(clause) is not None or D._THEREFORE.search(clause) is not None


def safely_pruned(content: str, p: dict[str, float], keep: set[str], threshold: float = 0.75) -> str:
    """A content without the clauses of probability ``threshold`` on that neither decide nor hold a value to keep; not emptied."""
    import re

    parts = [x for x in re.split(r"(?<=[.!?;\n])\s*", content) if x.strip()]
    left = [x for x in parts if p.get(x.strip(" .!?;\n"), 0.0) < threshold or carries_judgment(x) or any(D.readable(v, x) for v in keep) or re.search(r"\d", x)]
    return " ".join(x.strip() for x in left) if left else content
