"""Filler clauses: features, naive Bayes weights, surprisal, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = {
    "acknowledges": r"^(?:ok|okay|sure|great|thanks|thank you|got it|alright)\b",
    "apologises": r"\b(?:sorry|apolog)",
    "greets": r"^(?:hi|hello|hey|good morning)\b",
    "hedges": r"\b(?:maybe|perhaps|probably|i think)\b",
    "offers": r"\b(?:let me know|feel free|happy to help|anything else)\b",
    "has_number": r"[0-9]",
    "narrates": r"\b(?:looking|checking|working on|one moment|please wait)\b",
    "short": r"^[^ ]+(?: [^ ]+){0,2}$",
}


def clauses(messages: DataFrame) -> DataFrame:
    rows = messages.where("role <> 'tool'").select("trace_id", "msg_idx", F.posexplode(F.split("content", r"[.!?;\n]+ *")).alias("clause_no", "clause"))
    return rows.withColumn("clause", F.trim("clause")).where("clause <> ''")


def filler_features(messages: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, clause_no, one boolean a feature)."""
    return clauses(messages).select("trace_id", "msg_idx", "clause_no", *(F.lower("clause").rlike(r).alias(n) for n, r in FEATURES.items()))


def filler_weights(labelled: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(feature, support, weight) of naive Bayes with Laplace smoothing from clauses and is_filler; one pass over the data."""
    has = {n: F.lower("clause").rlike(r) for n, r in FEATURES.items()}
    y = F.col("is_filler")
    sums = [F.sum((y & has[n]).cast("long")).alias(f"f_{n}") for n in FEATURES] + [F.sum((~y & has[n]).cast("long")).alias(f"p_{n}") for n in FEATURES]
    one = labelled.agg(F.sum(y.cast("long")).alias("nf"), F.sum((~y).cast("long")).alias("np"), *sums)
    rows = one.select("nf", "np", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"f_{n}").alias("ff"), F.col(f"p_{n}").alias("fp")) for n in FEATURES))).alias("x")).select("nf", "np", "x.*")
    w = F.log(((F.col("ff") + alpha) / (F.col("nf") + 2 * alpha)) / ((F.col("fp") + alpha) / (F.col("np") + 2 * alpha)))
    return rows.select("feature", (F.col("ff") + F.col("fp")).alias("support"), F.round(w, 6).alias("weight"))


def filler_probability(clauses_: DataFrame, weights: DataFrame, prior: float = 0.0, least_support: int = 5) -> DataFrame:
    """Clauses with p: the logistic function of the prior and the weights of the features present; thin features don't count."""
    table = {r.feature: r.weight for r in weights.where(F.col("support") >= least_support).collect()}  # at most one row a feature
    x = F.lit(prior)
    for n, w in table.items():
        x = x + F.when(F.lower("clause").rlike(FEATURES[n]), F.lit(w)).otherwise(0.0)
    return clauses_.withColumn("p", 1 / (1 + F.exp(-x)))


def surprisal(messages: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, bits): the greatest surprisal of a message's words in its trace."""
    import re
    from collections import Counter

    from tracefold.operators.compress import _grouped

    def kernel(rows):
        words = [(r["msg_idx"], re.findall("[a-z0-9-]+", r["content"] or "")) for r in rows]
        count = Counter(w for _, ws in words for w in ws)
        total, rarest = count.total(), {}
        for i, ws in words:
            if ws:
                rarest[i] = min(rarest.get(i, total), min(count[w] for w in ws))
        for i, n in rarest.items():
            yield {"trace_id": rows[0]["trace_id"], "msg_idx": i, "n": n, "total": total}

    # only messages are brought together by trace, so that words are on no disk
    found = _grouped(messages.withColumn("content", F.lower("content")), kernel, "trace_id string, msg_idx int, n long, total long")
    return found.select("trace_id", "msg_idx", F.round(-F.log2(F.col("n") / F.col("total")), 6).alias("bits"))


def prune(messages: DataFrame, weights: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Messages without the clauses that are filler with at least ``threshold`` and carry no digit."""
    c = filler_probability(clauses(messages), weights)
    kept = c.where((F.col("p") < threshold) | F.col("clause").rlike("[0-9]")).groupBy("trace_id", "msg_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("clause_no", "clause"))), lambda s: s.clause), ". ").alias("short"))
    j = messages.join(kept, ["trace_id", "msg_idx"], "left")
    return j.withColumn("content", F.when(F.col("role") == "tool", F.col("content")).otherwise(F.coalesce("short", F.lit("")))).drop("short")


#: Weights for traces that nothing was calibrated on.
USUAL = {"acknowledges": 2.0, "apologises": 1.5, "greets": 2.5, "hedges": -0.5, "offers": 2.5, "has_number": -4.0, "narrates": 1.5, "short": 0.5}


def usual_weights(spark) -> DataFrame:
    return spark.createDataFrame([(k, 1000, v) for k, v in sorted(USUAL.items())], "feature string, support long, weight double")
