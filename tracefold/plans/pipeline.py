"""The whole way of a trace: tool payloads, compression, stubs, check; and synthetic tasks to measure it on."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.config import Config
from tracefold.functions import text as T
from tracefold.operators import compress as C
from tracefold.operators import filler as L
from tracefold.operators import graph as G
from tracefold.operators import rationale as N
from tracefold.operators import tools as X
from tracefold.sources import traces as S


class DecisionLoss(ValueError):
    """A critical value is missing from a compressed trace."""


def preprocess(messages: DataFrame, cfg: Config) -> DataFrame:
    """Runs of calls collapsed, listings compacted, repeated results replaced by a reference."""
    if cfg.collapse_runs:
        messages = X.collapse_runs(messages, cfg.least_run)
    if cfg.prune_filler:
        messages = L.prune(messages, L.usual_weights(messages.sparkSession))
    if cfg.trim_arrays:
        messages = X.rescalarise_arrays(messages)
    if cfg.compact_listings:
        messages = X.compact_listings(messages)
    if cfg.dedupe_tools:
        same = X.dedupe_results(messages)
        messages = messages.join(same, ["trace_id", "msg_idx"], "left").withColumn("content", F.when(F.col("same_as").isNotNull(), F.concat(F.lit("[same as message "), F.col("same_as").cast("string"), F.lit("]"))).otherwise(F.col("content"))).drop("same_as")
    return messages.select(*S.COLUMNS)


def run(messages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Compressed traces; with ``strict``, an error if a critical value got lost."""
    short = C.compress(preprocess(messages, cfg), cfg.method, **({"reduction": cfg.reduction, "budget": cfg.budget, "gamma": cfg.gamma} if cfg.method == "compress" else {}))
    if cfg.value_stubs:
        short = N.inject(short, X.value_stubs(messages, short))
    if cfg.rationale_stubs:
        short = N.inject(short, N.rationale_stubs(N.rationales(messages, G.rule_decisions(messages))))
        short = N.inject(short, N.comparative_stubs(N.comparatives(messages)))
    if cfg.anchor_stubs:
        short = N.inject(short, N.anchor_stubs(messages))
    if cfg.repair:
        rules = G.rule_decisions(messages)
        short = G.repaired(messages, short, G.extended_edges(G.artifacts(messages, T.LINKING), rules, C.extract(messages)))[0]
    if cfg.strict and (bad := verify(messages, short).first()) is not None:
        raise DecisionLoss(f"trace {bad.trace_id}: {bad.value!r} of message {bad.msg_idx} is missing")
    return short


def verify(messages: DataFrame, compressed: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, value): critical values of decisions that can't be read off the compressed trace; independent of the compressor."""
    from tracefold.functions.text import recoverable

    d = C.extract(messages)
    v = d.select("trace_id", "msg_idx", F.explode(F.array_distinct(F.concat("vals", F.when(F.length("target").between(2, 60), F.array("target")).otherwise(F.expr("cast(array() as array<string>)"))))).alias("value"))
    text = compressed.groupBy("trace_id").agg(F.concat_ws("\n", F.collect_list(F.concat_ws(" ", "content", "tool_name", "tool_args"))).alias("t"))
    return v.join(text, "trace_id", "left").where(~F.coalesce(recoverable(F.col("value"), F.col("t")), F.lit(False))).select("trace_id", "msg_idx", "value")


def run_json(raw: DataFrame, cfg: Config = Config(), **names) -> DataFrame:
    """(trace_id, body) of raw JSON traces in, compressed out."""
    return S.to_json(run(S.from_json(raw, **names), cfg))


TASKS = (
    {"task": "pick a storage engine", "options": ("StoreAlpha", "StoreBeta", "StoreGamma"), "winner": "StoreBeta", "metrics": {"latency_ms": 12, "cost": 40}},
    {"task": "pick a queue", "options": ("QueueOne", "QueueTwo", "QueueThree"), "winner": "QueueThree", "metrics": {"throughput": 900, "errors": 2}},
    {"task": "pick a region", "options": ("RegionEast", "RegionWest", "RegionNorth"), "winner": "RegionEast", "metrics": {"rtt_ms": 31, "price": 17}},
)


def synthetic(spark: SparkSession, tasks=TASKS, seeds: int = 3, noise: int = 3) -> DataFrame:
    """Traces with a planted decision: eleven messages each, two for every option, noise in the results."""
    rows = []
    for t, spec in enumerate(tasks):
        for seed in range(seeds):
            rng = random.Random(f"{t}-{seed}-{noise}")
            msgs = [("system", "Compare the options and decide.", None, None), ("user", f"Please {spec['task']}.", None, None)]
            for o in spec["options"]:
                values = spec["metrics"] if o == spec["winner"] else {k: v + rng.randrange(5, 60) for k, v in spec["metrics"].items()}
                msgs.append(("assistant", "", "measure", f'{{"option":"{o}"}}'))
                msgs.append(("tool", "; ".join(f"{k}={v}" for k, v in values.items()) + "".join(f"\nlog {rng.randrange(10**6)} ok." for _ in range(noise)), None, None))
            best = "; ".join(f"{k}={v}" for k, v in spec["metrics"].items())
            msgs += [("assistant", f"I recommend {spec['winner']} because {best}.", None, None), ("user", "Sounds good.", None, None), ("assistant", f"Confirmed: {spec['winner']} is selected.", None, None)]
            rows += [(f"{t}-{seed}", i, *m) for i, m in enumerate(msgs)]
    return spark.createDataFrame(rows, C.MESSAGE)


def compare(results: DataFrame, reference: str = "compress") -> DataFrame:
    """(method, mean, low, high, p, p_bonferroni, effect, cohen_d) of DRR by trace against a reference method.

    The paired scores are grouped by method; one kernel a method sees only its two columns.
    """
    import pandas as pd

    ref = results.where(F.col("method") == reference).select("trace_id", F.col("drr_soft").alias("ref"))
    pairs = results.join(ref, "trace_id").where("drr_soft is not null and ref is not null").select("method", "trace_id", "drr_soft", "ref")
    others = max(1, results.select("method").distinct().count() - 1)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trace_id")
        b, w = C.bootstrap(pdf.drr_soft.tolist()), C.wilcoxon(pdf.ref.tolist(), pdf.drr_soft.tolist())
        return pd.DataFrame([(pdf.method.iloc[0], b["mean"], b["low"], b["high"], w["p"], min(1.0, w["p"] * others), w["r"], C.cohen_d(pdf.ref.tolist(), pdf.drr_soft.tolist()))], columns=["method", "mean", "low", "high", "p", "p_bonferroni", "effect", "cohen_d"])

    return pairs.groupBy("method").applyInPandas(kernel, "method string, mean double, low double, high double, p double, p_bonferroni double, effect double, cohen_d double")
