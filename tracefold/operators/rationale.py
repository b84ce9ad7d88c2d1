"""Reasons, rejected alternatives and comparisons, and the stubs that carry them into a compressed trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.operators import memory as M

ENTITY = r"[A-Z][A-Za-z0-9_-]*(?: [A-Z][A-Za-z0-9_-]*){0,2}"
COMPARE = rf"({ENTITY}) (?:rather than|instead of|over|in favou?r of|not) ({ENTITY})"
REJECT = rf"(?:reject(?:ed|ing)?|rul(?:ed|ing) out|discard(?:ed|ing)?|avoid(?:ed|ing)?|not (?:use|choose|pick|select)|skip(?:ped|ping)?) (?:the )?({ENTITY})"
REASON = r"(?:because|since|due to|as it|so that) ([^.;\n]{3,120})"


def comparatives(messages: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, chosen, alternative) of 'X rather than Y' and the like."""
    t = F.col("content")
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(COMPARE), F.lit(1)).alias("c"), F.regexp_extract_all(t, F.lit(COMPARE), F.lit(2)).alias("a"))
    return messages.where("role <> 'tool'").select("trace_id", "msg_idx", F.explode(pairs).alias("p")).select("trace_id", "msg_idx", F.col("p.c").alias("chosen"), F.col("p.a").alias("alternative")).distinct()


def rationales(messages: DataFrame, decisions: DataFrame, window: int = 3) -> DataFrame:
    """(trace_id, msg_idx, source, alternative, reason, confidence): rejected alternatives in a decision's message or the ``window`` before it.

    A range join on the trace. An alternative that other messages name as well is trusted (0.9), else less (0.6).
    """
    clauses = messages.where("role <> 'tool'").select("trace_id", F.col("msg_idx").alias("source"), F.explode(F.split("content", r"[.;\n]+ *")).alias("clause"))
    said = clauses.select("trace_id", "source", F.regexp_extract("clause", REJECT, 1).alias("alternative"), F.regexp_extract("clause", REASON, 1).alias("reason")).where("alternative <> ''")
    near = said.join(decisions.select("trace_id", "msg_idx"), "trace_id").where((F.col("source") <= F.col("msg_idx")) & (F.col("source") >= F.col("msg_idx") - window))
    other = messages.select("trace_id", F.col("msg_idx").alias("m"), F.lower("content").alias("t"))
    seen = near.join(other, "trace_id").where((F.col("m") != F.col("source")) & F.contains("t", F.lower("alternative"))).select("trace_id", "source", "alternative").distinct().withColumn("seen", F.lit(True))
    return near.join(seen, ["trace_id", "source", "alternative"], "left").select("trace_id", "msg_idx", "source", "alternative", "reason", F.when(F.col("seen"), 0.9).otherwise(0.6).alias("confidence")).distinct()


def _first(rows: DataFrame, most: int, *order: str) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy("trace_id").orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def inject(compressed: DataFrame, stubs: DataFrame) -> DataFrame:
    """Appends stubs (trace_id, msg_idx, stub) to their messages, or to a message of their own where it is gone; a stub whose text is there already is left out."""
    per = stubs.groupBy("trace_id", "msg_idx").agg(F.array_join(F.sort_array(F.collect_set("stub")), "\n").alias("stub"))
    none = F.lit(None).cast("string")
    j = compressed.join(per, ["trace_id", "msg_idx"], "full")
    text = F.when(F.col("stub").isNull() | F.coalesce(F.contains("content", "stub"), F.lit(False)), F.col("content")).otherwise(F.concat_ws("\n", F.nullif("content", F.lit("")), "stub"))
    return j.select("trace_id", "msg_idx", F.coalesce("role", F.lit("assistant")).alias("role"), text.alias("content"), F.coalesce("tool_name", none).alias("tool_name"), F.coalesce("tool_args", none).alias("tool_args"))


def rationale_stubs(found: DataFrame, least: float = 0.6, most: int = 10) -> DataFrame:
    """At most ``most`` a trace (a feature of the operator), the most trusted first."""
    rows = _first(found.where(F.col("confidence") >= least), most, F.desc("confidence"), "msg_idx", "alternative")
    return rows.select("trace_id", "msg_idx", F.concat(F.lit("[rationale] not: "), "alternative", F.when(F.col("reason") != "", F.concat(F.lit(" — reason: "), "reason")).otherwise("")).alias("stub"))


def comparative_stubs(found: DataFrame, most: int = 10) -> DataFrame:
    return _first(found, most, "msg_idx", "chosen", "alternative").select("trace_id", "msg_idx", F.concat(F.lit("[comparative] chose "), "chosen", F.lit(" over: "), "alternative").alias("stub"))


def anchor_stubs(messages: DataFrame, most: int = 10) -> DataFrame:
    """Stubs of the goals and states that are still open."""
    a = M.anchors(messages)
    live = a.join(M.lifecycle(messages, a).where("status = 'active'").select("trace_id", "msg_idx", "clause_no"), ["trace_id", "msg_idx", "clause_no"], "left_semi")
    return _first(live, most, "msg_idx", "clause_no").select("trace_id", "msg_idx", F.concat(F.lit("["), "kind", F.lit("] "), "clause").alias("stub"))


def referent_stubs(messages: DataFrame, links: DataFrame, most: int = 10) -> DataFrame:
    """Stubs that name what a terse confirmation refers to."""
    ids = messages.select("trace_id", F.col("msg_idx").alias("anchor"), F.element_at(T.matches(F.col("content"), "id"), 1).alias("value"))
    return _first(links.join(ids, ["trace_id", "anchor"]), most, "msg_idx").select("trace_id", "msg_idx", F.concat(F.lit("[referent: "), "value", F.lit("]")).alias("stub"))


def lost(messages: DataFrame, compressed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a compressed trace lost: values (trace_id, kind, value) and messages (trace_id, msg_idx)."""
    from tracefold.operators.graph import artifacts

    a = artifacts(messages, T.LINKING).select("trace_id", "kind", "value").distinct()
    b = artifacts(compressed, T.LINKING).select("trace_id", "value").distinct()
    return a.join(b, ["trace_id", "value"], "left_anti").select("trace_id", "kind", "value"), messages.select("trace_id", "msg_idx").join(compressed.select("trace_id", "msg_idx"), ["trace_id", "msg_idx"], "left_anti")
