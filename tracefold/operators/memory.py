"""Statements that hold (state) or are aimed at (goal), their lifecycle, and ranked recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GOAL = r"\b(?:want to|need to|plan to|going to|trying to|aim to|goal is|please|would like to)\b"
STATE = r"\b(?:is now|currently|prefer|prefers|must always|always|never|lives? in|works? at|the default is|preserve)\b"
DONE = r"\b(?:done|completed|finished|resolved|confirmed|has been)\b"
DROPPED = r"\b(?:never mind|forget it|abandon|no longer need)\b"
UPDATED = r"\b(?:instead|changed|actually|now|update)\b"
STOP = ("the", "and", "for", "has", "been", "you", "are", "please", "with", "that", "this", "now", "not")


def content_tokens(text: Column) -> Column:
    """The distinct words of over two letters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP))))


def anchors(messages: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, clause_no, kind, clause): clauses with a cue that aren't questions; a goal cue wins."""
    rows = messages.where("role <> 'tool'").select("trace_id", "msg_idx", F.posexplode(F.split("content", r"[.!;\n]+ *")).alias("clause_no", "clause"))
    kind = F.when(F.lower("clause").rlike(GOAL), "goal").when(F.lower("clause").rlike(STATE), "state")
    return rows.where("not endswith(trim(clause), '?')").select("trace_id", "msg_idx", "clause_no", kind.alias("kind"), F.trim("clause").alias("clause")).where("kind is not null")


def lifecycle(messages: DataFrame, found: DataFrame) -> DataFrame:
    """Anchors with their status: goals completed or abandoned by the first later message with a cue that shares a word; states superseded by a later one with an update cue."""
    a = found.withColumn("words", content_tokens(F.col("clause")))
    later = messages.where("role <> 'tool'").select("trace_id", F.col("msg_idx").alias("m"), F.lower("content").alias("t"), content_tokens(F.col("content")).alias("ws"))
    cue = F.when(F.col("kind") == "goal", F.when(F.col("t").rlike(DROPPED), "abandoned").when(F.col("t").rlike(DONE), "completed")).when(F.col("t").rlike(UPDATED), "superseded")
    hit = a.join(later, "trace_id").where((F.col("m") > F.col("msg_idx")) & F.arrays_overlap("words", "ws")).withColumn("cue", cue).where("cue is not null")
    first = hit.groupBy("trace_id", "msg_idx", "clause_no").agg(F.min(F.struct("m", "cue")).alias("f"))
    return a.join(first, ["trace_id", "msg_idx", "clause_no"], "left").select("trace_id", "msg_idx", "clause_no", "kind", F.coalesce("f.cue", F.lit("active")).alias("status"))


def tfidf_recall(facts: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(fact_id, score, rank): the ``k`` facts (fact_id, text) closest to the query by TF-IDF cosine over words; ties by fact_id.

    Term and document counts are over all facts; only those that share a word with the query are scored.
    """
    words = facts.select("fact_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    tf = words.groupBy("fact_id", "w").agg(F.count("*").alias("tf"))
    n = facts.select("fact_id").distinct().agg(F.count("*").alias("n"))
    df = tf.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("w", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    vec = tf.join(df, "w").select("fact_id", "w", (F.col("tf") * F.col("idf")).alias("v"))
    spark = facts.sparkSession
    import re
    from collections import Counter

    q = Counter(re.findall("[a-z0-9]+", query.lower()))
    asked = spark.createDataFrame(list(q.items()) or [("", 0)], "w string, qtf int").join(df, "w").select("w", (F.col("qtf") * F.col("idf")).alias("q"))
    qn = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    norm = vec.groupBy("fact_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dot = vec.join(F.broadcast(asked), "w").groupBy("fact_id").agg(F.sum(F.col("v") * F.col("q")).alias("dot"))
    scored = dot.join(norm, "fact_id").crossJoin(F.broadcast(qn)).select("fact_id", F.round(F.col("dot") / (F.col("norm") * F.col("qn")), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), "fact_id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "fact_id")))


def recurrence(arts: DataFrame, decay: float = 0.85) -> DataFrame:
    """(trace_id, value, turns, recurrence): each value's decayed recurrence at its last turn, the sum of decay^distance."""
    v = arts.select("trace_id", "value", "msg_idx").distinct()
    last = F.max("msg_idx").over(W.partitionBy("trace_id", "value"))
    return v.withColumn("last", last).groupBy("trace_id", "value").agg(F.count("*").alias("turns"), F.round(F.sum(F.pow(F.lit(decay), F.col("last") - F.col("msg_idx"))), 6).alias("recurrence"))
