"""A memory of facts: statements and goals of messages, superseded by later ones, kept as a table and recalled by similarity."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefold.operators import memory as M

FACT = "id long, category string, clause string, trace_id string, msg_idx int, active boolean, superseded_by long, seq long"


def half_life(decay: float = 0.85) -> float:
    """After how many turns a decayed recurrence is half."""
    return math.log(0.5) / math.log(decay)


def terms(text: Column) -> Column:
    """Words and pairs of words of a text."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(w, pairs)


def extracted(messages: DataFrame, batch: int = 0) -> DataFrame:
    """Facts of messages: their statements and goals, all active; seq is the batch they came with."""
    a = M.anchors(messages)
    return a.withColumn("id", F.xxhash64("trace_id", "msg_idx", "clause_no", F.lit(batch))).select("id", F.col("kind").alias("category"), "clause", "trace_id", "msg_idx", F.lit(True).alias("active"), F.lit(None).cast("long").alias("superseded_by"), F.lit(batch).cast("long").alias("seq"))


def vectors(facts: DataFrame) -> DataFrame:
    """(id, vec): the TF-IDF weights of each fact's terms, of length 1, fitted over all facts."""
    tf = facts.select("id", F.explode(terms(F.col("clause"))).alias("t")).groupBy("id", "t").agg(F.count("*").alias("tf"))
    n = facts.agg(F.count("*").alias("n"))
    df = tf.groupBy("t").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("t", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    v = tf.join(df, "t").select("id", "t", (F.col("tf") * F.col("idf")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("id")))
    return v.select("id", "t", (F.col("v") / norm).alias("v"))


def superseded(facts: DataFrame, batch: int, theta: float = 0.25) -> DataFrame:
    """``facts`` after a batch has come: an older active fact of the same category is superseded by the newest fact of the batch
    that is closer to it than ``theta`` and shares a word that means something; facts of one batch leave each other alone."""
    v = vectors(facts.where(F.col("active") | (F.col("seq") == batch)))
    side = facts.select("id", "category", "seq", "active", "msg_idx", M.content_tokens(F.col("clause")).alias("ws"))
    new = v.join(side.where(F.col("seq") == batch), "id").select(F.col("id").alias("new_id"), "t", F.col("v").alias("nv"), F.col("category").alias("nc"), F.col("ws").alias("nws"), F.col("msg_idx").alias("at"))
    old = v.join(side.where((F.col("seq") < batch) & F.col("active")), "id").select("id", "t", "v", "category", "ws")
    near = old.join(new, "t").where("category = nc").groupBy("id", "new_id").agg(F.sum(F.col("v") * F.col("nv")).alias("similarity"), F.first(F.arrays_overlap("ws", "nws")).alias("shared"), F.first("at").alias("at"))
    hit = near.where((F.col("similarity") > theta) & F.col("shared")).groupBy("id").agg(F.max(F.struct("at", "new_id")).alias("by")).select("id", F.col("by.new_id").alias("by"))
    return facts.join(hit, "id", "left").select("id", "category", "clause", "trace_id", "msg_idx", (F.col("active") & F.col("by").isNull()).alias("active"), F.coalesce("superseded_by", "by").alias("superseded_by"), "seq")


def recalled(facts: DataFrame, query: str, k: int = 3, category: str | None = None, inactive: bool = False, recency: float = 0.0) -> DataFrame:
    """(id, category, clause, similarity, score, rank): the ``k`` facts closest to a query (a feature of the operator); recency is by batch.

    The query takes part in the fit, as one more fact would.
    """
    pool = facts if inactive else facts.where("active")
    if category:
        pool = pool.where(F.col("category") == category)
    asked = facts.sparkSession.createDataFrame([(None, query)], "id long, clause string")
    v = vectors(pool.select("id", "clause").unionByName(asked))
    q = v.where("id is null").select("t", F.col("v").alias("q"))  # as many rows as the query has terms
    sim = v.where("id is not null").join(F.broadcast(q), "t").groupBy("id").agg(F.sum(F.col("v") * F.col("q")).alias("similarity"))
    span = pool.agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    rows = pool.join(sim, "id", "left").crossJoin(F.broadcast(span)).withColumn("similarity", F.round(F.coalesce("similarity", F.lit(0.0)), 6))
    fresh = (F.col("seq") - F.col("first")) / F.greatest(F.col("last") - F.col("first"), F.lit(1))
    rows = rows.withColumn("score", F.round((1 - recency) * F.col("similarity") + recency * fresh, 6) if recency else F.col("similarity"))
    return rows.orderBy(F.desc("score"), "id").limit(k).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))).select("id", "category", "clause", "similarity", "score", "rank")


class Memory:
    """Facts below a path, one version a batch; what isn't of the newest version is never read."""

    def __init__(self, spark: SparkSession, path: str | None = None, theta: float = 0.25) -> None:
        self.spark, self.path, self.theta, self.batch = spark, path, theta, 0
        self.facts = spark.createDataFrame([], FACT)

    def add(self, messages: DataFrame) -> DataFrame:
        """Takes in the facts of messages; those that were added."""
        new = extracted(messages, self.batch)
        self.facts = superseded(self.facts.unionByName(new), self.batch, self.theta)
        if self.path:
            self.save()
        added = self.facts.where(F.col("seq") == self.batch)
        self.batch += 1
        return added

    def all(self, active_only: bool = True) -> DataFrame:
        return self.facts.where("active") if active_only else self.facts

    def recall(self, query: str, k: int = 3, **kw) -> DataFrame:
        return recalled(self.facts, query, k, **kw)

    def save(self, path: str | None = None) -> None:
        at = f"{path or self.path}/v{self.batch:06d}"
        self.facts.write.mode("overwrite").parquet(at)
        self.facts = self.spark.read.schema(FACT).parquet(at)  # a table of its own from here on

    def load(self, path: str | None = None) -> Memory:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.path)
        names = [f.getPath().getName() for f in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
        last = max(int(m.group(1)) for n in names if (m := re.fullmatch(r"v(\d{6})", n)))
        self.facts, self.batch = self.spark.read.schema(FACT).parquet(f"{path or self.path}/v{last:06d}"), last + 1
        return self


def term_counts(text: str) -> Counter:
    """The terms of a text in plain Python; the same as ``terms``."""
    w = re.findall("[a-z0-9]+", text.lower())
    return Counter([*w, *(" ".join(p) for p in zip(w, w[1:]))])
