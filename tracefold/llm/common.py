"""What the operators of this subpackage share: tables, cut lineage, connected groups.

Rules that hold for each of them: rows whose key (doc_id, vec_id ...) is null are left out of reports, null
texts count as empty, and only the columns named in a function's docstring are read, so that further
columns, whatever their names, make no difference.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str = "step") -> tuple[DataFrame, str]:
    """``df`` as a table written to the shared folder: its lineage is cut, and it outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets the executors delete the shuffle files of what is done with; Spark does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(taken: list[str], *names: str) -> list[str]:
    """Each of ``names``, with as many underscores as it takes to be none of ``taken`` (case doesn't count)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def kept(df: DataFrame, judge: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of ``df``, all columns, for which ``judge`` says true: a narrow pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(judge(b), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected groups of the graph with edges (a, b), as rows (node, root): root is the group's least node.

    Alternating large-star and small-star steps; every round is two shuffles of the edges and is written to the
    shared folder. Loops and repeated edges make no difference. Nodes that have no edge don't occur.
    """
    spark = edges.sparkSession

    def least(e: DataFrame) -> DataFrame:
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(m.select("u", F.least("u", "m").alias("m")), "u")

    e, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, new_path = written(small, "edges")
        remove(spark, path)
        e, path = new, new_path
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the groups didn't settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
