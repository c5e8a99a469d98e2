"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder that spark.checkpoint.dir names, and read back: without its lineage.

    Only in local mode (tests), where none is named, a temporary folder takes its
    place. A table read anew begins a plan anew: what Spark keeps of a checkpoint's
    plan (constraints on its columns), or of a cached table's, doubles with each
    round that joins a table with itself.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node of its component) of every node with an edge to another.

    Labels move to the least one among the neighbours and then, by a join of the
    labels with themselves, to their own label's label, so the rounds grow with
    the logarithm of the longest path. Repeated edges count once.
    """
    one_way = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    near = kept(one_way.union(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = kept(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        passed = near.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("other"))
        new = labels.join(passed, "u").select("u", F.least("label", "other").alias("new"), "label")
        jump = new.select(F.col("u").alias("new"), F.col("new").alias("further"))
        new = kept(new.join(jump, "new").select("u", F.least("new", "further").alias("new"), "label"))
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("u", F.col("new").alias("label"))
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("root"))
