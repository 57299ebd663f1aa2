"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a word: the ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
BREAK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII blanks, unchanged. Null or blank text: no words."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.filter(F.split(bare, BREAK), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made for local runs where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads neither compute it again nor depend on one executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, label) with label the smallest node reachable over edges (a, b); nodes without an edge do not occur.

    Each round every node takes the smallest label around it, then the label of its label, until a round changes
    nothing. A round joins and groups by node, so that a hub is summed up before it is shuffled.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        after = written(step.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("label")), name)
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels
