"""Connected components over tables, without collecting a graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.session import shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts lineage, and columns prune."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node is connected with; ``edges`` (a, b) run both ways.

    Labels spread to neighbours and then jump to their labels' labels, so few rounds are needed."""
    labels = checkpointed(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        stepped = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = stepped.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = checkpointed(stepped.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root")))
        changed = after.join(labels.withColumnRenamed("root", "old"), "node").filter("root <> old").isEmpty()
        labels = after
        if changed:
            return labels
