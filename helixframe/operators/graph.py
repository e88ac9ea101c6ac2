"""Cutting lineage, running totals, connected components and label propagation."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder, not yet there, in the cluster's checkpoint folder; a local session that has none gets a temporary one. It goes when the application ends."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        known = spark.conf.get("spark.checkpoint.dir", None)
        if not known and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(known or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    where = f"{context.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the cluster's checkpoint folder by a Parquet table, of which later readers decode only the columns they use."""
    where = shared_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    out.written_to = where
    return out


def forgotten(df: DataFrame) -> None:
    """Removes a table that checkpointed() wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over all rows before, in the order of distinct keys; 0 for the first.

    Two levels, so that no task orders all rows: ranges of the order, whose sums give each its start,
    and a running sum inside each. What is broadcast is a row for each range.
    """
    placed = checkpointed(df.withColumn("__value", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("__part", before("__sum", Window.orderBy("__part")).alias("__start"))
    inside = placed.withColumn(name, before("__value", Window.partitionBy("__part").orderBy(*order)))
    return inside.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col(name)).cast("long")).drop("__value", "__part", "__start")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds name: numbers from 0 in the order of distinct keys."""
    return running_total(df, order, F.lit(1), name)


def large_star(edges: DataFrame) -> DataFrame:
    """Ties each larger neighbour of a node to the least of the node and its neighbours."""
    ways = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = ways.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return ways.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    tied = down.join(least, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("e"))
    return tied.select("e.src", "e.dst").where("src <> dst").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the least node reachable by edges (src, dst) in either direction.

    Rounds of large and small stars over the edges alone, until they are stars about the least nodes;
    nodes without edges are not in them. A chain of n takes about log n rounds.
    """
    state, before = checkpointed(edges.where("src <> dst").select("src", "dst").distinct()), None
    for _ in range(most_rounds):
        last, state = state, checkpointed(small_star(large_star(state)))
        forgotten(last)
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == before:
            found = state.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = mark
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def swept(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, old, new): all nodes have taken the winner among their neighbours' labels, one after the other in the order of nodes.

    A node sees the new labels of smaller nodes and the old ones of larger ones. So new labels are the
    only ones that fit to each other, and are found by taking all winners at once, again and again for
    the nodes of which a smaller neighbour has moved: as often as the longest chain of such moves.
    """
    state, rows = labels.select("node", F.col("label").alias("old"), F.col("label").alias("new")), near
    while True:
        seen = rows.join(state.withColumnRenamed("node", "dst"), "dst")
        votes = seen.groupBy("src", F.when(F.col("dst") < F.col("src"), F.col("new")).otherwise(F.col("old")).alias("label")).agg(F.round(F.sum("w"), 9).alias("w"))
        best = votes.groupBy("src").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("best"))
        before = state
        state = checkpointed(state.join(best, F.col("node") == F.col("src"), "left").select("node", "old", F.col("new").alias("was"), F.coalesce("best", "new").alias("new")))
        if rows is not near:
            forgotten(before)
        moved = state.where("new <> was").select(F.col("node").alias("dst"))
        if not moved.limit(1).count():
            return state
        rows = near.join(near.where("dst < src").join(moved, "dst", "left_semi").select("src").distinct(), "src", "left_semi")


def label_propagation(spark: SparkSession, nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, most_rounds: int = 100) -> DataFrame:
    """(node, label, settled): node after node, each takes the label with the largest sum of resolution / (dist + 1e-10) over its edges (src, dst, dist).

    A round goes through all nodes in their order, and each sees what those before it took (swept()
    does so in parallel, with the same result). It ends after a round in which no label changes, or after most_rounds;
    settled tells whether a node's label stayed in the last round. Ties go to the smallest label; nodes
    without edges keep theirs. Labels are then numbered by first appearance in the order of nodes.
    """
    near = checkpointed(edges.select("src", "dst", (resolution / (F.col("dist") + 1e-10)).alias("w")))
    labels = checkpointed(nodes.select("node", F.col("node").alias("label")).distinct().withColumn("settled", F.lit(True)))
    for _ in range(most_rounds):
        after = swept(near, labels)
        last, labels = labels, checkpointed(after.select("node", F.col("new").alias("label"), (F.col("new") == F.col("old")).alias("settled")))
        forgotten(last)
        forgotten(after)
        if not labels.where(~F.col("settled")).limit(1).count():
            break
    return renumbered(labels)


def renumbered(labels: DataFrame) -> DataFrame:
    """Labels as 0, 1, ... in the order in which they first appear along the nodes. Many labels are no single task: they are numbered by ranges."""
    firsts = labels.groupBy("label").agg(F.min("node").alias("first"))
    numbers = numbered(firsts, ["first"], "number").select("label", "number")
    return labels.join(numbers, "label").select("node", F.col("number").alias("label"), *[c for c in labels.columns if c not in ("node", "label")])
