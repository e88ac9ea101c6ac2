"""UMI deduplication within groups (cell, gene)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import blanked, hamming
from helixframe.operators.graph import checkpointed, connected_components, numbered


def distinct_umis(reads: DataFrame) -> DataFrame:
    """(gene, cell, n_umis, umi): distinct UMIs of each cell and gene, and the least as representative."""
    return reads.groupBy("gene", "cell").agg(F.count_distinct("umi").alias("n_umis"), F.min("umi").alias("umi"))


def exact_umis(reads: DataFrame) -> DataFrame:
    """(gene, cell, umi, n): reads of each UMI."""
    return reads.groupBy("gene", "cell", "umi").agg(F.count(F.lit(1)).alias("n"))


def alike(rows: DataFrame, column: str, max_distance: int) -> DataFrame:
    """(gene, cell, near): values of column of the UMIs of a cell and gene that differ in the same places only, by blanking each choice of max_distance places.

    Such a list has at most as many UMIs as there are letters (to the power max_distance), and a UMI of
    12 bases is in 12 lists (66 for distance 2). So a large cell and gene makes no large list, and the
    work grows with the number of UMIs, not of pairs. Rows without gene, cell or UMI are in none.
    """
    cut = rows.where("gene is not null and cell is not null").select("gene", "cell", column, F.explode(blanked("umi", max_distance)).alias("b"))
    lists = cut.groupBy("gene", "cell", "b.at", "b.text").agg(F.collect_set(column).alias("near"))
    return lists.where(F.size("near") > 1).select("gene", "cell", "near")


def umi_edges(counted: DataFrame, max_distance: int = 1) -> DataFrame:
    """(gene, cell, a, b, distance), a < b: UMIs of one cell and gene within max_distance, from lists of UMIs that are alike."""
    firsts = alike(counted, "umi", max_distance).select("*", F.explode("near").alias("a"))
    pairs = firsts.select("gene", "cell", "a", F.explode(F.filter("near", lambda u: u > F.col("a"))).alias("b"))
    pairs = pairs.distinct() if max_distance > 1 else pairs  # two that differ in one place only are alike in several choices of two
    return pairs.withColumn("distance", hamming("a", "b"))


def umi_groups(counted: DataFrame, max_distance: int = 1) -> DataFrame:
    """(gene, cell, representative, n_members, total, members): connected UMIs; the one with most reads stands for them, the least of equals.

    counted has (gene, cell, umi, n). Components run over all groups at once, on numbers, so a large group
    is not one task; of a list of UMIs that are alike, each is tied to the first only.
    """
    nodes = checkpointed(numbered(counted.select("gene", "cell", "umi", "n"), ["gene", "cell", "umi"], "node"))
    ties = alike(nodes, "node", max_distance).select(F.explode("near").alias("src"), F.array_min("near").alias("dst"))
    joined = nodes.join(connected_components(nodes, ties), "node")
    best = F.min_by("umi", F.struct(-F.col("n"), F.col("umi")))
    members = F.sort_array(F.collect_list(F.struct("umi", "n")))
    return joined.groupBy("gene", "cell", "component").agg(best.alias("representative"), F.count(F.lit(1)).alias("n_members"), F.sum("n").alias("total"), members.alias("members")).drop("component")
