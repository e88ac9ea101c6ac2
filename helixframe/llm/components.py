"""Connected components of a link table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import discard, materialize


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a vertex to the least of it and its neighbours."""
    ways = both_ways(edges)
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
    return joined.select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for each node that has an edge (a, b) to another.

    Every round is written out and the one before removed; the links end as stars about the least
    nodes. Minima are partial before the shuffle. The join back to them has all links of a node on one
    key; adaptive execution splits such a partition where it is large.
    """
    state, before = materialize(edges.where("a <> b").select("a", "b")), None
    for _ in range(most_rounds):
        last, state = state, materialize(small_star(large_star(state)))
        discard(last)
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
