"""Mixing sources to target weights along a curriculum that changes over the training run.

A schedule gives each source a weight in each phase of training time 0..1: the rate at which it is
asked for. The weight's integral over time is the source's share of all words (weights that are given
are first made shares of their phase). Targets stop at
max_epochs times what the source has; the excess goes to the others by share. A document's place in
its source's demand (a prefix sum over a fixed pseudo-random order) is then turned into a training
position by inverting the source's cumulative demand, and documents are range-sorted by position.

Prefix sums take two levels, so that a source with a third of all rows is not one task: sums of 4096
buckets of the order, then a running sum in each bucket.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, word_count

#: (start, end, weights in turn): the integrals over time are 5, 2 and 1.
CURRICULUM = ((0.0, 0.25, (8, 1, 0)), (0.25, 0.75, (4, 2, 1)), (0.75, 1.0, (4, 3, 2)))


def by_source(docs: DataFrame, source: Column, size: Column) -> DataFrame:
    return docs.groupBy(source.alias("source")).agg(F.sum(size).alias("source_size"))


def cyclic_schedule(sources: DataFrame, curriculum: tuple = CURRICULUM) -> DataFrame:
    """(source, t_start, t_end, weight): sources in code point order, null last, take a phase's weights in turn, again and again."""
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(curriculum[0][2])
    phases = F.array(*[F.struct(F.lit(float(start)).alias("t_start"), F.lit(float(end)).alias("t_end"), F.array(*[F.lit(float(w)) for w in weights]).alias("weights")) for start, end, weights in curriculum])
    rows = sources.select("source", at.alias("at")).select("source", "at", F.explode(phases).alias("p"))
    return rows.select("source", "p.t_start", "p.t_end", F.element_at("p.weights", F.col("at") + 1).alias("weight"))


def relative(schedule: DataFrame) -> DataFrame:
    """Weights as shares of their phase, times the mean of the phases' sums, so that training takes equal words in equal times."""
    total = F.sum("weight").over(Window.partitionBy("t_start", "t_end"))
    parts = schedule.withColumn("total", total)
    scale = parts.select("t_start", "t_end", "total").distinct().agg(F.sum((F.col("t_end") - F.col("t_start")) * F.col("total")).alias("scale"))
    parts = parts.join(F.broadcast(scale))  # one row
    return parts.withColumn("weight", F.when(F.col("total") > 0, F.col("weight") / F.col("total") * F.col("scale")).otherwise(0.0)).drop("total", "scale")


def integrate(schedule: DataFrame) -> DataFrame:
    """(source, share, curve): the share is the weight's integral over time; curve has the phases with the integral of each and before each."""
    parts = schedule.withColumn("mass", (F.col("t_end") - F.col("t_start")) * F.col("weight"))
    before = F.sum("mass").over(Window.partitionBy("source").orderBy("t_start").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0.0)))
    return parts.groupBy("source").agg(F.sum("mass").alias("share"), F.sort_array(F.collect_list(F.struct("before", "mass", "t_start", "t_end"))).alias("curve"))


def targets(sources: DataFrame, shares: DataFrame, max_epochs: float) -> DataFrame:
    """Water level: target = least(max_epochs * source_size, share * level), where the targets add up to all words.

    In the order of cap / share, the level is the largest of (words - caps before) / (shares from here on).
    """
    shares = shares.withColumnRenamed("source", "of")
    rows = sources.join(shares, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", F.coalesce("share", F.lit(0.0)).alias("share"), "curve")
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    rows = rows.withColumn("ratio", F.when(F.col("share") > 0, F.col("cap") / F.col("share")))
    order = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("share").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    words = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("level_here", F.when(ahead > 0, (words - before) / ahead))
    level = F.max("level_here").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("target", F.round(F.least(F.col("cap"), F.col("share") * F.coalesce(level, F.lit(0.0))), 6)).select("source", "source_size", "target", "share", "curve")


def position_of(offset: Column, target: Column, share: Column, curve: Column) -> Column:
    """The training time at which a source's cumulative demand reaches offset, to 9 decimals."""
    mass = offset / target * share
    found = F.filter(curve, lambda p: (p["mass"] > 0) & (mass < p["before"] + p["mass"]))
    phase = F.try_element_at(found, F.lit(1))
    inside = phase["t_start"] + (phase["t_end"] - phase["t_start"]) * F.greatest((mass - phase["before"]) / phase["mass"], F.lit(0.0))
    return F.round(F.coalesce(inside, F.lit(1.0)), 9)


def plan_mix(docs: DataFrame, schedule: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_epochs: int = 3) -> DataFrame:
    """(doc, version, source, size, source_size, target, taken, positions) of each row of docs, range-sorted by first position.

    size counts words (null text: 0). taken counts the words that the mix takes of a document over all
    passes; positions has the training time of each pass that takes some, and is empty where none does.
    Each pass takes a source in the order of md5 of the id; the last pass ends where the target is
    reached, so a document can be taken in part there. A source that the schedule lacks gets nothing.
    Without a schedule, sources follow CURRICULUM in turn.
    Repeated rows each count; null sources are a source; version is a hash of the text. No words at
    all: all targets are 0. An empty table gives an empty one.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    sized = materialize(sized).withColumn("bucket", F.substring("key", 1, 3))
    sources = by_source(sized, F.col("source"), F.col("size"))
    plan = targets(sources, integrate(relative(schedule) if schedule is not None else cyclic_schedule(sources)), max_epochs)

    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    base = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("base", base).alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
    buckets = buckets.select(F.col("b.source").alias("b_source"), F.col("bucket").alias("b_bucket"), "base", "source_size", "target", "share", "curve")

    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")), "left")
    placed = placed.withColumn("at", F.col("base") + F.col("inside"))
    quota = F.round("target").cast("long")
    passes = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    taken = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), quota - k * F.col("source_size") - F.col("at")))
    placed = placed.withColumn("taken", F.aggregate(passes, F.lit(0).cast("long"), lambda n, k: n + taken(k)))
    used = F.filter(passes, lambda k: taken(k) > 0)
    placed = placed.withColumn("positions", F.transform(used, lambda k: position_of(k * F.col("source_size") + F.col("at"), F.col("target"), F.col("share"), F.col("curve"))))
    first = F.try_element_at("positions", F.lit(1)).asc_nulls_last()
    placed = placed.repartitionByRange(first, F.col("key")).sortWithinPartitions(first, "key")
    return placed.select("doc", "version", "source", "size", "source_size", "target", "taken", "positions")


def mix(docs: DataFrame, schedule: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_epochs: int = 3) -> DataFrame:
    """The rows of docs as often as the mix takes them, range-sorted by training position; columns as in docs.

    A pass that takes half a document or more gives a row with its whole text, so each source's words
    are within half a document of its target. Documents without words are not taken.
    Each of several rows with one id, text and source has a place of its own in the plan; which of them
    takes which place is open, as they differ at most in other columns. Null ids, sources and texts are
    values like others. An empty table gives an empty one. Columns of docs keep their names and values.
    """
    plan = plan_mix(docs, schedule, id_col, source_col, text_col, max_epochs)
    whole = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    plan = plan.where("taken > 0").select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("source").alias("__source"), F.slice("positions", F.lit(1), whole).alias("__positions"))
    own = ["__doc", "__version", "__source"]
    plan = materialize(plan.groupBy(*own).agg(F.sort_array(F.collect_list("__positions")).alias("__places")))
    same = F.col(id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__version")) & F.col(source_col).eqNullSafe(F.col("__source"))
    rows = docs.join(plan, same).withColumn("__nth", F.lit(1))
    if plan.where(F.size("__places") > 1).limit(1).count():  # repeated rows
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0))))
    rows = rows.withColumn("__position", F.explode(F.try_element_at("__places", F.col("__nth"))))
    return rows.repartitionByRange("__position").sortWithinPartitions("__position").select(docs.columns)
