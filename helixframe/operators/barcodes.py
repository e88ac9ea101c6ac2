"""Barcode correction against a whitelist, as equi-joins.

Distances become joins on derived keys: one-mismatch neighbours or one place blanked for distance 1,
equal segments (pigeonhole) for more, so no join compares all pairs. Distinct barcodes are corrected, once each.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import blanked, hamming, neighbours, segments
from helixframe.operators.graph import checkpointed, forgotten


def match_exact(barcodes: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(barcode, status): exact or no_match, for distinct barcodes."""
    wl = whitelist.select(F.col("barcode").alias("wl")).distinct()
    joined = barcodes.select("barcode").distinct().join(wl, F.col("barcode") == F.col("wl"), "left")
    return joined.select("barcode", F.when(F.col("wl").isNotNull(), "exact").otherwise("no_match").alias("status"))


def mismatch_index(whitelist: DataFrame) -> DataFrame:
    """(variant, n, original): each sequence one substitution from the whitelist, how many originals it has and the least of them."""
    spread = whitelist.select(F.col("barcode").alias("original")).distinct().select("original", F.explode(neighbours("original")).alias("variant"))
    return spread.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("original").alias("original"))


def nearest(barcodes: DataFrame, whitelist: DataFrame, max_distance: int, by: tuple = ()) -> DataFrame:
    """(*by, barcode, distance, n, original): the least distance up to max_distance to the whitelist (of each by) and how many have it.

    Distance by distance, nearest first; barcodes that have found entries do not go on.
    """
    wl = checkpointed(whitelist.select(*by, F.col("barcode").alias("original")).where("original is not null").distinct())
    seen = barcodes.select(*by, "barcode").where("barcode is not null").distinct()
    equal = wl.select(*by, F.col("original").alias("barcode"))
    listed = seen.join(equal, [*by, "barcode"], "left_semi")
    hits = listed.select(*by, "barcode", F.lit(0).alias("distance"), F.lit(1).cast("long").alias("n"), F.col("barcode").alias("original"))
    has_n = wl.where(F.col("original").contains("N")).limit(1).count() > 0
    off = F.lit(0) if has_n else F.length("barcode") - F.length(F.replace("barcode", F.lit("N"), F.lit("")))
    left = checkpointed(seen.join(equal, [*by, "barcode"], "left_anti").withColumn("off", off))
    for distance in range(1, max_distance + 1):
        asked = left.where(F.col("off") <= distance)
        if not asked.limit(1).count():
            continue
        near = one_off(asked, wl, by) if distance == 1 else at_distance(asked, wl, distance, by)
        found = checkpointed(near.groupBy(*by, "barcode").agg(F.count(F.lit(1)).alias("n"), F.min("original").alias("original")))
        hits = hits.unionByName(found.withColumn("distance", F.lit(distance)))
        if distance < max_distance:
            before, left = left, checkpointed(left.join(found.select(*by, "barcode"), [*by, "barcode"], "left_anti"))
            forgotten(before)
    return hits


def one_off(barcodes: DataFrame, wl: DataFrame, by: tuple) -> DataFrame:
    """(*by, barcode, original): barcodes (*by, barcode), none of them listed, and entries of wl (*by, original) that are equal but for one place."""
    cut = lambda df, c: df.where(F.length(c) > 0).select(*by, c, F.explode(blanked(c, 1)).alias("b")).select(*by, c, "b.at", "b.text")
    return cut(barcodes, "barcode").join(cut(wl, "original"), [*by, "at", "text"]).select(*by, "barcode", "original")


def at_distance(barcodes: DataFrame, wl: DataFrame, distance: int, by: tuple) -> DataFrame:
    """(*by, barcode, original): barcodes (*by, barcode, off) that have no nearer entry and entries of wl (*by, original) at the distance.

    off places are off for sure, as the barcode has an N there and no entry has. Where more than distance - off
    parts of a barcode have no such place, one of those is equal in both (pigeonhole). A barcode is cut in as
    few parts as do that, so that few entries share one of them.
    """
    cut = lambda c, parts: F.transform(segments(c, parts), lambda s: F.struct(F.lit(parts).alias("parts"), s["part"].alias("part"), s["text"].alias("text")))
    chosen = F.lit(None)
    for parts in range(distance + 1, 0, -1):
        free = F.filter(cut("barcode", parts), lambda s: (F.col("off") == 0) | ~s["text"].contains("N"))
        chosen = F.when(F.size(free) > F.lit(distance) - F.col("off"), free).otherwise(chosen)
    asked = barcodes.select(*by, "barcode", F.length("barcode").alias("len"), F.explode(chosen).alias("s")).select(*by, "barcode", "len", "s.*")
    every = F.flatten(F.array(*[cut("original", parts) for parts in range(1, distance + 2)]))
    given = wl.select(*by, "original", F.length("original").alias("len"), F.explode(every).alias("s")).select(*by, "original", "len", "s.*")
    near = asked.join(given, [*by, "len", "parts", "part", "text"]).select(*by, "barcode", "original")
    return near.where(hamming("barcode", "original") == distance).distinct()


def lookup(whitelist: DataFrame, by: tuple = ()) -> DataFrame:
    """(*by, key, exact, n, original): every whitelist entry and every sequence one substitution from some, n of them; one row a key of each by."""
    wl = whitelist.select(*by, F.col("barcode").alias("original")).distinct()
    own = F.array(F.struct(F.col("original").alias("key"), F.lit(True).alias("exact")))
    near = F.transform(neighbours("original"), lambda s: F.struct(s.alias("key"), F.lit(False).alias("exact")))
    spread = wl.select(*by, "original", F.explode(F.concat(own, near)).alias("k")).select(*by, "original", "k.*")
    return spread.groupBy(*by, "key").agg(F.bool_or("exact").alias("exact"), F.count_if(~F.col("exact")).alias("n"), F.min(F.when(~F.col("exact"), F.col("original"))).alias("original"))


def judged(rows: DataFrame, table: DataFrame, max_distance: int, by: tuple = ()) -> DataFrame:
    """rows with status, corrected, distance and open: whether the barcode is neither listed nor a variant. One left join."""
    known = (table if max_distance else table.where("exact")).withColumnsRenamed({c: f"__{c}" for c in by})
    joined = rows.join(known, [F.col("barcode") == F.col("key"), *[F.col(c) == F.col(f"__{c}") for c in by]], "left")
    exact = F.coalesce(F.col("exact"), F.lit(False))
    one = F.coalesce(~exact & (F.col("n") == 1), F.lit(False))
    added = {
        "status": F.when(F.col("barcode").isNull(), F.lit(None)).when(exact, "exact").when(one, "corrected").otherwise("no_match"),
        "corrected": F.when(exact, F.col("key")).when(one, F.col("original")),
        "distance": F.when(F.col("barcode").isNotNull(), one.cast("int")),
        "open": F.col("barcode").isNotNull() & F.col("key").isNull(),
    }
    return joined.withColumns(added).select(*rows.columns, *added)


def correct(barcodes: DataFrame, whitelist: DataFrame, max_distance: int = 1) -> DataFrame:
    """(barcode, status, corrected, distance) of each distinct barcode; status exact, corrected or no_match.

    Exact matches come first. A one-mismatch variant of one whitelist entry is corrected to it; of
    several, it has no match, whatever the distance allowed. Only barcodes that are no such variant go
    on to the nearest entry within max_distance, which must be the only one at its distance. The
    barcodes are read once: beyond distance 1, the distinct ones are written before the second search.
    """
    wl = whitelist.select("barcode")
    seen = barcodes.select("barcode").distinct()
    if max_distance <= 1:
        return judged(seen.where("barcode is not null"), lookup(wl), max_distance).drop("open")
    first = checkpointed(judged(checkpointed(seen).where("barcode is not null"), lookup(wl), max_distance))
    far = nearest(first.where("open").select("barcode"), wl, max_distance).where("n = 1").select("barcode", F.col("distance").alias("far"), F.col("original").alias("found"))
    return with_far(first, far)


def with_far(rows: DataFrame, far: DataFrame, by: tuple = ()) -> DataFrame:
    """rows of judged() with the only nearest entries (*by, barcode, far, found) put in."""
    joined, hit = rows.join(far, [*by, "barcode"], "left"), F.col("far").isNotNull()
    added = {"status": F.when(hit, "corrected").otherwise(F.col("status")), "corrected": F.coalesce("found", "corrected"), "distance": F.coalesce("far", "distance")}
    return joined.withColumns(added).drop("open", "far", "found")


def correct_reads(reads: DataFrame, whitelist: DataFrame, max_distance: int = 1, by: tuple = ()) -> DataFrame:
    """Adds status, cell (the corrected barcode or null) and distance to each read; null barcodes stay null.

    by: columns of reads and whitelist that name the whitelist of a read, such as its sample. Within
    distance 1 the reads meet the lookup table in one join, without a pass for distinct barcodes.
    """
    wl = whitelist.select(*by, "barcode")
    first = judged(reads, lookup(wl, by), max_distance, by)
    if max_distance <= 1:
        return first.drop("open").withColumnRenamed("corrected", "cell")
    left = checkpointed(first.where("open").select(*by, "barcode").distinct())
    far = nearest(left, wl.distinct(), max_distance, by).where("n = 1").select(*by, "barcode", F.col("distance").alias("far"), F.col("original").alias("found"))
    return with_far(first, far, by).select(*reads.columns, "status", F.col("corrected").alias("cell"), "distance")


def check_lengths(whitelist: DataFrame) -> DataFrame:
    """The whitelist; fails when its barcodes differ in length."""
    lengths = whitelist.agg(F.count_distinct(F.length("barcode")).alias("n"))
    if lengths.first()["n"] > 1:
        raise ValueError("barcodes of a whitelist must have one length")
    return whitelist
