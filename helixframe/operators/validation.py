"""Scores of results against a truth: confusion, correlation, clustering, concordance, pass or fail."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import choose_two, ratio
from helixframe.operators.graph import running_total

# Thresholds of the stages.
F1_AT_LEAST, PEARSON_AT_LEAST, ARI_AT_LEAST = 0.95, 0.90, 0.70


def rated(confusion: DataFrame, digits: int = 9) -> DataFrame:
    """Adds sensitivity, specificity, precision, recall and f1 to rows of tp, fp, tn, fn; 0 on a zero denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    r = lambda a, b: F.round(ratio(a, b), digits)
    return confusion.withColumns({"sensitivity": r(tp, tp + fn), "specificity": r(tn, tn + fp), "precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "f1": r(2 * tp, 2 * tp + fp + fn)})


def confusion(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row tp, fp, tn, fn of two boolean columns."""
    return rows.agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(~truth & ~predicted).alias("tn"), F.count_if(truth & ~predicted).alias("fn")
    )


def detection_sets(truth: DataFrame, detected: DataFrame, observed: DataFrame) -> DataFrame:
    """One row of rates from three sets of barcodes: tp in truth and detected, fp detected only, fn truth only, tn observed and in neither."""
    mark = lambda df, name: df.select("barcode").distinct().withColumn(name, F.lit(True))
    rows = mark(truth, "t").join(mark(detected, "d"), "barcode", "full").join(mark(observed, "o"), "barcode", "full").fillna(False, ["t", "d", "o"])
    t, d = F.col("t"), F.col("d")
    return rated(rows.agg(F.count_if(t & d).alias("tp"), F.count_if(~t & d).alias("fp"), F.count_if(~t & ~d).alias("tn"), F.count_if(t & ~d).alias("fn")))


def extraction_confusion(matched: DataFrame, truth: DataFrame, mutated: DataFrame, invalid: DataFrame) -> DataFrame:
    """read_confusion() of reads (barcode, status, cell) whose truth is known by barcode: mutated (mutated, original) and invalid (barcode).

    A sequence that comes from several originals is right with any of them; its reads count once each.
    """
    pairs = mutated.select(F.col("mutated").alias("barcode"), F.col("original").alias("cell")).distinct()
    marks = [(truth, "known", ["barcode"]), (invalid, "bad", ["barcode"]), (pairs, "mutation", ["barcode"]), (pairs, "right", ["barcode", "cell"])]
    rows = matched
    for df, name, on in marks:
        rows = rows.join(df.select(*on).distinct().withColumn(name, F.lit(True)), on, "left")
    return read_confusion(rows.fillna(False, [name for _, name, _ in marks]))


def read_confusion(rows: DataFrame) -> DataFrame:
    """One row tp, fp, tn, fn, total_mutations, correct_corrections, correction_accuracy with rates.

    rows: reads (status, known, bad, mutation, right), a row each. Exact barcodes are hits if known. Corrected
    ones: of a mutation, a hit if right (corrected to its original), else false; of an invalid (bad) barcode,
    false; else a hit. Unmatched: invalid ones are true negatives, all others misses.
    """
    exact, fixed, none = (F.col("status") == s for s in ("exact", "corrected", "no_match"))
    mutation, bad, right = F.col("mutation"), F.col("bad"), F.col("right")
    kind = (
        F.when(exact & F.col("known"), "tp")
        .when(fixed & mutation & right, "tp")
        .when(fixed & mutation, "fp")
        .when(fixed & bad, "fp")
        .when(fixed, "tp")
        .when(none & bad, "tn")
        .when(none, "fn")
    )
    rows = rows.withColumn("kind", kind)
    out = rows.agg(
        *[F.count_if(F.coalesce(F.col("kind") == k, F.lit(False))).alias(k) for k in ("tp", "fp", "tn", "fn")],
        F.count_if((fixed | none) & mutation).alias("total_mutations"),
        F.count_if(fixed & mutation & right).alias("correct_corrections"),
    )
    accuracy = F.when(F.col("total_mutations") == 0, 1.0).otherwise(ratio("correct_corrections", "total_mutations"))
    return rated(out.withColumn("correction_accuracy", F.round(accuracy, 9)))


def pearson_of(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; 0 for fewer than two rows or a constant side."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when((F.count(x) < 2) | (F.count(x) * spread < 1e-15), 0.0).otherwise(F.try_divide(F.covar_pop(x, y), spread))


def correlation(pairs: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    return pairs.agg(F.round(pearson_of(F.col(x), F.col(y)), digits).alias("pearson"))


def average_ranks(pairs: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank of a column, ties sharing their average; over distinct values only."""
    counted = pairs.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    below = running_total(counted, ["__v"], F.col("__c"), "__below")
    ranks = below.select("__v", (F.col("__below") + (F.col("__c") + 1) / 2).alias(name))
    return pairs.join(ranks, F.col(column).eqNullSafe(F.col("__v"))).drop("__v")


def spearman(pairs: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    ranked = average_ranks(average_ranks(pairs, x, "__rx"), y, "__ry")
    return ranked.agg(F.round(pearson_of(F.col("__rx"), F.col("__ry")), digits).alias("spearman"))


def errors(pairs: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """One row mae, rmse; 0 for no rows."""
    d = F.col(x) - F.col(y)
    return pairs.agg(F.round(F.coalesce(F.avg(F.abs(d)), F.lit(0.0)), digits).alias("mae"), F.round(F.coalesce(F.sqrt(F.avg(d * d)), F.lit(0.0)), digits).alias("rmse"))


def contingency(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(kind, n): counts of pairs of labels, of each side's labels and of all, by grouping sets."""
    grouped = rows.select(F.col(truth).alias("t"), F.col(predicted).alias("p")).groupingSets([["t", "p"], ["t"], ["p"], []], "t", "p").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 0, "both").when(F.col("g") == 1, "truth").when(F.col("g") == 2, "predicted").otherwise("all")
    return grouped.select(kind.alias("kind"), "t", "p", "n")


def clustering_scores(rows: DataFrame, truth: str, predicted: str, digits: int = 8, constant_nmi: float = 0.0) -> DataFrame:
    """One row ari, nmi, n_truth, n_predicted. NMI has the arithmetic mean below, clamped to 0..1; constant_nmi when both sides are constant (other libraries give 1)."""
    counts = contingency(rows, truth, predicted)
    pairs = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, choose_two("n"))), F.lit(0.0))
    plogs = lambda k: F.coalesce(F.sum(F.when((F.col("kind") == k) & (F.col("n") > 0), F.col("n") * F.log("n"))), F.lit(0.0))
    sums = counts.agg(
        *[pairs(k).alias(f"c_{k}") for k in ("both", "truth", "predicted", "all")],
        *[plogs(k).alias(f"l_{k}") for k in ("both", "truth", "predicted")],
        F.coalesce(F.sum(F.when(F.col("kind") == "all", F.col("n"))), F.lit(0)).alias("n"),
        F.count_if(F.col("kind") == "truth").alias("n_truth"),
        F.count_if(F.col("kind") == "predicted").alias("n_predicted"),
    )
    c = {k: F.col(f"c_{k}") for k in ("both", "truth", "predicted", "all")}
    expected = F.try_divide(c["truth"] * c["predicted"], c["all"])
    below = (c["truth"] + c["predicted"]) / 2 - expected
    flat = F.abs(below) < 1e-15
    ari = F.when(F.col("n") == 0, 0.0).when(c["all"] == 0, 0.0).when(flat, F.when(F.abs(c["both"] - expected) < 1e-15, 1.0).otherwise(0.0)).otherwise(F.try_divide(c["both"] - expected, below))
    n = F.col("n").cast("double")
    entropy = lambda k: F.log(n) - F.col(f"l_{k}") / n
    shared = entropy("truth") + entropy("predicted") - entropy("both")
    mean = (entropy("truth") + entropy("predicted")) / 2
    nmi = F.when(F.col("n") == 0, 0.0).when(mean < 1e-15, constant_nmi).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(shared, mean))))
    return sums.select(F.round(ari, digits).alias("ari"), F.round(nmi, digits).alias("nmi"), "n_truth", "n_predicted")


def aligned(truth: DataFrame, observed: DataFrame) -> DataFrame:
    """(gene, barcode, truth, observed) for every gene and cell of the truth; what is absent is 0."""
    grid = truth.select("gene").distinct().crossJoin(truth.select("barcode").distinct())
    rows = grid.join(truth.withColumnRenamed("n", "truth"), ["gene", "barcode"], "left").join(observed.withColumnRenamed("n", "observed"), ["gene", "barcode"], "left")
    return rows.select("gene", "barcode", F.coalesce("truth", F.lit(0)).alias("truth"), F.coalesce("observed", F.lit(0)).alias("observed"))


def sparse_correlation(truth: DataFrame, observed: DataFrame, digits: int = 6) -> DataFrame:
    """One row pearson over every gene and cell of the truth, from the sparse entries: the zeros of the grid count, but need no rows."""
    sums = lambda c: F.sum(F.col(c).cast("double"))
    seen = observed.join(truth.select("gene").distinct(), "gene", "left_semi").join(truth.select("barcode").distinct(), "barcode", "left_semi")
    pairs = truth.select("gene", "barcode", F.col("n").alias("t")).join(seen.select("gene", "barcode", F.col("n").alias("o")), ["gene", "barcode"], "full").fillna(0, ["t", "o"])
    pairs = pairs.withColumns({"tt": F.col("t") * F.col("t"), "oo": F.col("o") * F.col("o"), "to": F.col("t") * F.col("o")})
    row = pairs.agg(*[sums(c).alias(c) for c in ("t", "o", "tt", "oo", "to")])
    size = truth.agg((F.count_distinct("gene") * F.count_distinct("barcode")).cast("double").alias("size"))
    row = row.crossJoin(F.broadcast(size))  # one row each
    spread = lambda a, aa: F.col(aa) / F.col("size") - F.pow(F.col(a) / F.col("size"), 2)
    both = F.sqrt(F.greatest(spread("t", "tt") * spread("o", "oo"), F.lit(0.0)))
    shared = F.col("to") / F.col("size") - F.col("t") * F.col("o") / (F.col("size") * F.col("size"))
    return row.select(F.round(F.when((F.col("size") < 2) | F.col("size").isNull() | (F.col("size") * both < 1e-15), 0.0).otherwise(shared / both), digits).alias("pearson"))


def concordance(truth: DataFrame, observed: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """One row: the share of cells (or genes) of both sides whose totals differ by at most the tolerance; two zeros agree."""
    a = truth.groupBy(key).agg(F.sum("n").alias("t"))
    b = observed.groupBy(key).agg(F.sum("n").alias("o"))
    off = F.abs(F.col("o") - F.col("t"))
    near = F.when(F.col("t") == 0, F.col("o") == 0).otherwise(F.try_divide(off.cast("double"), F.col("t").cast("double")) <= tolerance)
    return a.join(b, key).agg(F.round(ratio(F.count_if(near), F.count(F.lit(1))), 9).alias(f"{key}_concordance"))


def pass_fail(stages: DataFrame) -> DataFrame:
    """(stage, score, threshold, passed) and the overall row: at least one stage ran, and all that ran passed. A null score did not run."""
    judged = stages.withColumn("passed", F.col("score") >= F.col("threshold"))
    overall = judged.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))
    return judged.unionByName(overall.select(F.lit("overall").alias("stage"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"), "passed"))


def stamped(report: DataFrame, seconds: float) -> DataFrame:
    """The report with the time it was made (RFC 3339, UTC) and how long it took."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return report.withColumn("created", now).withColumn("seconds", F.lit(float(seconds)))
