"""Quality metrics of cells and samples."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequences import is_mito, ratio
from helixframe.operators.graph import numbered

# Thresholds of the warnings.
MIN_VALIDITY, MIN_MAPPING, MIN_SATURATION, MIN_MEDIAN_GENES = 0.5, 0.5, 0.3, 200


def cell_metrics(counts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(barcode, n_genes, total, mito_percent) of each cell; cells of known without entries have zeros."""
    sums = counts.groupBy("barcode").agg(
        F.count_distinct("gene").alias("n_genes"), F.sum("n").alias("total"), F.sum(F.when(is_mito("gene"), F.col("n")).otherwise(0)).alias("mito")
    )
    if known is not None:
        sums = known.select("barcode").distinct().join(sums, "barcode", "left").fillna(0, ["n_genes", "total", "mito"])
    return sums.select("barcode", "n_genes", "total", F.round(100 * ratio("mito", "total"), 6).alias("mito_percent"))


def upper_median(column: str) -> Column:
    """The value at place floor(n / 2) from 0 in ascending order; 0 for no rows.

    Spark counts the distinct values of each task and merges the counts, so no task orders all rows.
    """
    return F.coalesce(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)"), F.lit(0))


def summary(cells: DataFrame, columns: tuple = ("n_genes", "total")) -> DataFrame:
    """One row: the number of cells, means, upper medians, and medians truncated to integers."""
    return cells.agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in columns],
        *[F.coalesce(F.median(c).cast("long"), F.lit(0)).alias(f"int_median_{c}") for c in columns],
        *[upper_median(c).cast("long").alias(f"median_{c}") for c in columns],
    )


def rates(metrics: DataFrame) -> DataFrame:
    """Adds barcode_validity, mapping_rate, assignment_rate and saturation to rows of totals; 0 where a denominator is 0."""
    return metrics.withColumns(
        {
            "barcode_validity": F.round(ratio("valid_reads", "total_reads"), 6),
            "mapping_rate": F.round(ratio("mapped_reads", "valid_reads"), 6),
            "assignment_rate": F.round(ratio("assigned_reads", "mapped_reads"), 6),
            "saturation": F.when(F.col("assigned_reads") > 0, F.round(1 - ratio("unique_umis", "assigned_reads"), 6)).otherwise(0.0),
        }
    )


def warnings_of(rows: DataFrame) -> DataFrame:
    """Adds warnings, an array of the rules that a report breaks, in a fixed order."""
    rules = (
        (F.col("barcode_validity") < MIN_VALIDITY, "low barcode validity"),
        (F.col("mapping_rate") < MIN_MAPPING, "low mapping rate"),
        (F.col("saturation") < MIN_SATURATION, "low sequencing saturation"),
        (F.col("median_genes") < MIN_MEDIAN_GENES, "low median genes per cell"),
    )
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(broken, text) for broken, text in rules])))


def live_warnings(rows: DataFrame) -> DataFrame:
    """Adds the live view's warnings: valid reads under 50 %, median genes under 500, cells under 100."""
    rules = ((F.col("valid_percent") < 50, "valid barcodes under 50 %"), (F.col("median_genes") < 500, "median genes under 500"), (F.col("n_cells") < 100, "fewer than 100 cells"))
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(broken, text) for broken, text in rules])))


def report(rows: DataFrame, sample: str = "sample") -> DataFrame:
    """(sample_name, report): rows of metrics as JSON."""
    return rows.select(F.lit(sample).alias("sample_name"), F.to_json(F.struct(*rows.columns)).alias("report"))


def passing(cells: DataFrame, min_genes: int = 200, max_genes: int = 10000) -> Column:
    """Cells within bounds, both inclusive: counted, not removed."""
    return F.col("n_genes").between(min_genes, max_genes)


def filter_cells(cells: DataFrame, min_genes: int = 200, max_genes: int = 10000, max_mito: float = 20.0) -> DataFrame:
    """Cells with min_genes genes or more, fewer than max_genes, and less than max_mito % of mitochondrial counts."""
    return cells.where((F.col("n_genes") >= min_genes) & (F.col("n_genes") < max_genes) & (F.col("mito_percent") < max_mito))


def filter_genes(counts: DataFrame, min_cells: int = 3) -> DataFrame:
    """Entries of genes seen in min_cells cells or more."""
    often = counts.groupBy("gene").agg(F.count_distinct("barcode").alias("c")).where(F.col("c") >= min_cells)
    return counts.join(often, "gene", "left_semi")


def knee(cells: DataFrame, column: str = "total") -> DataFrame:
    """Adds rank from 1 by decreasing counts, ties by barcode.

    Cells are numbered by ranges, so no task orders all of them.
    """
    ranked = numbered(cells.select("barcode", column, (-F.col(column)).alias("__down")), ["__down", "barcode"], "rank")
    return ranked.select("barcode", column, (F.col("rank") + 1).alias("rank"))


def cluster_stats(cells: DataFrame) -> DataFrame:
    """(cluster, n_cells, percent, median_genes, median_total) with upper medians."""
    sizes = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"), upper_median("n_genes").cast("long").alias("median_genes"), upper_median("total").cast("long").alias("median_total"))
    return sizes.withColumn("percent", F.round(100 * F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy(F.lit(1))), 6))


def of_clusters(cells: DataFrame, wanted: list | None) -> DataFrame:
    """Cells of the clusters asked for; all where none is named."""
    return cells.where(F.col("cluster").isin(*wanted)) if wanted else cells


def long_metrics(cells: DataFrame, keys: tuple = ("n_genes", "total", "mito_percent")) -> DataFrame:
    """(barcode, metric, value) of those keys that the table has: the rows behind a violin plot."""
    have = [k for k in keys if k in cells.columns]
    if not have:
        raise ValueError(f"the cells have none of {', '.join(keys)}")
    return cells.select("barcode", *[F.col(k).cast("double").alias(k) for k in have]).unpivot("barcode", have, "metric", "value")


def web_report(job_id: str, counters: DataFrame, cells: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of the nine keys of a job's report, from extraction_counters(), cell_metrics() and the counts."""
    row = counters.select(F.lit(job_id).alias("job_id"), "total_reads", "valid_barcodes", "corrected_barcodes", (F.col("total_reads") - F.col("valid_barcodes")).alias("invalid_barcodes"))
    sizes = cells.agg(F.count(F.lit(1)).alias("cells"), upper_median("n_genes").cast("long").alias("median_genes_per_cell"), upper_median("total").cast("long").alias("median_umis_per_cell"))
    genes = counts.agg(F.count_distinct("gene").alias("genes"))
    joined = row.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(genes))  # one row each
    return joined.select("job_id", "total_reads", "valid_barcodes", "corrected_barcodes", "invalid_barcodes", "cells", "genes", "median_genes_per_cell", "median_umis_per_cell")


def histogram(cells: DataFrame, column: str, width: int) -> DataFrame:
    """(bucket, n): cells in each range of width, by its lower end."""
    return cells.groupBy((F.floor(F.col(column) / width) * width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
