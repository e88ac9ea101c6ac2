"""Whole analyses: extract, count, qc, analyze, validate, batch, compare."""

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import schemas
from helixframe.operators import analysis, barcodes, graph, matrix, qc, reads, umis, validation
from helixframe.operators.leiden import leiden
from helixframe.operators.neighbours import knn_forest
from helixframe.sinks import files as sinks
from helixframe.sources import files as sources


def extract(reads_in: DataFrame, whitelist: DataFrame | None, protocol: str | schemas.Protocol = "10x-3prime-v3", max_mismatch: int = 1, min_barcode_qual: int | None = 10) -> DataFrame:
    """Reads with barcode, umi, status and cell. Short reads and those of low quality have a null status; without a whitelist, barcodes are taken as they are."""
    parts = reads.extract(reads_in, protocol)
    if min_barcode_qual is not None:
        ok = reads.quality_ok("barcode_qual", min_barcode_qual)
        parts = parts.withColumn("barcode", F.when(ok, F.col("barcode")))
    if whitelist is None:
        return parts.withColumn("status", F.when(F.col("barcode").isNotNull(), "exact")).withColumn("cell", F.col("barcode")).withColumn("distance", F.lit(0))
    return barcodes.correct_reads(parts, whitelist, max_mismatch)


def count_reads(alignments: DataFrame, min_mapq: int = 30) -> DataFrame:
    """(gene, barcode, n) of mapped alignments with a gene and a cell: reads, not UMIs."""
    rows = reads.with_gene(reads.mapped(alignments, min_mapq)).where(F.col("gene").isNotNull() & F.col("cell_barcode").isNotNull())
    return matrix.count(rows.select("gene", F.col("cell_barcode").alias("barcode")))


def count_umis(reads_in: DataFrame, whitelist: DataFrame | None, protocol: str = "10x-3prime-v3", max_mismatch: int = 1) -> DataFrame:
    """Reads to (gene, cell, n_umis, umi) in one pass: correct, take the gene, count distinct UMIs."""
    found = extract(reads_in, whitelist, protocol, max_mismatch, None)
    return umis.distinct_umis(found.where(F.col("cell").isNotNull() & F.col("gene").isNotNull()))


def sample_qc(counts: DataFrame, sample: str = "sample", totals: DataFrame | None = None, min_genes: int = 200, max_genes: int = 10000) -> DataFrame:
    """One row of metrics with warnings and the number of cells within bounds; totals adds the rates of reads, which are 0 without."""
    cells = qc.cell_metrics(counts)
    row = qc.summary(cells)
    row = row.crossJoin(F.broadcast(cells.agg(F.count_if(qc.passing(cells, min_genes, max_genes)).alias("cells_passing"))))  # one row
    if totals is not None:
        row = row.crossJoin(F.broadcast(qc.rates(totals)))  # one row
    else:
        row = row.withColumns({c: F.lit(0.0) for c in ("barcode_validity", "mapping_rate", "assignment_rate", "saturation")})
    row = row.withColumn("median_genes", F.col("median_n_genes"))
    return qc.warnings_of(row).withColumn("sample_name", F.lit(sample))


def analyze(counts: DataFrame, n_pcs: int = 50, n_neighbors: int = 15, resolution: float = 1.0, target_sum: float = 10000.0, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5) -> dict[str, DataFrame]:
    """Counts to hvg, cells (node, barcode), pca (node, scores), neighbours, clusters (node, label) and variances."""
    values, cells = analysis.log1p(analysis.normalize_total(counts, target_sum)), counts.select("barcode").distinct()
    hvg = analysis.variable_genes(analysis.gene_stats(values, cells.count()), min_mean, max_mean, min_disp)
    return {"hvg": hvg} | embed(analysis.subset_genes(values, hvg), cells, n_pcs, n_neighbors, resolution)


def embed(values: DataFrame, cells: DataFrame, n_pcs: int = 50, n_neighbors: int = 15, resolution: float = 1.0, exact_cells: int = 20_000, communities: str = "labels") -> dict[str, DataFrame]:
    """Normalised values of the chosen genes to cells, pca, neighbours, clusters and variances: scale, PCA, kNN, labels. Beyond exact_cells cells, neighbours come from a forest.

    communities: "labels" by label propagation, "leiden" by modularity over neighbours in either direction.
    """
    spark = values.sparkSession
    scaled = analysis.scaled_cells(values, cells)
    n_cells, n_genes = scaled.rows.count(), len(scaled.zeros)
    scores, variances = analysis.pca_scaled(scaled, max(1, min(n_pcs, n_genes - 1, n_cells - 1)))
    scores = graph.checkpointed(scores)
    points, k = scores.withColumnRenamed("scores", "coords"), max(1, min(n_neighbors, n_cells - 1))
    neighbours = graph.checkpointed(analysis.knn(points, k) if n_cells <= exact_cells else knn_forest(points, k))
    if communities == "leiden":
        tied = analysis.connectivity(neighbours).where("src < dst").withColumn("w", F.lit(1.0))
        labels = leiden(scores.select("node"), tied, resolution)
    else:
        labels = graph.label_propagation(spark, scores.select("node"), neighbours.select("src", "dst", "dist"), resolution).drop("settled")
    return {"cells": scaled.rows.select("node", "barcode"), "pca": scores, "neighbours": neighbours, "clusters": labels, "variances": spark.createDataFrame(list(enumerate(variances)), "component int, variance double")}


def filtered_analysis(counts: DataFrame, min_genes: int = 200, max_genes: int = 10000, max_mito: float = 20.0, n_top_genes: int = 2000, target_sum: float = 10000.0, n_pcs: int = 50, n_neighbors: int = 15, resolution: float = 1.0) -> dict[str, DataFrame]:
    """Cells and genes filtered, all genes normalised once, the most variable ones embedded, Leiden communities, markers of the clusters over all genes."""
    good = qc.filter_cells(qc.cell_metrics(counts), min_genes, max_genes, max_mito)
    kept = graph.checkpointed(qc.filter_genes(counts.join(good.select("barcode"), "barcode", "left_semi")))
    values, cells = analysis.log1p(analysis.normalize_total(kept, target_sum)), kept.select("barcode").distinct()
    top = analysis.top_genes(analysis.gene_stats(values, cells.count()), n_top_genes)
    out = {"hvg": top} | embed(values.join(top.select("gene"), "gene", "left_semi"), cells, n_pcs, n_neighbors, resolution, communities="leiden")
    clusters = out["clusters"].join(out["cells"], "node").select("barcode", F.col("label").alias("cluster"))
    return out | {"markers": analysis.markers(values, clusters)}


def cluster_all_genes(counts: DataFrame, n_neighbors: int = 15, exact_cells: int = 20_000) -> DataFrame:
    """(barcode, label): clusters of the cells by their normalised logarithms of all genes, without scaling or PCA."""
    values = analysis.log1p(analysis.normalize_total(counts))
    cells = analysis.plain_cells(values, counts.select("barcode").distinct())
    points, n = graph.checkpointed(analysis.vectors_of(cells)), cells.rows.count()
    k = max(1, min(n_neighbors, n - 1))
    near = graph.checkpointed(analysis.knn(points, k) if n <= exact_cells else knn_forest(points, k))
    labels = graph.label_propagation(counts.sparkSession, points.select("node"), near.select("src", "dst", "dist"))
    return labels.join(cells.rows.select("node", "barcode"), "node").select("barcode", "label")


def shard_counts(reads_in: DataFrame, whitelist: DataFrame, shards: int, index: int, protocol: str = "10x-3prime-v3") -> DataFrame:
    """One worker's part: (gene, barcode, n) of its records, with the UMI in the place of the gene, as the sharded count has it."""
    found = extract(reads.shard(reads_in, shards, index), whitelist, protocol).where("cell is not null")
    return matrix.count(found.select(F.col("umi").alias("gene"), F.col("cell").alias("barcode")))


STAGES = ("extract", "count", "analysis")


def validate(dataset: dict[str, DataFrame], max_mismatch: int = 1, stages: tuple = STAGES, n_neighbors: int = 15) -> dict[str, DataFrame]:
    """Scores of the stages asked for on a sample with known truth, and whether each passes; the report has the time and the duration."""
    began, judged, out = time.monotonic(), [], {}
    truth = dataset["truth_counts"]
    found = extract(dataset["r1"], dataset["truth_cells"].select("barcode"), "10x-3prime-v3", max_mismatch)
    if "extract" in stages:
        out["extraction"] = validation.extraction_confusion(found.where("barcode is not null"), dataset["truth_cells"], dataset["mutated"], dataset["invalid"])
        judged.append(("extract", out["extraction"], "f1", validation.F1_AT_LEAST))
    if "count" in stages:
        genes = dataset["r2"].select("rec_no", reads.gene_of_read_id("id").alias("gene"))
        observed = matrix.count(found.where("cell is not null").join(genes, "rec_no").where("gene is not null").select("gene", F.col("cell").alias("barcode")))
        out["counting"] = validation.sparse_correlation(truth, observed)
        judged.append(("count", out["counting"], "pearson", validation.PEARSON_AT_LEAST))
    if "analysis" in stages:
        labelled = cluster_all_genes(truth.where("n > 0"), n_neighbors).join(dataset["truth_cells"], "barcode")
        out["clustering"] = validation.clustering_scores(labelled, "cell_type", "label")
        judged.append(("analysis", out["clustering"], "ari", validation.ARI_AT_LEAST))
    if not judged:
        raise ValueError(f"no stage to run; there are {', '.join(STAGES)}")
    stage = lambda name, df, c, least: df.select(F.lit(name).alias("stage"), F.col(c).alias("score"), F.lit(least).alias("threshold"))
    report = graph.checkpointed(validation.pass_fail(reduce(DataFrame.unionByName, [stage(*j) for j in judged])))
    return out | {"report": validation.stamped(report, time.monotonic() - began)}


def batch(samples: DataFrame, whitelist: DataFrame, protocol: str = "10x-3prime-v3", max_mismatch: int = 1) -> DataFrame:
    """Counters of each sample: reads with a sample column are one job."""
    found = extract(samples, whitelist, protocol, max_mismatch)
    return found.groupBy("sample").agg(F.count(F.lit(1)).alias("total_reads"), F.count_if(F.col("cell").isNotNull()).alias("valid_reads"), F.count_distinct("cell").alias("n_cells"))


def run_sample(spark: SparkSession, r1: str, whitelist: str, output: str, r2: str | None = None, bam: str | None = None, protocol: str = "10x-3prime-v3", sample: str = "sample", max_mismatch: int = 1, min_barcode_qual: int = 10, min_mapq: int = 30, force_cells: int | None = None) -> DataFrame:
    """Files to a matrix folder and a report in output: extract, count, quality. Returns the report's row.

    Genes come from the alignments of bam (cell, UMI and gene tags; mapping itself is left to an aligner),
    else from the ids of the reads of r2. force_cells keeps the cells with the most counts.
    """
    schemas.check_settings(protocol=protocol, max_mismatch=max_mismatch)
    found = extract(sources.read_fastq(spark, r1), sources.read_whitelist(spark, whitelist), protocol, max_mismatch, min_barcode_qual)
    counters = graph.checkpointed(reads.extraction_counters(found))
    if bam:
        alignments = sources.read_bam(spark, bam, min_mapq)
        counts = count_reads(alignments, min_mapq)
        assigned = reads.count_counters(sources.read_bam(spark, bam), min_mapq)
    else:
        if not r2:
            raise ValueError("give alignments or the second reads")
        genes = sources.read_fastq(spark, r2).select("rec_no", reads.gene_of_read_id("id").alias("gene"))
        kept = found.where("cell is not null").join(genes, "rec_no").where("gene is not null")
        counts = umis.distinct_umis(kept).select("gene", F.col("cell").alias("barcode"), F.col("n_umis").alias("n"))
        assigned = kept.agg(F.count(F.lit(1)).alias("assigned_reads"))
    counts = graph.checkpointed(counts)
    if force_cells is not None:
        best = qc.knee(matrix.counts_per_cell(counts)).where(F.col("rank") <= force_cells)
        counts = counts.join(best.select("barcode"), "barcode", "left_semi")
    sinks.write_matrix(counts, f"{output}/matrix")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unique_umis"))
    totals = counters.select("total_reads", F.col("valid_barcodes").alias("valid_reads")).crossJoin(F.broadcast(assigned.select("assigned_reads"))).crossJoin(F.broadcast(total))  # one row each
    report = graph.checkpointed(sample_qc(counts, sample, totals.withColumn("mapped_reads", F.col("assigned_reads"))))
    sinks.write_report(report, f"{output}/qc_report.json")
    return report


def run_manifest(spark: SparkSession, manifest: str, output: str, max_mismatch: int = 1, parallel_samples: int = 4) -> DataFrame:
    """(sample, status, error) of each sample of a manifest: its own files, whitelist and protocol.

    So many samples run side by side, each as a job group of its own name in a scheduler pool of its
    own (pools share the cores where spark.scheduler.mode is FAIR). A sample that fails is reported,
    what it left running is cancelled, and the others go on.
    """
    context = spark.sparkContext

    def run(row) -> tuple[str, str, str | None]:
        sample = row["sample_name"]
        group = f"sample {sample} {uuid.uuid4().hex}"
        context.setJobGroup(group, f"sample {sample}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", group)
        try:
            settings = {"protocol": row["protocol"]} if row["protocol"] else {}
            run_sample(spark, row["r1"], row["whitelist"], f"{output}/{sample}", r2=row["r2"], sample=sample, max_mismatch=max_mismatch, **settings)
            return sample, "ok", None
        except Exception as e:  # noqa: BLE001 - whatever a sample's files cause must not stop the others
            context.cancelJobGroup(group)
            return sample, "failed", " ".join(str(e).split())[:500]
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    rows = sources.read_manifest(spark, manifest).collect()  # a manifest names files, a few rows
    with ThreadPoolExecutor(max(1, parallel_samples)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(run), row) for row in rows]
        results = [job.result() for job in jobs]
    return spark.createDataFrame(results, "sample string, status string, error string")


def batch_each(samples: DataFrame, whitelists: DataFrame, max_mismatch: int = 1) -> DataFrame:
    """Counters of samples that have a layout and a whitelist each, as one job over one scan: samples (sample, protocol, seq, qual), whitelists (sample, barcode).

    An unknown protocol counts as the default one; a sample without a whitelist has no valid reads.
    """
    chosen = {name: schemas.protocol_or_default(name) for name in schemas.PROTOCOLS}
    barcode = reads.components(schemas.protocol_or_default(None))["barcode"]
    for name, layout in chosen.items():
        barcode = F.when(F.col("protocol") == name, reads.components(layout)["barcode"]).otherwise(barcode)
    found = barcodes.correct_reads(samples.select("sample", barcode.alias("barcode")), whitelists, max_mismatch, ("sample",))
    return found.groupBy("sample").agg(F.count(F.lit(1)).alias("total_reads"), F.count("cell").alias("valid_reads"), F.count_distinct("cell").alias("n_cells"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: how many samples succeeded and failed, by their status."""
    return results.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed"))


def compare_samples(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Results of the completed samples asked for."""
    return results.where(F.col("status") == "completed").join(wanted, "sample", "left_semi")


def whole_report(spark: SparkSession, counts: DataFrame, sample: str) -> DataFrame:
    return qc.report(sample_qc(counts, sample), sample)
