"""Writers of FASTQ, Matrix Market folders, tables and reports; BAM has a module of its own."""

import gzip
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import matrix
from helixframe.sinks.bam import write_bam

__all__ = ["write_bam"]


def write_fastq(reads: DataFrame, folder: str, compress: bool = True) -> None:
    """Text parts of four lines a record; gzip if compress."""
    lines = reads.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))
    lines.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(folder)


def matrix_lines(counts: DataFrame) -> DataFrame:
    """(line): the entries of a Matrix Market file, 1-based."""
    return matrix.coo(counts).select(F.concat_ws(" ", F.col("gene_idx") + 1, F.col("cell_idx") + 1, "n").alias("line"))


def joined_file(lines: DataFrame, order: list[str], path: str, head: str, compress: bool) -> None:
    """One file of the column line in the order given: tasks write the parts, ordered by range, and the file system's streams put them together.

    The driver copies bytes and parses none; gzip members may follow one another, so compressed parts need no unpacking.
    """
    spark = lines.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.option("compression", "gzip" if compress else "none").text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    where, target = hadoop.fs.Path(parts), hadoop.fs.Path(f"{path}.gz" if compress else path)
    files = where.getFileSystem(conf)
    found = sorted(str(s.getPath()) for s in files.listStatus(where) if s.getPath().getName().startswith("part-"))
    out = files.create(target, True)
    try:
        out.write(bytearray(gzip.compress(head.encode()) if compress else head.encode()))
        for part in found:
            stream = files.open(hadoop.fs.Path(part))
            hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            stream.close()
    finally:
        out.close()
    files.delete(where, True)


def write_matrix(counts: DataFrame, folder: str, compress: bool = False) -> None:
    """matrix.mtx, barcodes.tsv and genes.tsv in one folder, in the order of (cell, gene): the format asks for single files."""
    sizes = matrix.dims(counts).first()
    head = f"%%MatrixMarket matrix coordinate integer general\n%\n{sizes['n_genes']} {sizes['n_cells']} {sizes['nnz']}\n"
    entries = matrix.coo(counts).withColumn("line", F.concat_ws(" ", F.col("gene_idx") + 1, F.col("cell_idx") + 1, "n"))
    joined_file(entries, ["cell_idx", "gene_idx"], f"{folder}/matrix.mtx", head, compress)
    joined_file(matrix.cells(counts).withColumn("line", F.col("barcode")), ["cell_idx"], f"{folder}/barcodes.tsv", "", compress)
    joined_file(matrix.genes(counts).withColumn("line", F.concat_ws("\t", "gene", "gene")), ["gene_idx"], f"{folder}/genes.tsv", "", compress)


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name: the engine's own form of an annotated matrix."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_tsv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(folder)


def write_analysis(result: dict[str, DataFrame], folder: str) -> None:
    """clusters, pca (6 decimals), hvg as tab-separated tables, and a summary."""
    named = result["clusters"].join(result["cells"], "node")
    write_tsv(named.select("barcode", "label"), f"{folder}/clusters")
    scores = result["pca"].join(result["cells"], "node").select("barcode", F.array_join(F.transform("scores", lambda x: F.format_string("%.6f", x)), "\t").alias("scores"))
    write_tsv(scores, f"{folder}/pca")
    write_tsv(result["hvg"], f"{folder}/hvg")
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("cells"))
    sizes.agg(F.count(F.lit(1)).alias("clusters"), F.sum("cells").alias("cells")).write.mode("overwrite").json(f"{folder}/analysis_summary")


def write_report(row: DataFrame, path: str) -> None:
    """One row of metrics as an indented JSON file."""
    Path(path).write_text(json.dumps(json.loads(row.select(F.to_json(F.struct(*row.columns))).first()[0]), indent=2))


def report_text(report: DataFrame) -> str:
    """The stages of a validation report, a line each."""
    mark = {True: "PASS", False: "FAIL", None: "not run"}
    return "\n".join(f"{r['stage']:<10} {'' if r['score'] is None else format(r['score'], '.4f'):>8} {mark[r['passed']]}" for r in report.collect())
