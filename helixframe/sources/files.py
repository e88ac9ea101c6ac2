"""Matrix Market, whitelists, manifests and checks of files; FASTQ and BAM have modules of their own.

register(spark) makes format("fastq") and format("bam") known. Paths may be local or URIs.
"""

import gzip
import io
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources import bam
from helixframe.sources.bam import bam_references, read_bam
from helixframe.sources.fastq import FastqSource, read_fastq
from helixframe.sources.splits import kind_of, located, paths_of

__all__ = ["bam_references", "read_bam", "read_fastq"]


def opened(path: str):
    """A binary stream of a plain, gzip or zstd file, by its first bytes."""
    system, where = located(path)
    raw, kind = system.open_input_file(where), kind_of(path)
    if kind == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    return io.BufferedReader(raw) if kind == "plain" else gzip.GzipFile(fileobj=raw)


def register(spark: SparkSession) -> None:
    bam.register(spark)
    spark.dataSource.register(FastqSource)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one text file, from 1; the file is one partition, so numbers follow its lines."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("at", "value")).select((F.col("at") + 1).cast("long").alias("line_no"), "value")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(barcode): trimmed, without blank and # lines, distinct; fails when lengths differ."""
    from helixframe.operators.barcodes import check_lengths

    return check_lengths(whitelist_lines(spark.read.text(path)))


def whitelist_lines(lines: DataFrame) -> DataFrame:
    """(barcode) of a file's lines (value)."""
    trimmed = lines.select(F.trim("value").alias("barcode"))
    return trimmed.where((F.col("barcode") != "") & ~F.col("barcode").startswith("#")).distinct()


def whitelist_of(spark: SparkSession, barcodes: list[str]) -> DataFrame:
    """(barcode) of a list as it is: no trimming, no comments; empty is legal."""
    from helixframe.operators.barcodes import check_lengths

    return check_lengths(spark.createDataFrame([(b,) for b in barcodes], "barcode string").distinct())


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, row, col, value), 1-based as in the file; the first line without % is the header; lines that do not parse are skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("value"))
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("%"))
    head = rows.agg(F.min("line_no").alias("head"))
    parsed = rows.crossJoin(F.broadcast(head)).where("line_no > head").select("line_no", *[F.expr(f"try_cast(get(split(value, '\\\\s+'), {i}) as {t})").alias(n) for i, (n, t) in enumerate((("row", "long"), ("col", "long"), ("value", "double")))])  # head is one row
    return parsed.dropna()


def read_matrix(spark: SparkSession, folder: str, repeated: str = "sum") -> dict[str, DataFrame]:
    """counts (gene, barcode, n), genes and cells (line_no, name) of a matrix folder, plain or gzipped.

    repeated: how repeated entries count, "sum" or "last".
    """
    from helixframe.operators.matrix import add, last_wins, named

    def first(*names: str) -> str:
        for n in names:
            for p in (Path(folder) / n, Path(folder) / f"{n}.gz"):
                if p.exists():
                    return str(p)
        raise FileNotFoundError(f"{folder} has none of {', '.join(names)}")

    lines = lambda p: numbered_lines(spark, p).select("line_no", F.split("value", "\t")[0].alias("name"))
    genes, cells = lines(first("genes.tsv", "features.tsv")), lines(first("barcodes.tsv"))
    entries = named(read_mtx(spark, first("matrix.mtx")), genes, cells)
    counts = last_wins(entries) if repeated == "last" else add(entries.drop("line_no"))
    return {"counts": counts.withColumn("n", F.col("n").cast("long")), "genes": genes, "cells": cells}


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that sinks.files.write_bundle() wrote, by name."""
    system, where = located(folder)
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(where)) if f.type == fs.FileType.Directory)
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample_name, r1, r2, whitelist, protocol) of a CSV file with a header; the name column may be called name."""
    raw = spark.read.option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    have = {c.strip().lower(): c for c in raw.columns}
    name = F.coalesce(*[F.col(have[c]) for c in ("sample_name", "name") if c in have])
    rest = [(F.col(have[c]) if c in have else F.lit(None).cast("string")).alias(c) for c in ("r1", "r2", "whitelist", "protocol")]
    return raw.select(name.alias("sample_name"), *rest)


def looks_like_fastq(path: str) -> bool:
    """Compressed files pass; else the first record must have its four lines."""
    if kind_of(path) != "plain":
        return True
    with opened(path) as f:
        name, seq, plus, qual = (f.readline().rstrip(b"\r\n") for _ in range(4))
    return name[:1] == b"@" and plus[:1] == b"+" and len(seq) == len(qual) > 0


def looks_like_alignments(path: str) -> bool:
    """BAM, compressed or not, or SAM text; of a folder, its first BAM file."""
    try:
        first = paths_of({"path": path}, (".bam",))[0]
    except (FileNotFoundError, IndexError):
        return False
    with opened(first) as f:
        head = f.read(4)
    return head == b"BAM\x01" or head[:1] == b"@"
