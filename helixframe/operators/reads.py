"""From reads to barcodes and UMIs: extraction, filters, counters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import gene_of_read_id, mean_quality, quality_ok, subsequence
from helixframe.schemas import Protocol, protocol

COMPONENTS = ("barcode", "umi", "cdna", "barcode_qual", "umi_qual", "cdna_qual")


def components(layout: Protocol, seq="seq", qual="qual", sample: str = "sample") -> dict[str, Column]:
    """The six parts of a read; all null where the read is too short for the protocol."""
    seq, qual = F.col(seq), F.col(qual)
    if layout.whole_read:
        return {"barcode": F.lit(sample), "umi": F.lit(""), "cdna": seq, "barcode_qual": F.repeat(F.lit("I"), F.lit(len(sample))), "umi_qual": F.lit(""), "cdna_qual": qual}
    after = max(layout.barcode_start + layout.barcode_len, layout.umi_start + layout.umi_len)
    long_enough = F.length(seq) >= max(layout.min_length, after)
    rest = lambda c: F.substring(c, F.lit(after + 1), F.length(c))
    parts = {
        "barcode": subsequence(seq, layout.barcode_start, layout.barcode_len),
        "umi": subsequence(seq, layout.umi_start, layout.umi_len),
        "cdna": rest(seq),
        "barcode_qual": subsequence(qual, layout.barcode_start, layout.barcode_len),
        "umi_qual": subsequence(qual, layout.umi_start, layout.umi_len),
        "cdna_qual": rest(qual),
    }
    return {name: F.when(long_enough, part) for name, part in parts.items()}


def extract(reads: DataFrame, layout: str | Protocol = "10x-3prime-v3", sample: str = "sample") -> DataFrame:
    """Adds the parts of each read, by a protocol's name or a layout of one's own. Too short reads stay, with nulls."""
    return reads.withColumns(components(layout if isinstance(layout, Protocol) else protocol(layout), sample=sample))


def extract_each(reads: DataFrame, layouts: list[Protocol]) -> DataFrame:
    """Each read by each layout that it is long enough for, with the layout's name as protocol; the reads are read once."""
    parts = [F.struct(F.lit(p.name).alias("protocol"), *[c.alias(name) for name, c in components(p).items()]) for p in layouts]
    each = reads.select(*reads.columns, F.explode(F.array(*parts)).alias("__parts"))
    return each.select(*reads.columns, "__parts.*").where(F.col("cdna").isNotNull())


def map_records(reads: DataFrame, function, schema: str) -> DataFrame:
    """Any function over records: it gets an iterator of Arrow batches and yields batches of the schema; partitions run in parallel."""
    return reads.mapInArrow(function, schema)


def long_enough(reads: DataFrame, protocol_name: str) -> DataFrame:
    return reads.where(F.length("seq") >= protocol(protocol_name).min_length)


def good_barcode(extracted: DataFrame, min_qual: int = 10) -> DataFrame:
    return extracted.where(quality_ok("barcode_qual", min_qual))


def good_umi(extracted: DataFrame, min_qual: int = 10) -> DataFrame:
    return extracted.where(quality_ok("umi_qual", min_qual))


def mapped(alignments: DataFrame, min_mapq: int = 30) -> DataFrame:
    return alignments.where(F.col("is_mapped") & (F.col("mapq") >= min_mapq))


def tagged(alignments: DataFrame) -> DataFrame:
    """Alignments with both a cell barcode and a UMI."""
    return alignments.where(F.col("cell_barcode").isNotNull() & F.col("umi").isNotNull())


def with_gene(alignments: DataFrame) -> DataFrame:
    """Adds gene: the name, else the id."""
    return alignments.withColumn("gene", F.coalesce("gene_name", "gene_id"))


def gene_from_id(reads: DataFrame, id_col: str = "id") -> DataFrame:
    return reads.withColumn("gene", gene_of_read_id(id_col))


def with_quality(reads: DataFrame) -> DataFrame:
    return reads.withColumn("mean_quality", mean_quality("qual"))


def shard(reads: DataFrame, shards: int, index: int) -> DataFrame:
    """Every shards-th record; the shards together are the input, once."""
    return reads.where(F.pmod("rec_no", F.lit(shards)) == index)


def extraction_counters(matched: DataFrame) -> DataFrame:
    """One row: total, valid and corrected reads and their percentages, from a status column (null: dropped before matching)."""
    rows = matched.agg(
        F.count(F.lit(1)).alias("total_reads"),
        F.count_if(F.coalesce(F.col("status").isin("exact", "corrected"), F.lit(False))).alias("valid_barcodes"),
        F.count_if(F.coalesce(F.col("status") == "corrected", F.lit(False))).alias("corrected_barcodes"),
    )
    percent = lambda c: F.round(100.0 * F.col(c) / F.greatest("total_reads", F.lit(1)), 6)
    return rows.withColumn("valid_percent", percent("valid_barcodes")).withColumn("corrected_percent", percent("corrected_barcodes"))


def count_counters(alignments: DataFrame, min_mapq: int = 30) -> DataFrame:
    """One row: alignments in all, and those that count: mapped well, with a cell and a gene."""
    gene = F.coalesce("gene_name", "gene_id")
    assigned = F.col("is_mapped") & (F.col("mapq") >= min_mapq) & F.col("cell_barcode").isNotNull() & gene.isNotNull()
    rows = alignments.agg(F.count(F.lit(1)).alias("total_reads"), F.count_if(F.coalesce(assigned, F.lit(False))).alias("assigned_reads"))
    return rows.withColumn("assigned_percent", F.round(100.0 * F.col("assigned_reads") / F.greatest("total_reads", F.lit(1)), 6))


def pair(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """R1 and R2 by record number; fails when one has records that the other lacks."""
    a = r1.select("rec_no", *[F.col(c).alias(f"r1_{c}") for c in ("id", "seq", "qual")])
    b = r2.select(F.col("rec_no").alias("rec_no_2"), *[F.col(c).alias(f"r2_{c}") for c in ("id", "seq", "qual")])
    both = a.join(b, F.col("rec_no") == F.col("rec_no_2"), "full_outer")
    uneven = F.col("rec_no").isNull() | F.col("rec_no_2").isNull()
    checked = F.when(uneven, F.raise_error(F.lit("the two files have different numbers of records")).cast("long")).otherwise(F.col("rec_no"))
    return both.withColumn("rec_no", checked).drop("rec_no_2")
