"""Synthetic samples with known truth, from a seed: cells, counts, mutated and invalid barcodes, reads.

Everything follows from hashes of (seed, key), so the rows do not depend on how the data are dealt out.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.operators.graph import numbered

HEX, DNA = "0123456789abcdef", "ACGTACGTACGTACGT"
CELL_NAME, GENE_NAME = "CellType_%d", "GENE_%04d"


@dataclass(frozen=True)
class SyntheticConfig:
    n_cells: int = 500
    n_genes: int = 200
    n_cell_types: int = 5
    markers_per_type: int = 10
    marker_fold: float = 8.0
    base_mean: float = 2.0
    mutation_rate: float = 0.1
    invalid_rate: float = 0.05
    barcode_len: int = 16
    umi_len: int = 12
    cdna_len: int = 100
    seed: int = 42

    def __post_init__(self):
        if min(self.n_cells, self.n_genes, self.n_cell_types) < 1 or not 0 <= self.mutation_rate <= 1 or not 0 <= self.invalid_rate <= 1:
            raise ValueError("sizes must be positive, rates between 0 and 1")
        if self.barcode_len > 32 or self.umi_len > 32:
            raise ValueError("barcodes and UMIs have at most 32 bases")


def dna(length: int, *parts) -> Column:
    """length bases that follow from the parts."""
    blocks = [F.translate(F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in (*parts, i)])), HEX, DNA) for i in range(-(-length // 32))]
    return F.substring(F.concat(*blocks), 1, length)


def uniform(*parts) -> Column:
    """A number in [0, 1) that follows from the parts."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 40)) / float(1 << 40)


#: Means from which on a Poisson number is a rounded normal one.
LARGE_MEAN = 500.0


@F.pandas_udf(T.LongType())
def poisson(mean: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
    """A Poisson number for each mean by inversion at u in [0, 1), whole batches at once; large means take a normal number of u and v."""
    m, at = mean.to_numpy(dtype=float), u.to_numpy(dtype=float)
    out, small = np.zeros(len(m), dtype=np.int64), m < LARGE_MEAN
    normal = np.sqrt(-2 * np.log1p(-at)) * np.cos(2 * np.pi * v.to_numpy(dtype=float))
    out[~small] = np.maximum(0, np.rint(m[~small] + np.sqrt(m[~small]) * normal[~small]))
    p = np.exp(-np.where(small, m, 0.0))
    below, left = p.copy(), small & (at > p)
    while left.any():
        out[left] += 1
        p[left] *= m[left] / out[left]
        below[left] += p[left]
        left &= (at > below) & ((p > 1e-18) | (out < m))
    return pd.Series(out)


def generate(spark: SparkSession, config: SyntheticConfig = SyntheticConfig()) -> dict[str, DataFrame]:
    """truth_cells, profiles, truth_counts, mutated, invalid, r1 and r2.

    R1 reads have barcode and UMI, R2 reads cDNA; record numbers pair them, ids end in the gene.
    Mutated barcodes give a read for each of the first three genes that their cell has, invalid ones a read without a gene.
    """
    c, seed = config, config.seed
    drawn = spark.range(2 * c.n_cells + 16).select("id", dna(c.barcode_len, seed, "cell", F.col("id")).alias("barcode"))
    cells = drawn.groupBy("barcode").agg(F.min("id").alias("id")).orderBy("id").limit(c.n_cells)
    cells = cells.select((F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("cell_idx"), "barcode")
    cells = cells.withColumn("type", F.col("cell_idx") % c.n_cell_types).withColumn("cell_type", F.format_string(CELL_NAME, "type"))
    genes = spark.range(c.n_genes).select(F.col("id").cast("int").alias("gene_idx"), F.format_string(GENE_NAME, "id").alias("gene"))
    types = spark.range(c.n_cell_types).select(F.col("id").cast("int").alias("type"))
    marker = (F.col("gene_idx") >= F.col("type") * c.markers_per_type) & (F.col("gene_idx") < (F.col("type") + 1) * c.markers_per_type)
    noise = 0.7 + 0.6 * uniform(seed, "noise", F.col("type"), F.col("gene_idx"))
    mean = F.greatest(F.lit(0.1), F.lit(c.base_mean) * F.when(marker, c.marker_fold).otherwise(1.0) * noise)
    profiles = types.crossJoin(genes).select("type", "gene_idx", "gene", mean.alias("mean"))  # the table asked for: types x genes
    drawn_at = [uniform(seed, name, F.col("cell_idx"), F.col("gene_idx")) for name in ("count", "spread")]
    counts = cells.join(profiles.where("mean >= 0.01"), "type").select("barcode", "gene", "cell_idx", "gene_idx", poisson("mean", *drawn_at).alias("n")).where("n > 0")

    place = (F.floor(uniform(seed, "place", F.col("cell_idx")) * c.barcode_len) + 1).cast("int")
    old = F.substring("barcode", place, F.lit(1))
    new = F.element_at(F.filter(F.split(F.lit("ACGT"), ""), lambda b: b != old), (F.floor(uniform(seed, "base", F.col("cell_idx")) * 3) + 1).cast("int"))
    changed = F.concat(F.substring("barcode", F.lit(1), place - 1), new, F.substring("barcode", place + 1, F.lit(c.barcode_len)))
    mutated = cells.where(F.col("cell_idx") < int(c.n_cells * c.mutation_rate)).select("cell_idx", F.col("barcode").alias("original"), changed.alias("mutated"), F.lit(1).alias("dist"))

    bad = spark.range(int(c.n_cells * c.invalid_rate)).select("id", dna(c.barcode_len, seed, "invalid", F.col("id")).alias("b"))
    with_n = F.array_join(F.transform(F.split("b", ""), lambda x, i: F.when(uniform(seed, "n", F.col("id"), i) < 0.3, "N").otherwise(x)), "")
    invalid = bad.select("id", with_n.alias("barcode")).join(cells.select("barcode"), "barcode", "left_anti")

    good = counts.select("barcode", "gene", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    first = F.row_number().over(Window.partitionBy("cell_idx").orderBy("gene_idx"))
    of_mutated = counts.withColumn("k", first).where("k <= 3").join(mutated, "cell_idx").select(F.col("mutated").alias("barcode"), "gene", F.lit(0).alias("copy"))
    of_invalid = invalid.select("barcode", F.lit("NONE").alias("gene"), F.lit(-1).alias("copy"))
    rows = good.unionByName(of_mutated).unionByName(of_invalid)
    in_order = numbered(rows, ["barcode", "gene", "copy"], "rec_no")
    name = F.format_string("READ_%08d:%s:%s", "rec_no", "barcode", "gene")
    r1_seq = F.concat("barcode", dna(c.umi_len, seed, "umi", F.col("barcode"), F.col("gene"), F.col("copy")))
    quality = lambda n: F.repeat(F.lit("I"), F.lit(n))
    r1 = in_order.select("rec_no", name.alias("id"), r1_seq.alias("seq"), quality(c.barcode_len + c.umi_len).alias("qual"))
    r2 = in_order.select("rec_no", name.alias("id"), dna(c.cdna_len, seed, "cdna", F.col("rec_no")).alias("seq"), quality(c.cdna_len).alias("qual"))
    return {
        "truth_cells": cells.select("barcode", "cell_type"),
        "profiles": profiles.select("type", "gene", "mean"),
        "truth_counts": counts.select("gene", "barcode", "n"),
        "mutated": mutated.select("original", "mutated", "dist"),
        "invalid": invalid.select("barcode"),
        "r1": r1,
        "r2": r2,
    }
