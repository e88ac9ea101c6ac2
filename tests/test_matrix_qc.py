import json
import math

from helixframe.operators import matrix, qc
from pyspark.sql import functions as F

ROWS = [("GENE1", "CELL1", 10), ("GENE2", "CELL1", 3), ("GENE3", "CELL1", 2), ("GENE1", "CELL2", 5), ("GENE2", "CELL2", 8), ("GENE3", "CELL2", 7)]


def counts(spark, rows=ROWS):
    return spark.createDataFrame(rows, "gene string, barcode string, n long")


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_totals(spark):
    c = counts(spark, [("g1", "a", 10), ("g1", "b", 5), ("g2", "a", 3), ("g2", "b", 8), ("g3", "b", 2)])
    assert pairs(matrix.counts_per_cell(c)) == {"a": 13, "b": 15}
    assert pairs(matrix.counts_per_gene(c)) == {"g1": 15, "g2": 11, "g3": 2}
    assert pairs(matrix.genes_per_cell(c)) == {"a": 2, "b": 3}
    assert pairs(matrix.cells_per_gene(c)) == {"g1": 2, "g2": 2, "g3": 1}


def test_cells_without_entries_count(spark):
    known = spark.createDataFrame([("CELL1",), ("CELL9",)], "barcode string")
    assert pairs(matrix.counts_per_cell(counts(spark), known)) == {"CELL1": 15, "CELL9": 0}


def test_csr_and_dense(spark):
    c = counts(spark)
    rows = matrix.csr(matrix.coo(c), matrix.genes(c)).orderBy("gene_idx").collect()
    assert [r["start"] for r in rows] == [0, 2, 4] and rows[0]["values"] == [10, 5]
    grid = matrix.dense(c.where("n > 5"), c, c)
    assert grid.count() == 6 and grid.where("n = 0").count() == 3


def test_merge_adds_and_last_wins(spark):
    c = counts(spark, [("g", "a", 5)])
    assert matrix.merge([c, counts(spark, [("g", "a", 3)])]).first()["n"] == 8
    lines = spark.createDataFrame([("g", "a", 5, 1), ("g", "a", 3, 2)], "gene string, barcode string, n long, line_no long")
    assert matrix.last_wins(lines).first()["n"] == 3


def test_upper_median(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v long")
    assert rows.agg(qc.upper_median("v")).first()[0] == 3
    assert rows.where("v < 0").agg(qc.upper_median("v")).first()[0] == 0


def test_rates_and_warnings(spark):
    totals = spark.createDataFrame([(1000, 900, 800, 700, 350)], "total_reads long, valid_reads long, mapped_reads long, assigned_reads long, unique_umis long")
    row = qc.warnings_of(qc.rates(totals).withColumn("median_genes", F.lit(100))).first()
    assert row["barcode_validity"] == 0.9 and row["assignment_rate"] == 0.875 and row["saturation"] == 0.5
    assert math.isclose(row["mapping_rate"], 0.888889) and row["warnings"] == ["low median genes per cell"]
    empty = qc.rates(totals.select(*[F.lit(0).alias(c) for c in totals.columns])).first()
    assert empty["mapping_rate"] == 0 and empty["saturation"] == 0


def test_cell_filters_and_bounds(spark):
    cells = spark.createDataFrame([("a", 200, 0.0), ("b", 10000, 0.0), ("c", 300, 20.0)], "barcode string, n_genes long, mito_percent double")
    assert [r[0] for r in qc.filter_cells(cells).collect()] == ["a"]
    assert cells.where(qc.passing(cells)).count() == 3


def test_mito_and_knee(spark):
    c = counts(spark, [("MT-1", "a", 1), ("g", "a", 3), ("g", "b", 4)])
    cells = qc.cell_metrics(c)
    assert {r["barcode"]: r["mito_percent"] for r in cells.collect()} == {"a": 25.0, "b": 0.0}
    assert {r["barcode"]: r["rank"] for r in qc.knee(cells).collect()} == {"a": 1, "b": 2}


def test_report_is_json(spark):
    assert json.loads(qc.report(spark.createDataFrame([(1,)], "x long"), "s").first()["report"]) == {"x": 1}
