"""Count matrices as a long table (gene, barcode, n) with dimensions of genes and cells."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import checkpointed, numbered, running_total


def count(rows: DataFrame) -> DataFrame:
    """Rows of (gene, barcode) summed up."""
    return rows.groupBy("gene", "barcode").agg(F.count(F.lit(1)).alias("n"))


def add(counts: DataFrame) -> DataFrame:
    """Sums of repeated entries."""
    return counts.groupBy("gene", "barcode").agg(F.sum("n").alias("n"))


def merge(parts: list[DataFrame | None]) -> DataFrame:
    """Sum of the matrices of several shards; those that are missing (None) are left out, at least one must be there."""
    parts = [p for p in parts if p is not None]
    if not parts:
        raise ValueError("there is nothing to merge")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return add(union)


def last_wins(entries: DataFrame) -> DataFrame:
    """Of repeated entries the one on the last line stays."""
    return entries.groupBy("gene", "barcode").agg(F.max_by("n", "line_no").alias("n"))


def indexed(names: DataFrame, name: str, index: str) -> DataFrame:
    """(name, index) numbered from 0 in sorted order, by ranges, so that no task orders all names."""
    return numbered(names.select(name).distinct(), [name], index)


def genes(counts: DataFrame) -> DataFrame:
    return indexed(counts, "gene", "gene_idx")


def cells(counts: DataFrame) -> DataFrame:
    return indexed(counts, "barcode", "cell_idx")


def coo(counts: DataFrame) -> DataFrame:
    """(gene_idx, cell_idx, n); counts is written first, as both numberings and the join read it."""
    counts = checkpointed(counts)
    return counts.join(genes(counts), "gene").join(cells(counts), "barcode").select("gene_idx", "cell_idx", "n")


def dims(counts: DataFrame) -> DataFrame:
    """One row: n_genes, n_cells, nnz, total."""
    return counts.agg(F.count_distinct("gene").alias("n_genes"), F.count_distinct("barcode").alias("n_cells"), F.count(F.lit(1)).alias("nnz"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def _per(counts: DataFrame, key: str, known: DataFrame | None, name: str, value: Column) -> DataFrame:
    sums = counts.groupBy(key).agg(value.alias(name))
    if known is None:
        return sums
    return known.select(key).distinct().join(sums, key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def counts_per_cell(counts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Totals; cells of known without an entry have 0."""
    return _per(counts, "barcode", known, "total", F.sum("n"))


def counts_per_gene(counts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    return _per(counts, "gene", known, "total", F.sum("n"))


def genes_per_cell(counts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct genes; an explicit zero counts as seen."""
    return _per(counts, "barcode", known, "n_genes", F.count_distinct("gene"))


def cells_per_gene(counts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    return _per(counts, "gene", known, "n_cells", F.count_distinct("barcode"))


def value_at(counts: DataFrame, gene: str, barcode: str) -> DataFrame:
    return counts.where((F.col("gene") == gene) & (F.col("barcode") == barcode)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def csr(indexed_counts: DataFrame, rows: DataFrame, most_cells: int = 1 << 20) -> DataFrame:
    """(gene_idx, start, cells, values) for each row of the dimension rows(gene_idx); start is the running sum of entries, over sizes alone.

    Rows of more than most_cells cells come in pieces, one for each range of so many cells that has entries,
    in the order of start: a gene that all cells have is no single array.
    """
    cut = indexed_counts.withColumn("piece", F.floor(F.col("cell_idx") / most_cells).cast("long"))
    packed = cut.groupBy("gene_idx", "piece").agg(F.sort_array(F.collect_list(F.struct("cell_idx", "n"))).alias("entries"))
    full = rows.select("gene_idx").join(packed, "gene_idx", "left").withColumns({"piece": F.coalesce("piece", F.lit(0)), "entries": F.coalesce("entries", F.array().cast(packed.schema["entries"].dataType))})
    starts = running_total(full, ["gene_idx", "piece"], F.size("entries"), "start")
    return starts.select("gene_idx", "start", F.col("entries.cell_idx").alias("cells"), F.col("entries.n").alias("values"))


def from_values(values: DataFrame) -> DataFrame:
    """(gene, barcode, n) of the positive values of (gene, barcode, x), cut to whole numbers towards zero; repeated entries add up."""
    return add(values.where("x > 0").select("gene", "barcode", F.col("x").cast("long").alias("n")))


def from_dense(dense: DataFrame) -> DataFrame:
    """(gene, barcode, n) of the positive values of (gene, values map<barcode, n>)."""
    return dense.select("gene", F.explode("values").alias("barcode", "n")).where("n > 0")


def dense(counts: DataFrame, gene_rows: DataFrame, cell_rows: DataFrame) -> DataFrame:
    """Every gene of gene_rows with every cell of cell_rows, zeros included: what scaling and alignment need. The grid is asked for."""
    grid = gene_rows.select("gene").distinct().crossJoin(cell_rows.select("barcode").distinct())
    return grid.join(counts, ["gene", "barcode"], "left").select("gene", "barcode", F.coalesce("n", F.lit(0)).alias("n"))


def named(entries: DataFrame, gene_lines: DataFrame, cell_lines: DataFrame) -> DataFrame:
    """Entries (line_no, row, col, value) with the names of their 1-based lines; entries outside are dropped."""
    g = gene_lines.select(F.col("line_no").alias("row"), F.col("name").alias("gene"))
    c = cell_lines.select(F.col("line_no").alias("col"), F.col("name").alias("barcode"))
    return entries.join(g, "row").join(c, "col").select("line_no", "gene", "barcode", F.col("value").alias("n"))
