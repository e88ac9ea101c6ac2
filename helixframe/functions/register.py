"""The scalar functions by name, for SQL."""

from pyspark.sql import SparkSession

from helixframe.functions import sequences

# Each as SQL over its arguments: what Spark has stays a macro of built-in functions, so that plans see through it.
FUNCTIONS = {
    "subsequence": "(seq STRING, start INT, len INT) RETURNS STRING RETURN CASE WHEN length(seq) >= start + len THEN substring(seq, start + 1, len) END",
    "hamming": "(a STRING, b STRING) RETURNS INT RETURN CASE WHEN length(a) = length(b) THEN aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> int(x <> y)), 0, (s, x) -> s + x) END",
    "gene_of_read_id": "(id STRING) RETURNS STRING RETURN CASE WHEN size(split(id, ':')) >= 3 AND trim(element_at(split(id, ':'), -1)) NOT IN ('', 'NONE') THEN trim(element_at(split(id, ':'), -1)) END",
    "is_mito": "(gene STRING) RETURNS BOOLEAN RETURN startswith(gene, 'MT-') OR startswith(gene, 'mt-')",
    "ratio": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN coalesce(try_divide(a, b), 0D)",
    "safe_file_name": "(name STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]', '_'), '^[.]+', '')",
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for the session, byte_sum for sums of qualities among them; returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("byte_sum", sequences.byte_sum)
    return [*FUNCTIONS, "byte_sum"]
