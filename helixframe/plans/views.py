"""The given tables seen as reads, whitelists, counts and labels, in Spark and as DuckDB SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, DNA = "0123456789abcdef", "ACGTACGTACGTACGT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores are dealt out to all cores; of more files, as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def dna(key: Column, length: int) -> Column:
    """A sequence that follows from a key."""
    return F.translate(F.substring(F.md5(key.cast("string")), 1, length), HEX, DNA)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: filters on them are not pushed down as copies of their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def gene_of(props: Column) -> Column:
    return F.concat(F.lit("GENE_"), F.lpad(F.get_json_object(props, "$.k"), 4, "0"))


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(dna(F.col("user_id"), 16).alias("barcode")).distinct()


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reads: a tenth has one base changed, a twentieth five N."""
    e = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "props", "event_type"))
    i, at = F.col("event_id"), (F.col("event_id") % 16 + 1).cast("int")
    e = computed(e, true_barcode=dna(F.col("user_id"), 16), tag=dna(i % 500, 12), gene=gene_of(F.col("props")))
    true = F.col("true_barcode")
    changed = F.overlay(true, F.translate(F.substring(true, at, F.lit(1)), "ACGT", "CGTA"), at)
    e = computed(e, bc=F.when(i % 10 == 0, changed).when(i % 20 == 1, F.overlay(true, F.lit("NNNNN"), F.lit(1))).otherwise(true))
    # every 50th read is cut short
    e = computed(e, seq=F.concat("bc", F.substring("tag", F.lit(1), F.when(i % 50 == 7, 4).otherwise(12))))
    e = computed(e, qual=F.repeat(F.chr(33 + i % 41), F.length("seq")))
    name = F.format_string("READ_%08d:%s:%s", i, "bc", F.when(i % 9 == 0, "NONE").otherwise(F.col("gene")))
    return e.select(i.alias("rec_no"), name.alias("id"), "seq", "qual", "true_barcode", "gene", (i % 61).cast("int").alias("mapq"), (F.col("event_type") != "error").alias("is_mapped"), "event_type")


READS = r"""
ev AS (SELECT *, translate(substr(md5(user_id::VARCHAR), 1, 16), '0123456789abcdef', 'ACGTACGTACGTACGT') AS true_barcode,
       translate(substr(md5((event_id % 500)::VARCHAR), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT') AS tag,
       'GENE_' || lpad(json_extract_string(props, '$.k'), 4, '0') AS gene, (event_id % 16 + 1)::INT AS place FROM events),
bcs AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN substr(true_barcode, 1, place - 1) || translate(substr(true_barcode, place, 1), 'ACGT', 'CGTA') || substr(true_barcode, place + 1)
       WHEN event_id % 20 = 1 THEN 'NNNNN' || substr(true_barcode, 6) ELSE true_barcode END AS bc FROM ev),
seqs AS (SELECT *, CASE WHEN event_id % 50 = 7 THEN bc || substr(tag, 1, 4) ELSE bc || tag END AS seq FROM bcs),
reads AS (SELECT event_id AS rec_no, 'READ_' || lpad(event_id::VARCHAR, 8, '0') || ':' || bc || ':' || CASE WHEN event_id % 9 = 0 THEN 'NONE' ELSE gene END AS id,
       seq, repeat(chr((33 + event_id % 41)::INT), length(seq)) AS qual, (event_id % 41)::INT AS q, true_barcode, gene, (event_id % 61)::INT AS mapq, event_type <> 'error' AS is_mapped, event_type FROM seqs),
wl AS (SELECT DISTINCT true_barcode AS barcode FROM ev)"""

EXTRACTED = READS + r""",
extracted AS (SELECT *, CASE WHEN length(seq) >= 28 THEN substr(seq, 1, 16) END AS barcode, CASE WHEN length(seq) >= 28 THEN substr(seq, 17, 12) END AS umi FROM reads)"""

#: Distinct barcodes corrected within one mismatch.
CORRECTED = EXTRACTED + r""",
nb AS (SELECT substr(barcode, 1, p - 1) || b || substr(barcode, p + 1) AS variant, barcode FROM wl, (SELECT unnest(range(1, 17)) AS p), (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) u(b) WHERE substr(barcode, p::INT, 1) <> b),
idx AS (SELECT variant, count(*) AS n, min(barcode) AS original FROM nb GROUP BY variant),
fixed AS (SELECT d.barcode, CASE WHEN wl.barcode IS NOT NULL THEN 'exact' WHEN idx.n = 1 THEN 'corrected' ELSE 'no_match' END AS status,
       CASE WHEN wl.barcode IS NOT NULL THEN wl.barcode WHEN idx.n = 1 THEN idx.original END AS corrected,
       CASE WHEN wl.barcode IS NULL AND idx.n = 1 THEN 1 ELSE 0 END AS distance
       FROM (SELECT DISTINCT barcode FROM extracted WHERE barcode IS NOT NULL) d LEFT JOIN wl ON d.barcode = wl.barcode LEFT JOIN idx ON d.barcode = idx.variant),
matched AS (SELECT e.*, f.status, f.corrected AS cell, f.distance FROM extracted e LEFT JOIN fixed f ON e.barcode = f.barcode)"""


def user_cells(events: DataFrame) -> DataFrame:
    """Adds gene and barcode: users as cells, keys of props as genes; genes under 5 are mitochondrial."""
    k = F.get_json_object("props", "$.k")
    gene = F.when(k.cast("int") < 5, F.concat(F.lit("MT-"), k)).otherwise(F.concat(F.lit("GENE_"), F.lpad(k, 4, "0")))
    return events.withColumns({"gene": gene, "barcode": F.format_string("CELL_%06d", "user_id")})


def counts_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user and key as counts."""
    return user_cells(table(spark, sf_dir, "events")).groupBy("gene", "barcode").agg(F.count(F.lit(1)).alias("n"))


COUNTS_A = r"""
counts AS (SELECT CASE WHEN json_extract_string(props, '$.k')::INT < 5 THEN 'MT-' || json_extract_string(props, '$.k') ELSE 'GENE_' || lpad(json_extract_string(props, '$.k'), 4, '0') END AS gene,
       'CELL_' || lpad(user_id::VARCHAR, 6, '0') AS barcode, count(*)::BIGINT AS n FROM events GROUP BY ALL)"""


def counts_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells, brands as genes."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = li.select("l_orderkey", "l_partkey").join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("p_brand").alias("gene"), F.format_string("CELL_%06d", "o_custkey").alias("barcode")).agg(F.count(F.lit(1)).alias("n"))


COUNTS_B = r"""
counts AS (SELECT p_brand AS gene, 'CELL_' || lpad(o_custkey::VARCHAR, 6, '0') AS barcode, count(*)::BIGINT AS n
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of counts_b, those without counts, too."""
    return table(spark, sf_dir, "customer").select(F.format_string("CELL_%06d", "c_custkey").alias("barcode"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, coords, label): embeddings as cells."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("coords"), "label")


def vector_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, barcode, x): embeddings as a dense matrix."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("barcode"), F.posexplode("embedding").alias("gene", "x")).select("gene", "barcode", F.col("x").cast("double").alias("x"))


GRID = r"""
grid AS (SELECT vec_id AS barcode, (generate_subscripts(embedding, 1) - 1)::INT AS gene, unnest(embedding)::DOUBLE AS x FROM embeddings)"""
