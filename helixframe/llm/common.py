"""What the corpus operators share: reading tables, cutting lineage, small Arrow helpers."""

import tempfile
import uuid
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_ENDS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may lack it, as tests do: it gets a temporary one."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder, removed by discard() or when the application ends.

    Unlike checkpoint(), later readers decode only the columns they use and the files are compressed.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out.written_to = path
    return out


def discard(table: DataFrame) -> None:
    """Removes a table that materialize() wrote and that nothing reads any more."""
    spark = table.sparkSession
    table.written_to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table.written_to, True)


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, deal_by: list[str], how: str = "inner", most: int = 1000, few: int | None = 50_000) -> DataFrame:
    """rows with the columns of keyed, which is materialized and has one row for each key; no key makes a hot task.

    weight counts a key's rows. Up to `few` keys, counted first, are broadcast. Beyond that the `most`
    keys of largest weight are, among which is each key with more than one in `most` of all rows; the
    rows of those are dealt out by deal_by in the shuffle that serves the others. how: inner or left.
    """
    fields = [c for c in keyed.columns if c not in on]
    hidden = [F.col(k).alias(f"__{k}") for k in on]
    same = reduce(and_, [F.col(k) == F.col(f"__{k}") for k in on])
    if few is not None and keyed.count() <= few:
        return rows.join(F.broadcast(keyed.select(*hidden, *fields)), same, how).select(*rows.columns, *fields)
    packed = F.struct(*fields)
    hot = keyed.orderBy(F.col(weight).desc(), *on).limit(most).select(*hidden, packed.alias("__hot"))
    dealt = F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*deal_by), F.lit(1 << 30)) + 1)
    marked = rows.join(F.broadcast(hot), same, "left").select(*rows.columns, "__hot", dealt.alias("__deal"))
    cold = keyed.select(*on, F.lit(0).cast("long").alias("__deal"), packed.alias("__cold"))
    found = marked.join(cold, [*on, "__deal"], "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    if how == "inner":
        found = found.where("__found is not null")
    return found.select(*rows.columns, *[F.col("__found")[c].alias(c) for c in fields])


def bit_filter(ids: DataFrame) -> np.ndarray:
    """A bit set for each of the longs in column id, by their low bits; eight bits or more for each long, 2**20 to 2**29 (64 MB) in all.

    A size is a power of two, so in_filter() knows it. Beyond some 10**8 ids more bits hit by chance; who asks must check what passes.
    """
    size = 1 << min(29, max(20, (8 * ids.count()).bit_length()))
    place = (F.pmod("id", F.lit(size)) + 1).alias("p")
    rows = ids.select(place).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    out = np.zeros(size >> 3, dtype=np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the bit of each id (uint64) is set."""
    place = ids & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


def strip_blank(column: Column) -> Column:
    return F.btrim(column, F.lit(WORD_ENDS))


def word_count(column: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches, rows: int = 256, size: int = 1 << 23):
    """Arrow batches cut to about size bytes and at most so many rows, so that a worker holds few texts as Python strings at once."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
