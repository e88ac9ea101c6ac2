"""Structured Streaming over reads: bounded chunks with a callback, live quality by hour and by cell, progress as it is made.

Sources are folders or files of Parquet; every job reads what is there and ends (availableNow).
"""

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from helixframe.operators import qc
from helixframe.operators.graph import numbered, shared_folder
from helixframe.sources.fastq import FastqSource, read_fastq


def stream_of(spark: SparkSession, path: str, files_per_chunk: int = 16) -> DataFrame:
    """A stream of the rows of a Parquet file or folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    files = spark.read.parquet(path).select("_metadata.file_path").limit(1).collect()
    single = bool(files) and files[0][0].rstrip("/").endswith(f"/{name}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk)
    return source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)


shared = shared_folder


def process_chunks(stream: DataFrame, callback, spark: SparkSession) -> list[dict]:
    """Calls callback(chunk, number) on each micro-batch; the first error ends the stream. Returns its progress reports."""
    running = stream.writeStream.foreachBatch(callback).option("checkpointLocation", shared(spark, "chunks")).trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception():
        raise running.exception()
    return list(running.recentProgress)


def chunk_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: records that the chunks had."""
    where = shared(spark, "counts")

    def count(chunk: DataFrame, number: int) -> None:
        chunk.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{where}/chunk={number}")  # once per chunk, even if repeated

    process_chunks(stream_of(spark, path), count, spark)
    return spark.read.schema("n long, chunk long").parquet(where).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


def iter_chunks(reads: DataFrame, records: int = 100_000) -> Iterator[DataFrame]:
    """The reads in chunks of so many records, by rec_no. They are written once, by chunk, and each chunk is read back alone."""
    spark = reads.sparkSession
    where = shared(spark, "records")
    numbers = F.floor(F.col("rec_no") / records).cast("long")
    reads.withColumn("chunk", numbers).repartition("chunk").write.partitionBy("chunk").parquet(where)
    cut = spark.read.schema(T.StructType([*reads.schema.fields, T.StructField("chunk", T.LongType())])).parquet(where)
    for row in cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).orderBy("chunk").toLocalIterator():  # counts of all chunks are one job
        chunk = cut.where(F.col("chunk") == row["chunk"]).drop("chunk")
        chunk.records = row["n"]
        yield chunk


def process_records(reads: DataFrame, callback, records: int = 1_000_000) -> dict:
    """Calls callback(chunk, number) on each chunk of so many records; the first error ends it. Returns how many records and chunks there were."""
    stats = {"chunks_processed": 0, "processed_records": 0}
    for number, chunk in enumerate(iter_chunks(reads, records)):
        callback(chunk, number)
        stats["chunks_processed"] += 1
        stats["processed_records"] += chunk.records
    return stats


def process_fastq(spark: SparkSession, path: str, callback, records: int = 100_000) -> dict:
    """process_records() over a FASTQ file."""
    return process_records(read_fastq(spark, path), callback, records)


def fastq_stream(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """A stream of the records (range, at, id, seq, qual) of FASTQ files that come into a folder."""
    spark.dataSource.register(FastqSource)
    return spark.readStream.format("fastq").option("range_bytes", range_bytes).load(path)


def process_fastq_stream(spark: SparkSession, path: str, callback, checkpoint: str, records: int = 100_000) -> int:
    """Calls callback(chunk, batch, number) on chunks of so many records of the files that are new since the last call with this checkpoint folder; returns how many records there were.

    A batch that failed midway comes again under its own number, with the same files: a callback that
    writes under (batch, number) and overwrites has each record once.
    """
    seen = []

    def each(batch: DataFrame, number: int) -> None:
        numbered_rows = numbered(batch, ["range", "at"], "rec_no").select("rec_no", "id", "seq", "qual")
        for n, chunk in enumerate(iter_chunks(numbered_rows, records)):
            callback(chunk, number, n)
            seen.append(chunk.records)

    running = fastq_stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return sum(seen)


def map_chunks(reads: DataFrame, function, schema: str, records: int = 100_000) -> DataFrame:
    """The rows that function(number, table) gives for each chunk of so many records, by rec_no; table is an Arrow table of the chunk, rec_no in order.

    Chunks run side by side in tasks, so that there may be many small ones; process_records() calls back on the driver instead, a job a chunk.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return function(key[0].as_py(), table.drop_columns(["chunk"]).sort_by("rec_no"))

    return reads.withColumn("chunk", F.floor(F.col("rec_no") / records).cast("long")).groupBy("chunk").applyInArrow(run, schema)


def record_chunks(reads: DataFrame, records: int) -> DataFrame:
    """(chunk, records, bases): what a function counts in each chunk."""

    def count(number: int, chunk: pa.Table) -> pa.Table:
        bases = pc.sum(pc.utf8_length(chunk["seq"]).cast(pa.int64())).as_py()
        return pa.table({"chunk": pa.array([number], pa.int64()), "records": pa.array([chunk.num_rows], pa.int64()), "bases": pa.array([bases], pa.int64())})

    return map_chunks(reads.select("rec_no", "seq"), count, "chunk long, records long, bases long", records)


def live_qc(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """(hour, reads, mapped): a watermarked window count, written as the last state of each hour."""
    where = shared(spark, "live")
    stream = stream_of(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    state = stream.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("event_type") != "error").alias("mapped"))

    def keep(chunk: DataFrame, number: int) -> None:
        chunk.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "reads", "mapped").write.mode("overwrite").parquet(f"{where}/chunk={number}")

    running = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", shared(spark, "state")).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.read.schema("hour timestamp_ntz, reads long, mapped long, chunk long").parquet(where)
    return rows.groupBy("hour").agg(F.max_by("reads", "chunk").alias("reads"), F.max_by("mapped", "chunk").alias("mapped"))


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_live_cells(found: DataFrame, folder: str, expire: str | None = None, trigger: dict | None = None) -> list[StreamingQuery]:
    """Starts live quality by cell over a stream of (cell, gene, umi), or (cell, gene, umi, ts) with expire: one query counts reads, one new UMIs.

    What has been seen is Spark's own state, a row for each UMI of a cell and gene, on the executors' disks and in
    the checkpoint: no cell is one task or one object, however many reads it has. With expire, UMIs that have not come
    for so long are forgotten (and counted again if they come back); without, state grows with distinct UMIs.
    Each batch adds a table under its number, so one that is repeated after a failure counts once, and queries that are
    started again with the same folder go on where they stopped. Reads without a cell count as read, not as valid;
    reads without gene or UMI are in no cell's counts.
    """
    spark, trigger = found.sparkSession, trigger or {"availableNow": True}

    def reads(chunk: DataFrame, number: int) -> None:
        chunk.agg(F.count(F.lit(1)).alias("reads"), F.count("cell").alias("valid")).write.mode("overwrite").parquet(f"{folder}/reads/batch={number}")

    def umis(chunk: DataFrame, number: int) -> None:
        chunk.groupBy("cell", "gene").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/umis/batch={number}")

    whole = found.where("cell is not null and gene is not null and umi is not null")
    keys = ["cell", "gene", "umi"]
    new = whole.withWatermark("ts", expire).dropDuplicatesWithinWatermark(keys) if expire else whole.select(*keys).dropDuplicates(keys)
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ON_DISK)
    try:
        return [
            stream.writeStream.queryName(f"live {name}").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoints/{name}").trigger(**trigger).start()
            for name, stream, keep in (("reads", found, reads), ("umis", new, umis))
        ]
    finally:
        spark.conf.set(STATE_PROVIDER, before) if before else spark.conf.unset(STATE_PROVIDER)


def live_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(gene, barcode, n): distinct UMIs so far."""
    rows = spark.read.schema("cell string, gene string, n long").parquet(f"{folder}/umis/batch=*")
    return rows.groupBy("gene", F.col("cell").alias("barcode")).agg(F.sum("n").alias("n"))


def live_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(barcode, n_genes, total, mito_percent) so far."""
    return qc.cell_metrics(live_counts(spark, folder))


def live_view(spark: SparkSession, folder: str) -> DataFrame:
    """One row: valid_percent, n_cells, median_genes, warnings so far; 0 % without reads."""
    reads = spark.read.schema("reads long, valid long").parquet(f"{folder}/reads/batch=*")
    share = reads.agg(F.coalesce(F.round(100 * F.sum("valid") / F.nullif(F.sum("reads"), F.lit(0)), 6), F.lit(0.0)).alias("valid_percent"))
    sizes = live_cells(spark, folder).agg(F.count(F.lit(1)).alias("n_cells"), qc.upper_median("n_genes").cast("long").alias("median_genes"))
    return qc.live_warnings(share.crossJoin(F.broadcast(sizes)))  # one row each


class Progress(StreamingQueryListener):
    """Hands send() a dictionary for each micro-batch of any query (its name, number, rows in, rows of state) and for each end (its error or None)."""

    def __init__(self, send: Callable[[dict], None]):
        self.send, self.names = send, {}

    def onQueryStarted(self, event):
        self.names[event.runId] = event.name

    def onQueryProgress(self, event):
        p = event.progress
        self.send({"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.send({"query": self.names.pop(event.runId, None), "ended": True, "error": event.exception})


@contextmanager
def progress_of(spark: SparkSession, send: Callable[[dict], None], last_events: float = 30):
    """Inside, send() hears of all queries of the session; at the end it waits so many seconds at most for events of queries that have ended."""
    listener = Progress(send)
    spark.streams.addListener(listener)
    try:
        yield listener
        until = time.monotonic() + last_events
        while listener.names.keys() - {q.runId for q in spark.streams.active} and time.monotonic() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(listener)
