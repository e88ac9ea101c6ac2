"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's characters; a chunk ends where some bits of it are zero, so the ends
depend on the last characters only and shift with insertions. Chunks with equal digests of 128 bits are
repeats. The first place of a chunk, by document and position, keeps it; runs of chunks that are kept
elsewhere are spans to take out, given as pieces that each have one source.
"""

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import bit_filter, in_filter, join_hot, materialize, slices

WINDOW = 16


def gear_of(codes: np.ndarray) -> np.ndarray:
    """A random number for each character, by splitmix64."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)).astype(np.uint32)


GEAR = gear_of(np.arange(65_536))


def chunk_ends(text: str, least: int, bits: int, most: int) -> list[int]:
    """Ends of the chunks of a text, in characters; the last is its length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h, step = GEAR[np.minimum(codes, 0xFFFF)], 1
    wide = codes > 0xFFFF
    h[wide] = gear_of(codes[wide])
    while step < WINDOW:  # h[i] sums the last 2 * step characters, each shifted by its distance
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    zero = np.uint32((1 << bits) - 1) << np.uint32(WINDOW - bits)
    candidates = (np.flatnonzero((h & zero) == 0) + 1).tolist()
    ends, start, n, at = [], 0, len(codes), 0
    while n - start > least:
        at = bisect_left(candidates, start + least, at)
        start = min(candidates[at] if at < len(candidates) else n, start + most, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, int, int], wanted: np.ndarray | None = None) -> DataFrame:
    """(doc, version, start, end, d1, d2) of all chunks, or of those whose digest's bit is set in wanted; version tells apart rows that share an id but not the text."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    longs = ("version", "start", "end", "d1", "d2")
    schema = T.StructType([rows.schema["doc"], *[T.StructField(c, T.LongType()) for c in longs]])
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in slices(batches):
            owner, starts, ends, digests = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if text:
                    cuts = chunk_ends(text, *sizes)
                    begins = [0, *cuts[:-1]]
                    owner.append(np.full(len(cuts), i))
                    starts += begins
                    ends += cuts
                    digests += [xxhash.xxh3_128_digest(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(begins, cuts, strict=True)]
            if owner:
                halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
                columns = [np.concatenate(owner), np.array(starts), np.array(ends), halves[:, 0], halves[:, 1]]
                if shared is not None:
                    keep = in_filter(shared.value, columns[3])
                    columns = [c[keep] for c in columns]
                at = pa.array(columns[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c) for c in columns[1:3]], *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns[3:]]], names=schema.names)

    return rows.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, bits: int = 4, most: int = 80, min_chars: int = 120) -> DataFrame:
    """One row per piece of a span: doc, version, start, end (characters), n_chunks, kept_doc, kept_start, span_start, span_end.

    A chunk has least to most characters, about least + 2**bits on average. The first of all places
    that have it, by document, text and position, keeps it; all others are repeats, in the same
    document, too. Runs of repeats of at least min_chars characters are spans. A piece of a span is a
    stretch with one source: its characters are those of kept_doc from kept_start on. Chunks of
    both ends of a passage are lost where they reach over its ends, so a span is a little shorter than
    the passage. Null and empty texts have none; texts are cut whole, however long. Repeated rows with
    one id and text are one document, with different texts several. A null id comes first. An empty
    table gives an empty one; other columns of docs are not read.
    """
    sizes, digest = (least, bits, most), ["d1", "d2"]
    repeats = materialize(chunk_rows(docs, id_col, text_col, sizes).groupBy(*digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("d1").alias("id")))
    found = materialize(chunk_rows(docs, id_col, text_col, sizes, bit_filter(repeats)))
    first = F.struct(F.col("doc").alias("kept_doc"), F.col("version").alias("kept_version"), F.col("start").alias("kept_start"))
    firsts = found.groupBy(*digest).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.select(*digest, "n", "first.*"))
    place = F.struct(F.col("doc").alias("kept_doc"), F.col("version").alias("kept_version"), F.col("start").alias("kept_start"))
    others = join_hot(found, firsts, digest, "n", ["doc", "start"]).where(place > F.struct("kept_doc", "kept_version", "kept_start"))

    along = Window.partitionBy("doc", "version").orderBy("start")
    before = lambda c: F.lag(c).over(along)
    again = before("start") == F.col("start")  # a repeated row
    broken = F.when(again, 0).when(before("end") < F.col("start"), 1).otherwise(0)
    follows = before("kept_doc").eqNullSafe(F.col("kept_doc")) & (before("kept_version") == F.col("kept_version")) & (before("kept_start") - before("start") == F.col("kept_start") - F.col("start"))
    other = F.when(again, 0).when(follows & (broken == 0), 0).otherwise(1)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = others.withColumn("broken", broken).withColumn("other", other).withColumn("run", F.sum("broken").over(upto)).withColumn("piece", F.sum("other").over(upto))
    pieces = runs.groupBy("doc", "version", "run", "piece").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("start").alias("n_chunks"), F.min("kept_doc").alias("kept_doc"), F.min("kept_start").alias("kept_start"))
    whole = Window.partitionBy("doc", "version", "run")
    spans = pieces.withColumn("span_start", F.min("start").over(whole)).withColumn("span_end", F.max("end").over(whole))
    return spans.where(F.col("span_end") - F.col("span_start") >= min_chars).select("doc", "version", "start", "end", "n_chunks", "kept_doc", "kept_start", "span_start", "span_end")


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans cut out of the text; other columns as they are."""
    by_doc = spans.groupBy(F.col("doc").alias("__doc"), F.col("version").alias("__version")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    text = F.expr(
        f"concat(aggregate(__spans, named_struct('at', 0L, 'kept', ''), (s, x) -> named_struct('at', x.end, 'kept', concat(s.kept, substring(`{text_col}`, cast(s.at + 1 as int), cast(x.start - s.at as int)))), s -> s.kept),"
        f" substring(`{text_col}`, cast(element_at(__spans, -1).end + 1 as int)))"
    )
    joined = docs.join(by_doc, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__version")), "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(text)).select(docs.columns)
