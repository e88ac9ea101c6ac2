"""Packing by power-of-two decomposition.

A document's tokens, with the end token, are cut into as many full sequences as fit and then into
the binary digits of the rest, so each piece has a power of two of tokens and is a sequence of its
own. Sequences of equal length form a bucket for training; none crosses documents, none is padded.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.byte_level import token_ids
from helixframe.llm.common import materialize, slices


def binary_pieces(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens, longest (a power of two) first."""
    digits = [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]
    return [longest] * (n // longest) + digits


def cut_documents(docs: DataFrame, id_col: str, text_col: str, longest: int, end_id: int, vocabulary: str | None) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])

    def cut(batches):
        for batch in slices(batches):
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(token_ids(text or "", vocabulary), np.uint32(end_id)).astype("<u4")
                start = 0
                for length in binary_pieces(len(ids), longest):
                    at.append(i)
                    rows.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
                    start += length
            columns = np.array(rows, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c) for c in columns.T]], names=[f.name for f in schema])

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    start counts the document's ids before the piece, doc_tokens all its ids with the end id;
    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers. Each piece is the sequence
    sequence_id, gapless from 0, long sequences first, at offset 0; bucket is log2 of its length.
    A null or empty text is the end id alone. Repeated rows are packed each; a null id stays null.
    An empty table gives an empty one.

    Numbers come from counts of (length, bucket of the id's md5) and a running number in each, at
    most 4096 x 11 counts, so no task sees all pieces.
    """
    pieces = materialize(cut_documents(docs, id_col, text_col, longest, end_id, vocabulary))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), "ids_crc32", F.lit(" "), "start"))  # null ids are dealt out
    pieces = pieces.withColumn("part", F.substring(F.md5(key), 1, 3))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("length").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("length", "part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32"))
    numbered = pieces.withColumn("inside", inside).join(counts, ["length", "part"])
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("inside") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))
