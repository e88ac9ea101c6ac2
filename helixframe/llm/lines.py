"""Line deduplication that moves hashes, and returns a keep bitmap for each document instead of text.

Each line that is long enough becomes (hash, document, position). The hashes are range-partitioned
with a salt from the document, so that a line which a third of all documents hold is spread over many
tasks, and sorted by document and position inside; a running window streams over them and marks the
first occurrence of a key in a document. Those marks are counted by key (partial sums before the
shuffle), and keys in enough documents lose their lines everywhere but in the document that keeps them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import ascii_lower, join_hot, materialize, strip_blank

SALTS = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, version, pos, h1, h2) of each line whose key has min_chars code points or more.

    version tells apart rows that share an id but not the text. Two 64-bit hashes make one of 128 bits.
    """
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(split_lines(text)).alias("pos", "line"))
    lines = lines.where(F.length(strip_blank(F.col("line"))) >= min_chars)
    key = ascii_lower(strip_blank(F.col("line")))
    return lines.select("doc", "version", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def repeated_keys(hashes: DataFrame, min_docs: int, keep: str) -> DataFrame:
    """(h1, h2, n_docs, keeper) of the keys that min_docs documents or more hold."""
    latest = keep == "last"
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    ranged = salted.repartitionByRange("h1", "h2", "salt")
    order = [F.col("doc").desc() if latest else F.col("doc").asc(), F.col("pos").asc()]
    streamed = Window.partitionBy("h1", "h2", "salt").orderBy(*order)
    previous = F.lag(F.struct("doc")).over(streamed)
    first = ranged.select("h1", "h2", "doc", (previous.isNull() | ~previous["doc"].eqNullSafe(F.col("doc"))).alias("first")).where("first")
    keeper = F.max("doc") if latest else F.min("doc")
    return first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), keeper.alias("keeper")).where(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, keep: str = "last") -> DataFrame:
    """One row (doc, version, bitmap) for each document that loses lines.

    bitmap maps a block of 64 lines to a long with a bit set for each line that stays. It is
    compressed: blocks that keep all are absent, and so are documents that do. The join to the
    repeated keys has no hot key: the lines of the most frequent ones meet a broadcast.
    """
    hashes = line_hashes(docs, id_col, text_col, min_chars)
    keys = materialize(repeated_keys(hashes, min_docs, keep))
    dropped = join_hot(hashes, keys, ["h1", "h2"], "n_docs", ["doc", "pos"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    bit = F.expr("shiftleft(1L, pmod(pos, 64))")
    blocks = dropped.groupBy("doc", "version", F.expr("pos div 64").alias("block")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return blocks.groupBy("doc", "version").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("bitmap"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, keep: str = "last") -> DataFrame:
    """docs with kept_text, n_lines and n_dropped besides its columns (clashing ones are replaced).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs documents lose all lines but those of the document
    with the largest id (keep="last") or the smallest (keep="first"). Null and empty texts are one
    empty line. Rows with one id count as one document, each keeps or loses by its own lines; a null
    id is a document too and keeps a key only if no other holds it. An empty table gives an empty one.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs, keep).select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("bitmap").alias("__bitmap"))
    docs = docs.withColumn("__v", F.xxhash64(F.col(text_col)))
    joined = docs.join(bitmaps, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("__v") == F.col("__version")), "left")
    lines = split_lines(F.col(text_col))
    kept = F.expr(f"filter(split(coalesce(`{text_col}`, ''), '\\n', -1), (x, i) -> coalesce(shiftright(try_element_at(__bitmap, cast(i div 64 as bigint)), cast(i % 64 as int)) & 1L, 1L) = 1L)")
    return (
        joined.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.when(F.col("__bitmap").isNull(), F.lit(0)).otherwise(F.expr("aggregate(map_values(__bitmap), 0, (n, b) -> n + 64 - bit_count(b))")).cast("long"))
        .withColumn("kept_text", F.when(F.col("__bitmap").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")))
        .drop("__doc", "__version", "__bitmap", "__v")
    )
