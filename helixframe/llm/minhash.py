"""MinHash fingerprints of documents, near duplicates by signature bands, and each text beside its successor.

A document's shingles are hashed by universal functions a * x + b mod 2**32, many at once in numpy;
the least value of each is the signature. Similar sets agree in a share of it that is near their
Jaccard similarity. Bands of the signature are joined in Spark, and what meets there is verified on
the sets of shingles themselves.
"""

import hashlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import bit_filter, discard, in_filter, join_hot, materialize, slices
from helixframe.llm.jaccard import Heads, SetColumns, Shingler, mixed, numbered, set_classes, words_of

#: Hash functions, and the rows of a band. Of sets with a similarity of 0.8, all but one pair in 10**7 share a band; at 0.3, a fifth.
FUNCTIONS, ROWS = 128, 4
#: Shingles that are hashed at once, so that the values stay in a core's cache.
AT_ONCE = 1024
SEED = 20260101
#: Bits of a band's key by which bands are counted: of 10**9 keys, one in a thousand looks as if it were there twice.
COUNTED = 40
#: Sets with a component to look up, beyond which rows are joined to them by a shuffle and not by a broadcast.
FEW = 50_000


@lru_cache(maxsize=1)
def universal() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the functions, from a fixed seed."""
    drawn = (mixed(np.arange(SEED, SEED + 2 * FUNCTIONS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(2, FUNCTIONS, 1)
    return drawn[0] | np.uint32(1), drawn[1]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value (uint32) of each function over shingle hashes (uint64); the largest there is for no shingles."""
    factors, offsets = universal()
    least, x = np.full(FUNCTIONS, 0xFFFFFFFF, dtype=np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(x), AT_ONCE):
        values = x[start : start + AT_ONCE] * factors
        values += offsets
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key (uint64) for each band of the signature; none for no shingles."""
    return band_keys(digits(signature(shingles)).tobytes())[0] if len(shingles) else np.zeros(0, dtype=np.uint64)


def band_keys(fingerprints: bytes) -> np.ndarray:
    """The keys (uint64, sets x bands) of fingerprints that stand one behind the other."""
    rows = np.frombuffer(fingerprints, dtype=">u2").astype(np.uint64).reshape(-1, FUNCTIONS // ROWS, ROWS)
    keys = np.arange(FUNCTIONS // ROWS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return keys


def digits(least: np.ndarray) -> np.ndarray:
    """Sixteen bits of each value: fingerprints keep these, in which different values agree once in 65,536 times."""
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return np.count_nonzero(a == b) / FUNCTIONS


class Marked:
    """A text with its set and fingerprint."""

    def __init__(self, text: str, shingler: Shingler):
        self.text, self.hashes = text, shingler.hashes(words_of(text))
        self.shingles = np.unique(shingler.in_order(self.hashes))
        self.digits = digits(signature(self.shingles))


def edited(text: str, after: str) -> str:
    """The text, its last half (rounded down) replaced by the first as many characters of another, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edited_hashes(own: Marked, after: Marked, new: str, shingler: Shingler) -> np.ndarray:
    """The hashes of the words of new, the edited text; all but those at its cuts are the two texts' own."""
    cut = len(own.text) - len(own.text) // 2
    words, before, behind = words_of(new), len(words_of(new[:cut])), len(words_of(new[cut:]))
    head, tail = max(0, before - 1), max(0, behind - 2)  # without the last word before the cut, the first behind it and the last of all
    last = words[-1:] if behind > 1 else []
    middle = words[head : len(words) - tail - len(last)]
    return np.concatenate([own.hashes[:head], shingler.hashes(middle), after.hashes[1 : 1 + tail], shingler.hashes(last)])


def range_heads(docs: DataFrame, ranges: int) -> list[tuple]:
    """The largest key (not null, id, hash) of each of so many ranges of the order, ascending."""
    rows = docs.select(F.struct(F.col("id").isNotNull().alias("known"), "id", "h").alias("key"))
    parts = rows.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("key"))
    return sorted(tuple(r["key"]) for r in parts.collect())  # a row for each range


def beside_next(docs: DataFrame, id_col: str, text_col: str, run, kind: T.StructType) -> DataFrame:
    """What run makes of an iterator of (id, text, next text): each row of docs with the row of the next smaller id, the last with the first.

    Rows of one id follow the hash of their texts; null ids come last; null texts are empty. The order
    is cut into ranges at keys that rows have, and the first row of each goes to the range before, too.
    A range is streamed through: a task holds a few texts, which travel compressed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = range_heads(rows, ranges)
    sent = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("tail", T.BooleanType()), *rows.schema.fields[:1], T.StructField("h", T.LongType()), T.StructField("packed", T.BinaryType())])

    def deal(batches):
        pack, given = zstandard.ZstdCompressor(level=3).compress, set()
        for batch in slices(batches):
            ids, texts, hashes = (c.to_pylist() for c in batch.columns)
            at, of, tail = [], [], []
            packed = [pack(t.encode()) for t in texts]
            for i, (key, h) in enumerate(zip(ids, hashes, strict=True)):
                k = bisect_left(heads, (key is not None, key, h))
                at.append(i)
                of.append(k)
                tail.append(False)
                if heads[k] == (key is not None, key, h) and k not in given:
                    given.add(k)
                    at.append(i)
                    of.append((k + 1) % len(heads))
                    tail.append(True)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(tail), batch.column(0).take(take), batch.column(2).take(take), pa.array(packed, pa.binary()).take(take)], names=[f.name for f in sent])

    def pairs(batches):
        unpack, before = zstandard.ZstdDecompressor().decompress, None
        for batch in slices(batches):
            for of, tail, key, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if tail and (before is None or before[0] != of):
                    continue  # a second tail of the range
                text = unpack(packed).decode()
                if before is not None and before[0] == of:
                    yield before[1], before[2], text
                before = None if tail else (of, key, text)

    dealt = rows.mapInArrow(deal, sent).repartition("range")
    dealt = dealt.sortWithinPartitions("range", "tail", F.col("id").desc_nulls_last(), F.col("h").desc())
    return dealt.mapInArrow(lambda batches: run(pairs(batches)), kind)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row, digests as binary, and jaccard.SetColumns without lists, which fingerprints give.

    edited(): the text with its last half from the next document, by descending id. near_edited and
    near_next are the shares of FUNCTIONS in which fingerprints agree, those of empty sets in all.
    """
    fields = [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    spark_types = {pa.int64(): T.LongType(), pa.binary(): T.BinaryType(), pa.float64(): T.DoubleType()}
    key_type = docs.schema[id_col].dataType
    kind = T.StructType([T.StructField("doc", key_type), *[T.StructField(n, spark_types[t]) for n, t in fields], *SetColumns.SPARK[: SetColumns.OWN]])
    arrow_key = docs.select(id_col).limit(0).toArrow().schema.field(0).type

    def run(pairs):
        shingler, columns_of, own, rows, marked = Shingler(words), SetColumns(), None, [], []

        def sent():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [arrow_key, *[t for _, t in fields]], strict=True)]
            columns += columns_of([m.text for m in marked], [m.shingles for m in marked])
            rows.clear()
            marked.clear()
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in kind])

        size = 0
        for key, text, after in pairs:
            own = own if own is not None and own.text == text else Marked(text, shingler)
            new, other = edited(text, after), Marked(after, shingler)
            new_digits = digits(signature(shingler.in_order(edited_hashes(own, other, new, shingler))))
            rows.append((key, len(text), hashlib.sha256(new.encode()).digest(), own.digits.tobytes(), new_digits.tobytes(), likeness(own.digits, new_digits), likeness(own.digits, other.digits)))
            marked.append(own)
            size, own = size + len(text), other
            if len(rows) == 512 or size > 1 << 22:
                yield sent()
                size = 0
        if rows:
            yield sent()

    return beside_next(docs, id_col, text_col, run, kind)


def fingerprint_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc, fingerprint) of each row and jaccard.SetColumns without lists, in one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = T.StructType([rows.schema["doc"], T.StructField("fingerprint", T.BinaryType()), *SetColumns.SPARK[: SetColumns.OWN]])

    def run(batches):
        shingler, columns_of = Shingler(words), SetColumns()
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sets = [shingler(t) for t in texts]
            marks = pa.array([digits(signature(s)).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks, *columns_of(texts, sets)], names=[f.name for f in kind])

    return rows.mapInArrow(run, kind)


def new_bands(batch: pa.RecordBatch, given: set[int]) -> tuple[list[int], np.ndarray]:
    """The rows of batch (fingerprint, low, high) whose sets are not empty and not among those given so far, and their bands."""
    rows = []
    for i, (low, high) in enumerate(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)):
        if low is not None and (digest := (high << 64) + low) not in given:
            given.add(digest)
            rows.append(i)
    return rows, band_keys(b"".join(batch.column("fingerprint").take(pa.array(rows, pa.int64())).to_pylist()))


def shared_bands(keyed: DataFrame) -> DataFrame:
    """(doc, n, low, high, tid, bits, sigs, heads) as jaccard.set_rows() gives them, of keyed (materialized), which has fingerprints in place of the lists.

    Bands are made from fingerprints, here and nowhere else, so they are not written out. Those that one
    row alone has are left out: most documents have no other. Bands are counted as they come from the
    tasks, by COUNTED bits, and those found twice go into a bit filter of at most 64 MB; what it lets
    through by chance is a list of one set.
    """
    cut = np.uint64(64 - COUNTED)

    def counted(batches):
        given = set()
        for batch in slices(batches, 4096):
            _, keys = new_bands(batch, given)
            yield pa.RecordBatch.from_arrays([pa.array((keys.ravel() >> cut).view(np.int64))], names=["id"])

    twice = keyed.select("fingerprint", "low", "high").mapInArrow(counted, "id long").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    bits = keyed.sparkSession.sparkContext.broadcast(bit_filter(materialize(twice)))
    own = ["doc", *[f.name for f in SetColumns.SPARK[: SetColumns.OWN]]]
    kind = T.StructType([*keyed.select(*own).schema, *SetColumns.SPARK[SetColumns.OWN :]])

    def run(batches):
        known, given, heads_of = bits.value, set(), Heads()
        for batch in slices(batches, 4096):
            rows, keys = new_bands(batch, given)
            keep = in_filter(known, keys >> cut)
            sizes, lows = np.zeros(batch.num_rows, dtype=np.int64), np.array([batch.column("low")[i].as_py() for i in rows], dtype=np.int64)
            sizes[rows] = keep.sum(axis=1)
            sigs = keys[keep].view(np.int64)
            heads = heads_of(sigs, np.repeat(lows, sizes[rows])) if len(sigs) else sigs
            lone = np.ones(batch.num_rows, dtype=bool)
            lone[rows] = False
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x), mask=pa.array(lone)) for x in (sigs, heads)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *lists], names=[f.name for f in kind])

    return keyed.select(*own, "fingerprint").mapInArrow(run, kind)


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with asked: whether their sid may be one of ids (id), by a bit filter; some others are, by chance."""
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(ids))
    kind = T.StructType([*rows.schema, T.StructField("asked", T.BooleanType())])

    def run(batches):
        for batch in batches:
            sids = batch.column("sid")
            hit = in_filter(bits.value, sids.fill_null(0).to_numpy().view(np.uint64)) & sids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[f.name for f in kind])

    return rows.mapInArrow(run, kind)


def with_classes(docs: DataFrame, keyed: DataFrame, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """keyed (materialized) with n_shingles and component instead of the columns of sets.

    Rows are wide, and most are a component by themselves: those are not joined, so they are not shuffled.
    """
    narrow = materialize(shared_bands(keyed))
    doubled, of_sid = set_classes(docs, narrow, text_col, words, num, den)
    of_sid = materialize(of_sid.where("docs > 1 or not (least <=> first)").drop("first"))
    discard(narrow)
    rows = numbered(keyed, doubled).drop("low", "high", "tid", "bits")
    if of_sid.count() <= FEW:
        rows = join_hot(rows, of_sid, ["sid"], "docs", ["doc"], "left", few=FEW)
    else:
        rows = among(rows, of_sid.select(F.col("sid").alias("id")))
        lone = rows.where("not asked").withColumns({"least": F.lit(None).cast(of_sid.schema["least"].dataType), "docs": F.lit(None).cast("long")})
        rows = join_hot(rows.where("asked"), of_sid, ["sid"], "docs", ["doc"], "left", few=None).unionByName(lone).drop("asked")
    return rows.withColumnRenamed("n", "n_shingles").withColumn("component", F.coalesce("least", "doc")).drop("sid", "least", "docs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs: doc, n_shingles, component (the least id reachable by links).

    Documents link when their sets share a band and den * shared >= num * all shingles of the two, so
    none below the bound links. Sets, empty texts, repeated rows, null ids and empty tables are as in
    jaccard.jaccard_join(), which finds the pairs without bands.
    """
    return with_classes(docs, materialize(fingerprint_sets(docs, id_col, text_col, words)), text_col, words, num, den).drop("fingerprint")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) as fingerprint_edits() gives them, digests as lowercase hex, with n_shingles and component as near_duplicates() does.

    Null texts are empty; equal texts have equal fingerprints; whole texts count, however long. Repeated
    rows give a row each, a null id stays null (and comes last in the order); one row alone is its own
    next. An empty table gives an empty one; other columns of docs are not read.
    """
    rows = with_classes(docs, materialize(fingerprint_edits(docs, id_col, text_col, words)), text_col, words, num, den)
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
