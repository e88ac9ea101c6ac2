"""Column expressions over bases and qualities. All stay in the JVM but sums of qualities, which Arrow hands over as buffers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BASES = ("A", "C", "G", "T", "N")
PHRED = 33


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def subsequence(seq, start, length) -> Column:
    """length characters from a 0-based start; null where the sequence ends before."""
    seq, start, length = col(seq), F.lit(start), F.lit(length)
    return F.when(F.length(seq) >= start + length, F.substring(seq, start + 1, length))


def phred(character: Column) -> Column:
    return F.ascii(character) - PHRED


@F.arrow_udf(LongType())
def byte_sum(texts: pa.Array) -> pa.Array:
    """Sum of the bytes of each string; null for null."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(np.frombuffer(data, dtype=np.uint8, count=ends[-1]), dtype=np.int64)]) if ends[-1] else np.zeros(1, dtype=np.int64)
    return pa.array(upto[ends[1:]] - upto[ends[:-1]], mask=np.array(texts.is_null()))


def phred_total(qual) -> Column:
    """Sum of the Phred scores of a string."""
    return byte_sum(col(qual)) - PHRED * F.length(col(qual))


def mean_quality(qual) -> Column:
    """Mean Phred score; 0 for an empty string."""
    return F.coalesce(F.try_divide(phred_total(qual).cast("double"), F.length(col(qual)).cast("double")), F.when(col(qual).isNotNull(), 0.0))


def mean_quality_region(qual, start, length) -> Column:
    """Mean Phred score of a region; null out of range, 0 for an empty region."""
    return mean_quality(subsequence(qual, start, length))


def quality_ok(qual, least: int) -> Column:
    """Mean Phred of at least `least`, inclusive; an empty string fails."""
    return (F.length(col(qual)) > 0) & (phred_total(qual) >= least * F.length(col(qual)))


def hamming(a, b) -> Column:
    """Places that differ; null for unequal lengths."""
    a, b = col(a), col(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def substituted(seq, place: Column, base: Column) -> Column:
    """The sequence with one base put at a 1-based place."""
    seq = col(seq)
    return F.concat(F.substring(seq, F.lit(1), place - 1), base, F.substring(seq, place + 1, F.length(seq)))


def neighbours(seq) -> Column:
    """Array of all sequences one substitution away, over A, C, G, T and N."""
    seq = col(seq)
    places = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq))).otherwise(F.array().cast("array<int>"))
    each = F.transform(places, lambda p: F.transform(F.array(*map(F.lit, BASES)), lambda b: substituted(seq, p, b)))
    return F.filter(F.flatten(each), lambda s: s != seq)


def blanked(seq, blanks: int) -> Column:
    """Array of (at, text): the sequence with each choice of so many places taken by a star, and the places, from 1. Of shorter sequences, all places."""
    masks = F.array(F.struct(F.array().cast("array<int>").alias("at"), F.col(seq).alias("text")))
    last = lambda m: F.coalesce(F.try_element_at(m["at"], F.lit(-1)), F.lit(0))
    put = lambda m, i: F.struct(F.array_append(m["at"], i).alias("at"), F.overlay(m["text"], F.lit("*"), i).alias("text"))
    more = lambda m: F.when(last(m) < F.length(m["text"]), F.transform(F.sequence(last(m) + 1, F.length(m["text"])), lambda i: put(m, i))).otherwise(F.array(m))
    for _ in range(blanks):
        masks = F.flatten(F.transform(masks, more))
    return F.when(F.col(seq).isNotNull(), masks)


def segments(seq, parts: int) -> Column:
    """Array of (number, text) of the sequence cut into so many nearly equal parts: within parts - 1 substitutions one part is equal."""
    seq = col(seq)
    n = F.length(seq)
    cut = lambda i: (n * i / parts).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("part"), F.substring(seq, cut(i) + 1, cut(i + 1) - cut(i)).alias("text")) for i in range(parts)])


def gene_of_read_id(read_id) -> Column:
    """Last of three or more parts between colons; null if empty or NONE."""
    parts = F.split(col(read_id), ":")
    last = F.trim(F.element_at(parts, -1))
    return F.when((F.size(parts) >= 3) & ~last.isin("", "NONE"), last)


def is_mito(gene) -> Column:
    return col(gene).startswith("MT-") | col(gene).startswith("mt-")


def ratio(a, b) -> Column:
    """a / b in doubles; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def choose_two(n) -> Column:
    n = col(n).cast("double")
    return n * (n - 1) / 2


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + F.coalesce(d, F.lit(0.0))))


def safe_file_name(name) -> Column:
    """Only letters, digits, dot, dash and underscore; others become underscores; no leading dots."""
    return F.regexp_replace(F.regexp_replace(col(name), r"[^A-Za-z0-9._-]", "_"), r"^\.+", "")
