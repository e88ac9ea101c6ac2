"""Quality rules: simple counts of a text, and character n-gram perplexity within bands of its language.

The language model is modified Kneser-Ney over 4-grams of characters, one model per language. Spark
counts the 4-grams of all documents (each task sends sums), derives the continuation counts and
discounts of all orders, and prices each 4-gram that the documents have by joins. N-grams are kept
whole, 21 bits a character, so tables have a row for each and grow with the corpus. Costs are stored in
arrays sorted by hash, with the whole 4-gram beside each hash. A table of at most FEW_GRAMS rows is
broadcast; a larger one is joined to the distinct 4-grams of blocks of texts, and each block is
measured with its own part.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import join_hot, materialize, slices

ORDER = 4
#: Before a text's first character.
START = 2
#: Bits of a character in an n-gram.
WIDE = 21
#: Characters that there may be, for a language without a model.
ALL_CHARACTERS = 0x110000
#: A table of so many priced 4-grams is broadcast; with a larger one, blocks have so many bytes of text.
FEW_GRAMS, BLOCK_BYTES = 4_000_000, 1 << 24
MIX, MIX_LEAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 5

BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """The numbers named in BASE_FIELDS."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space
    lines = [line for line in raw.split(b"\n") if line.strip()]
    blanks = sum(map(text.count, BLANKS))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen) + 1) for w in words], dtype=np.uint64)
    n = len(words) - WINDOW + 1
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0xD6E8FEB86659FD93) + ids[k : k + n]
    _, first, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[first] > 1)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all 4-grams of the texts the first character and the other three, WIDE bits each, and the place where each text's begin."""
    start = chr(START) * (ORDER - 1)
    codes = np.frombuffer("".join([start + t for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if len(codes) < ORDER:
        return codes[:0], codes[:0], np.zeros(len(texts), dtype=np.int64)
    last = codes[1:-2] << 2 * WIDE | codes[2:-1] << WIDE | codes[3:]
    begins = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]])
    inside = np.ones(len(last), dtype=bool)  # without the windows that reach over a text's end
    for k in range(ORDER - 1):
        over = begins[1:] - 1 - k
        inside[over[over >= 0]] = False
    return codes[:-3][inside], last[inside], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def counted_grams(batches, block: bool):
    """Rows ([block,] model, first, gram, n) of batches ([block,] model, text)."""
    for batch in slices(batches, 4096):
        groups: dict = {}
        keys = zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True)
        for key, text in zip(keys, batch.columns[-1].to_pylist(), strict=True):
            groups.setdefault(key, []).append(text or "")
        for key, texts in groups.items():
            first, gram, _ = grams_of(texts)
            found = pa.table({"first": first, "gram": gram}).group_by(["first", "gram"], use_threads=False).aggregate([([], "count_all")])
            same = [pa.array([k] * len(found), pa.int64() if block and i == 0 else pa.string()) for i, k in enumerate(key)]
            columns = [found[c].combine_chunks() for c in ("first", "gram", "count_all")]
            yield pa.RecordBatch.from_arrays([*same, *columns], names=[*(["block"] if block else []), "model", "first", "gram", "n"])


def count_grams(docs: DataFrame, model: Column, text_col: str) -> DataFrame:
    """(model, first, gram, n) over all texts; first is the 4-gram's first character and gram has the other three."""
    parts = docs.select(model, text_col).mapInArrow(lambda batches: counted_grams(batches, False), "model string, first long, gram long, n long")
    return parts.groupBy("model", "first", "gram").agg(F.sum("n").alias("n"))


def suffix(order: int) -> Column:
    """An n-gram without its first character."""
    return F.col("gram").bitwiseAND(F.lit((1 << WIDE * (order - 1)) - 1))


def context() -> Column:
    """An n-gram without its last character."""
    return F.shiftleft("first", 2 * WIDE).bitwiseOR(F.shiftrightunsigned("gram", WIDE))


def discounts(grams: DataFrame) -> DataFrame:
    """(model, grams, d1, d2, d3) of one order, from its counts of counts."""
    of = [F.count_if(F.col("n") == k).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)]
    y = F.coalesce(F.try_divide(F.col("c1"), F.col("c1") + 2 * F.col("c2")), F.lit(0.5))
    d = lambda k: F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"c{k + 1}"), F.col(f"c{k}")), F.lit(k - 0.5)))).alias(f"d{k}")
    return grams.groupBy("model").agg(*of, F.count(F.lit(1)).alias("grams")).select("model", "grams", d(1), d(2), d(3))


def train(docs: DataFrame, model: Column, text_col: str) -> dict:
    """The models' tables: (model, first, gram, n) by order, n counting occurrences or, below ORDER, different characters before; ("part", n) and ("gamma", n).

    part is an n-gram's share of the probability before backing off, gamma its context's weight for
    backing off. characters has the number of each model's characters and one for the unseen ones.
    """
    tables: dict = {ORDER: materialize(count_grams(docs, model, text_col))}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = materialize(tables[n + 1].groupBy("model", suffix(n + 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")).select("model", F.lit(0).cast("long").alias("first"), "gram", "n"))
    tables["characters"] = materialize(tables[1].groupBy("model").agg((F.count(F.lit(1)) + 1).alias("characters")))
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    for n in range(1, ORDER + 1):
        rows = join_hot(tables[n], materialize(discounts(tables[n])), ["model"], "grams", ["gram"]).withColumn("cut", cut).withColumn("context", context())
        contexts = rows.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spared"))
        contexts = materialize(contexts.select("model", "context", "total", (F.col("spared") / F.col("total")).alias("gamma")))
        tables["gamma", n] = contexts.select("model", "context", "gamma")
        tables["part", n] = rows.join(contexts, ["model", "context"]).select("model", "first", "gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("part"))
    return tables


def priced(wanted: DataFrame, tables: dict) -> DataFrame:
    """(model, first, gram, cost) of distinct 4-grams (model, first, gram): bits, interpolated down to a uniform share for unseen characters.

    A model that has no text gives each character an equal share of all that there may be.
    """
    by_order = {ORDER: wanted}
    for n in range(ORDER - 1, 0, -1):
        by_order[n] = by_order[n + 1].select("model", F.lit(0).cast("long").alias("first"), suffix(n + 1).alias("gram")).distinct()
    known = tables["characters"]
    p = F.coalesce("part", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.coalesce("lower", F.lit(1 / ALL_CHARACTERS))
    for n in range(1, ORDER + 1):
        rows = by_order[n].withColumn("context", context()).withColumn("suffix", suffix(n))
        if n == 1:
            rows = join_hot(rows, known, ["model"], "characters", ["gram"], "left").withColumn("lower", 1 / F.col("characters"))
        else:
            rows = rows.join(known, ["model", "suffix"], "left")
        rows = rows.join(tables["part", n], ["model", "first", "gram"], "left").join(tables["gamma", n], ["model", "context"], "left")
        rows = materialize(rows.select("model", "first", "gram", p.alias("p")))
        known = rows.select("model", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return rows.select("model", "first", "gram", (-F.log2("p")).cast("float").alias("cost"))


def gram_hash(first: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The place of a 4-gram in a sorted array: 63 bits, so that Spark sorts them alike."""
    mixed = gram.view(np.uint64) * MIX ^ first.astype(np.uint64) * MIX_LEAD
    mixed ^= mixed >> np.uint64(29)
    return (mixed * MIX_LEAD >> np.uint64(1)).astype(np.int64)


def sorted_by_hash(prices: DataFrame) -> DataFrame:
    """prices (model, first, gram, cost) with hash, in ranges of (model, hash) and sorted in each: parts of one sorted array for each model."""

    def run(batches):
        for batch in batches:
            hashes = gram_hash(batch["first"].to_numpy(), batch["gram"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes)], names=[*batch.schema.names, "hash"])

    hashed = prices.mapInArrow(run, T.StructType([*prices.schema.fields, T.StructField("hash", T.LongType())]))
    return materialize(hashed.repartitionByRange("model", "hash").sortWithinPartitions("model", "hash"))


class SortedHashes:
    """A model's costs in the order of their hashes, each beside its whole 4-gram.

    A hash is looked up in its stretch of the array: stretches are as many as entries or up to twice
    so many, by the high bits, so one has an entry or two.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, gram: np.ndarray, cost: np.ndarray):
        self.hashes, self.first, self.gram, self.cost = hashes, first, gram, cost
        bits = max(1, len(hashes).bit_length())
        self.shift = 63 - bits
        self.stretch = np.searchsorted(hashes, np.arange(1 << bits) << self.shift).astype(np.int32)

    def of(self, first: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """The cost of each 4-gram."""
        wanted = gram_hash(first, gram)
        at = self.stretch[wanted >> self.shift]
        last = len(self.hashes) - 1
        left = np.arange(len(at))
        while len(left):
            here = np.minimum(at[left], last)
            if (at[left] > last).any() or (self.hashes[here] > wanted[left]).any():
                raise RuntimeError("a text has a 4-gram that was not counted; the documents must be the same each time they are read")
            left = left[(self.first[here] != first[left]) | (self.gram[here] != gram[left])]
            at[left] += 1
        return self.cost[at]


class Costs:
    """Costs in bits by model and 4-gram, from a table as sorted_by_hash() has it; parts may come in any order."""

    def __init__(self, table: pa.Table):
        models = table["model"].combine_chunks().dictionary_encode()
        of, columns = models.indices.to_numpy(), [table[c].to_numpy() for c in ("hash", "first", "gram", "cost")]
        self.models = {}
        for i, model in enumerate(models.dictionary.to_pylist()):
            own = [c[of == i] for c in columns]
            if (own[0][1:] < own[0][:-1]).any():  # parts out of order
                order = np.argsort(own[0], kind="stable")
                own = [c[order] for c in own]
            self.models[model] = SortedHashes(*own)

    def of(self, models: list[str], texts: list[str]) -> np.ndarray:
        """Bits of each text."""
        out, models = np.zeros(len(texts)), np.array(models, dtype=object)
        for model in set(models.tolist()):
            at = np.flatnonzero(models == model)
            sizes = np.array([len(texts[i]) for i in at], dtype=np.int64)
            at, sizes = at[sizes > 0], sizes[sizes > 0]
            if not len(at):
                continue
            if model not in self.models:
                raise RuntimeError("a text has a 4-gram that was not counted; the documents must be the same each time they are read")
            first, gram, begins = grams_of([texts[i] for i in at])
            out[at] = np.add.reduceat(self.models[model].of(first, gram).astype(np.float64), begins)
        return out


class Scorer:
    """Prices single texts by trained tables."""

    def __init__(self, tables: dict):
        self.tables = tables

    def costs(self, models: list[str], texts: list[str]) -> np.ndarray:
        """Bits of each text."""
        rows = self.tables[ORDER].sparkSession.createDataFrame(list(zip(models, texts, strict=True)), "model string, text string")
        wanted = count_grams(rows, F.col("model"), "text").select("model", "first", "gram")
        return Costs(sorted_by_hash(priced(wanted, self.tables)).toArrow()).of(models, texts)


def numbered_blocks(rows: DataFrame) -> DataFrame:
    """rows with block: within a partition, rows in their order, about BLOCK_BYTES each."""

    def run(batches):
        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, 1024, 1 << 21):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, number))], names=[*batch.schema.names, "block"])
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                number, size = number + 1, 0

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())]))


def measure(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """(doc, lang, the counts, n_chars, bits) of each row (doc, lang, model, text)."""
    longs = [*BASE_FIELDS, "n_chars"]
    schema = T.StructType([*rows.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("bits", T.DoubleType())])

    def measured(batches, costs: Costs):
        for batch in slices(batches, 1024, 1 << 21):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            counts = np.array([(*text_counts(t), len(t)) for t in texts], dtype=np.int64).reshape(-1, len(longs))
            bits = costs.of(batch.column(2).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c) for c in counts.T], pa.array(bits)], names=[f.name for f in schema])

    if prices.count() <= FEW_GRAMS:
        table = prices.toArrow().combine_chunks()
        shared = rows.sparkSession.sparkContext.broadcast(table)
        return rows.mapInArrow(lambda batches: measured(batches, Costs(shared.value)), schema)

    blocks = materialize(numbered_blocks(rows))
    parts = blocks.select("block", "model", "text").mapInArrow(lambda batches: counted_grams(batches, True), "block long, model string, first long, gram long, n long")
    own = parts.select("block", "model", "first", "gram").distinct().join(prices, ["model", "first", "gram"])

    def measure_block(texts: pa.Table, part: pa.Table) -> pa.Table:
        found = list(measured(texts.to_batches(), Costs(part)))
        return pa.Table.from_batches(found)

    return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(measure_block, schema)


def judge(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", width: float = 3.5, least_spread: float = 0.05, short: int = 300, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """One row per row of docs: doc, lang, the counts, n_chars, bits_per_char, low, high, base_failed, kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent % of them in repeated
    windows of five. kept: not that, and the text's bits per character (the log of its perplexity)
    within low..high, which are the median of its language less and plus width times the median
    deviation (at least least_spread), wider for texts of few characters by sqrt(1 + short / n_chars).
    A hash deals the texts out to two halves, copies to the same one, and each half is scored by the
    model of the other, so that no text is known from itself; all documents set the bands. Where the
    other half has no text of a language, all characters cost the same. Null texts are empty and fail;
    null languages are one language, and an empty text fails. Repeated rows give a row each; texts are
    read whole, however long; an empty table gives an empty one. Other columns of docs are not read.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    fold = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(2)).cast("string")
    texts = docs.select(F.col(id_col).alias("doc"), lang.alias("lang"), F.concat(fold, lang).alias("model"), F.col(text_col).alias("text"))
    tables = train(texts, F.col("model"), "text")
    other = F.overlay("model", F.translate(F.substring("model", 1, 1), "01", "10"), F.lit(1))
    prices = sorted_by_hash(priced(tables[ORDER].select(other.alias("model"), "first", "gram"), tables))
    rows = materialize(measure(texts.withColumn("model", other), prices)).withColumn("bits_per_char", F.try_divide(F.col("bits"), F.col("n_chars")))
    full = rows.where(F.col("n_chars") > 0)
    middle = materialize(full.groupBy("lang").agg(F.percentile_approx("bits_per_char", 0.5, 10000).alias("middle"), F.count(F.lit(1)).alias("docs")))
    off = join_hot(full, middle, ["lang"], "docs", ["doc"]).withColumn("off", F.abs(F.col("bits_per_char") - F.col("middle")))
    bands = materialize(off.groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx("off", 0.5, 10000).alias("spread"), F.count(F.lit(1)).alias("docs")))
    wide = width * F.greatest(F.col("spread"), F.lit(least_spread)) * F.sqrt(1 + short / F.greatest(F.col("n_chars"), F.lit(1)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    banded = join_hot(rows, bands, ["lang"], "docs", ["doc"], "left").withColumn("low", F.col("middle") - wide).withColumn("high", F.col("middle") + wide).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.coalesce(F.col("bits_per_char").between(F.col("low"), F.col("high")), F.lit(False))
    return banded.withColumn("kept", kept).select("doc", "lang", *BASE_FIELDS, "n_chars", "bits_per_char", "low", "high", "base_failed", "kept")
