"""Collocations: phrases of 2 to 5 words that stand together more often than their parts let expect.

Counts come by leading words. Words are counted; where both words of a pair are frequent, pairs are
counted; a suffix begins where two pairs in a row are frequent, and ends before a pair that is not.
Suffixes are added up in each task and routed by their leading words, those of one route and task in
one row, and the pointers to those of a partition are split by a multikey three-way quicksort: a part whose words are equal to some depth is
a phrase, and its size the count. Parts with too few suffixes are left where they stand.

Frequent words and pairs reach the tasks as bit filters of at most 64 MB. What these let through by
chance is counted in full, too, and found infrequent.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import bit_filter, in_filter, join_hot, materialize, slices
from helixframe.llm.jaccard import M1, mixed

LONGEST = 5
# Fixed: the bytes that end a piece of text.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
#: What a task keeps before it sends: words, and pairs or suffixes.
KEPT_WORDS, KEPT_KEYS = 1_000_000, 1 << 21
#: Suffixes in a routed partition, about; routes with more are dealt to several, by what follows the leading words.
PARTITION, SALTS = 500_000, 16
#: Suffixes in a row, at most.
IN_ROW = 50_000
#: Bits of a task's own number of a word (KEPT_WORDS fits).
BITS = 21
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text that has some."""
    return [words for piece in (text or "").encode().lower().translate(ENDS).split(b"\n") if (words := piece.split())]


def languages(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def word_id(lang: str, word: bytes, seed: int) -> int:
    """64 bits, signed, of a word in a language."""
    x = xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word, seed)
    return x - (x >> 63 << 64)


def word_counts(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, n) of all words."""

    def run(batches):
        counts: dict[tuple[str, bytes], int] = {}

        def sent():
            keys = list(counts)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1].decode() for k in keys], pa.string()), pa.array([word_id(*k, seed) for k in keys], pa.int64()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "id", "n"])

        for batch in slices(batches, 1024):
            by_lang: dict[str, dict[bytes, int]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = by_lang.setdefault(lang, {})
                for words in pieces(text):
                    for w in words:
                        own[w] = own.get(w, 0) + 1
            for lang, own in by_lang.items():
                for w, n in own.items():
                    counts[lang, w] = counts.get((lang, w), 0) + n
            if len(counts) > KEPT_WORDS:
                yield sent()
        if counts:
            yield sent()

    return rows.mapInArrow(run, "lang string, word string, id long, n long").groupBy("lang", "word").agg(F.first("id").alias("id"), F.sum("n").alias("n"))


class Numbered(dict):
    """A task's own numbers, from 1, of the words of a language that pass the filter; 0 for others."""

    def __init__(self, lang: str, seed: int, bits: np.ndarray, ids: list[int]):
        super().__init__()
        self.lang, self.seed, self.bits, self.ids, self.mask = lang, seed, bits, ids, 8 * len(bits) - 1

    def __missing__(self, word: bytes) -> int:
        i = word_id(self.lang, word, self.seed)
        place = i & self.mask
        number = 0
        if self.bits[place >> 3] >> (place & 7) & 1:
            number = len(self.ids)
            self.ids.append(i)
        self[word] = number
        return number


def frequent_runs(batches, seed: int, bits: np.ndarray):
    """For slices of the rows: (numbers of their words in order, 0 between pieces and for infrequent words; ids by number; whether numbers begin anew after this)."""
    view = memoryview(bits)
    known: dict[str, Numbered] = {}
    ids: list[int] = [0]
    for batch in slices(batches, 1024):
        out: list[int] = []
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = known.get(lang)
            if own is None:
                own = known[lang] = Numbered(lang, seed, view, ids)
            for words in pieces(text):
                out += map(own.__getitem__, words)
                out.append(0)
        last = sum(map(len, known.values())) > KEPT_WORDS
        yield np.array(out, dtype=np.int64), np.array(ids, dtype=np.int64), last
        if last:
            known, ids = {}, [0]


def pair_id(a, b):
    """64 bits of a pair of word ids, as a column or in numpy."""
    if isinstance(a, Column):
        return a.bitwiseXOR(F.shiftleft(b, 23).bitwiseOR(F.shiftrightunsigned(b, 41)))
    a, b = a.view(np.uint64), b.view(np.uint64)
    return a ^ (b << np.uint64(23) | b >> np.uint64(41))


class Sums:
    """Keys (rows of longs) and how often each was added; full when there are too many to keep."""

    def __init__(self, width: int):
        self.width, self.raw, self.n_raw = width, [], 0
        self.keys, self.counts = np.zeros((0, width), dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.n_raw += len(keys)
        if self.n_raw > KEPT_KEYS:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *self.raw])
        weights = np.concatenate([self.counts, np.ones(self.n_raw, dtype=np.int64)])
        order = np.lexsort(keys.T[::-1])
        keys, weights = keys[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, dtype=np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(weights, first) if len(first) else weights
        self.raw, self.n_raw = [], 0

    def full(self) -> bool:
        return len(self.keys) > KEPT_KEYS

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.counts
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out


def sums_of(rows: DataFrame, seed: int, bits, width: int, keys_of, batch_of, kind: str) -> DataFrame:
    """In each task, keys_of(numbers, ids) are added up, and batch_of(keys, counts, ids) makes rows of them."""

    def run(batches):
        sums, ids = Sums(width), np.zeros(1, dtype=np.int64)
        for numbers, ids, last in frequent_runs(batches, seed, bits.value):
            sums.add(keys_of(numbers, ids))
            if last or sums.full():
                yield batch_of(*sums.taken(), ids)
        yield batch_of(*sums.taken(), ids)

    return rows.mapInArrow(run, kind)


LOW = (1 << BITS) - 1


def pair_counts(rows: DataFrame, seed: int, bits) -> DataFrame:
    """(w1, w2, n) of neighbouring words that pass the filter."""

    def keys_of(numbers, _):
        a, b = numbers[:-1], numbers[1:]
        return (a << BITS | b)[(a > 0) & (b > 0)].reshape(-1, 1)

    def batch_of(keys, counts, ids):
        return pa.RecordBatch.from_arrays([pa.array(ids[keys[:, 0] >> BITS]), pa.array(ids[keys[:, 0] & LOW]), pa.array(counts)], names=["w1", "w2", "n"])

    return sums_of(rows, seed, bits, 1, keys_of, batch_of, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def routed_suffixes(rows: DataFrame, seed: int, bits, pair_bits, routes: int) -> DataFrame:
    """(route, salt, size, w1, .., w5, n) of suffixes of three words or more, 0 after their ends, as arrays: suffixes of a task with one route and salt are a row, or some.

    A route follows from the first three words, a salt from the others.
    """

    def keys_of(numbers, ids):
        words = np.concatenate([numbers, np.zeros(LONGEST, dtype=np.int64)])
        a, b = words[:-1], words[1:]
        ok = (a > 0) & (b > 0)
        ok[ok] = in_filter(pair_bits.value, pair_id(ids[a[ok]], ids[b[ok]]))
        n = len(numbers)
        at = np.flatnonzero(ok[:n] & ok[1 : n + 1])
        goes_on = ok[at + 2]
        fourth = np.where(goes_on, words[at + 3], 0)
        fifth = np.where(goes_on & ok[at + 3], words[at + 4], 0)
        return np.stack([words[at] << 2 * BITS | words[at + 1] << BITS | words[at + 2], fourth << BITS | fifth], axis=1)

    def batch_of(keys, counts, ids):
        local = (keys[:, 0] >> 2 * BITS, keys[:, 0] >> BITS & LOW, keys[:, 0] & LOW, keys[:, 1] >> BITS, keys[:, 1] & LOW)
        words = [ids[c] for c in local]
        route = hashed(words[:3]) % np.uint64(routes)
        place = (route * np.uint64(SALTS) + hashed(words[3:]) % np.uint64(SALTS)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        inside = np.arange(len(place)) - np.repeat(first, np.diff(first, append=len(place)))
        starts = np.flatnonzero(inside % IN_ROW == 0)
        bounds = pa.array(np.append(starts, len(place)), pa.int32())
        columns = [pa.ListArray.from_arrays(bounds, pa.array(c[order])) for c in [*words, counts]]
        sizes = np.diff(np.append(starts, len(place)))
        return pa.RecordBatch.from_arrays([pa.array(place[starts] // SALTS), pa.array(place[starts] % SALTS), pa.array(sizes), *columns], names=["route", "salt", "size", *WORDS, "n"])

    kind = ", ".join(["route long, salt long, size long", *[f"{c} array<long>" for c in [*WORDS, "n"]]])
    return sums_of(rows, seed, bits, 2, keys_of, batch_of, kind)


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        total = mixed(total * M1 + c.view(np.uint64))
    return total


def equal_parts(columns: list[np.ndarray], weights: np.ndarray, least: int, partial: bool = False) -> list[tuple[int, int, int]]:
    """(pointer, depth, size) of each part of suffixes with equal words to a depth of 3 and more and a size of at least `least`.

    Multikey three-way quicksort: pointers are split by the word at a depth into less, equal and more;
    equal ones go on at the next depth, and parts below `least` are abandoned. partial: other tasks
    have suffixes with the same words too, so sizes count from 1 except at full depth.
    """
    out, parts = [], [(np.arange(len(weights)), 0)]
    while parts:
        pointers, depth = parts.pop()
        enough = least if not partial or depth + 1 == LONGEST else 1
        if not len(pointers) or weights[pointers].sum() < enough:
            continue
        words = columns[depth][pointers]
        pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
        equal = pointers[words == pivot]
        if len(equal) < len(pointers):
            parts += [(pointers[words < pivot], depth), (pointers[words > pivot], depth)]
        size = int(weights[equal].sum())
        if pivot != 0 and size >= enough:  # 0: the suffixes have ended
            if depth >= 2:
                out.append((int(equal[0]), depth + 1, size))
            if depth + 1 < LONGEST:
                parts.append((equal, depth + 1))
    return out


def phrase_counts(suffixes: DataFrame, least: int) -> DataFrame:
    """(ids, a) of the phrases of three to five words found at least so often, from materialized routed_suffixes().

    A route with more than twice PARTITION suffixes goes to a task for each salt; counts of its phrases
    of three and four words are added up after.
    """
    sizes = suffixes.groupBy("route").agg(F.sum("size").alias("total"))  # as many rows as there are routes
    dealt = suffixes.join(sizes, "route").withColumn("partial", F.col("total") > 2 * PARTITION)
    dealt = dealt.withColumn("salt", F.when(F.col("partial"), F.col("salt")).otherwise(F.lit(-1).cast("long")))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flat = lambda c: table[c].combine_chunks().flatten().to_numpy()
        columns = [flat(c) for c in WORDS]
        found = equal_parts(columns, flat("n"), least, key[1].as_py() >= 0)
        ids = [[int(c[at]) for c in columns[:depth]] for at, depth, _ in found]
        return pa.table({"ids": pa.array(ids, pa.list_(pa.int64())), "a": pa.array([size for _, _, size in found], pa.int64())})

    counted = dealt.groupBy("route", "salt").applyInArrow(run, "ids array<long>, a long")
    return counted.groupBy("ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def looked_up(rows: DataFrame, key: str, known: DataFrame, deal_by: list[str]) -> DataFrame:
    """rows with the columns of known, which has a row for each key; keys that many rows hold are no hot tasks."""
    uses = rows.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    return join_hot(rows, materialize(known.join(uses, key)), [key], "uses", deal_by).drop("uses")


def undominated(phrases: DataFrame, share: int) -> DataFrame:
    """Phrases (ids, a) but for those inside a longer one with share % of their count.

    A longer phrase is at most as frequent as any part, so one with a word more shows it.
    """
    size = F.size("ids")
    inner = phrases.where(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "a")
    most = inner.groupBy("ids").agg(F.max("a").alias("most"))
    joined = phrases.join(most, "ids", "left")
    return joined.where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(share) * F.col("a"))).select("ids", "a")


def cut_counts(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ids, a, k, l, r): each cut of each phrase after k words, with the counts of both sides."""
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.slice("ids", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), F.slice("ids", F.col("k") + 1, F.lit(LONGEST)).alias("part")))
    rows = cuts.select("ids", "a", "k", F.explode(sides).alias("s")).select("ids", "a", "k", "s.side", "s.part")
    found = looked_up(rows, "part", sizes, ["ids", "k"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    return found.groupBy("ids", "a", "k").agg(of(0).alias("l"), of(1).alias("r"))


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exact: products are decimals of 38 digits, and the quotient is that of whole numbers."""
    whole = lambda c: c.cast("decimal(19,0)")
    x, y = F.lit(1000).cast("decimal(4,0)") * (whole(a) * whole(n)).cast("decimal(34,0)"), (whole(left) * whole(right)).cast("decimal(38,0)")
    return F.call_function("div", x, y)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    Texts are lower-cased (A-Z), cut at . , ; : ! ? and line ends, and the pieces into words at blanks
    and tabs. A phrase is two to five words of a piece that stand there at least `least` times in the
    language (a). Its score is the lowest over its cuts in two, floor(1000 * a * n / (l * r)): l and r
    are the counts of both sides, n all words of the language; of equal ones the first cut. Phrases
    inside a longer one that has share % of their count are left out. Order: score, a, both descending,
    then the phrase by its UTF-8 bytes.

    Null and empty texts have no words; a null language is und; texts and words may have any length.
    Repeated rows each count. An empty table gives an empty one; other columns of docs are not read.
    """
    context, rows = docs.sparkSession.sparkContext, languages(docs, text_col, lang_col)
    for seed in range(8):
        words = materialize(word_counts(rows, seed))
        shared = words.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).where(f"words > 1 and n >= {least}")
        if not shared.limit(1).count():  # each frequent word has an id of its own
            break
    else:
        raise RuntimeError("word ids collide with each of eight seeds")
    frequent = materialize(words.where(F.col("n") >= least))
    bits = context.broadcast(bit_filter(frequent.select("id")))
    pairs = materialize(pair_counts(rows, seed, bits).where(F.col("n") >= least))
    pair_bits = context.broadcast(bit_filter(pairs.select(pair_id(F.col("w1"), F.col("w2")).alias("id"))))
    most = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # suffixes, at most
    routes = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // PARTITION))
    longer = phrase_counts(materialize(routed_suffixes(rows, seed, bits, pair_bits, routes)), least)
    phrases = materialize(pairs.select(F.array("w1", "w2").alias("ids"), F.col("n").alias("a")).unionByName(longer))

    kept = materialize(undominated(phrases, share))
    sizes = frequent.select(F.array("id").alias("part"), F.col("n").alias("f")).unionByName(phrases.select(F.col("ids").alias("part"), F.col("a").alias("f")))
    cuts = materialize(cut_counts(kept, sizes))
    spelled = looked_up(kept.select("ids", F.posexplode("ids").alias("at", "id")), "id", frequent.select("id", "lang", "word"), ["ids"])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(ordered, " ").alias("phrase"))
    named = cuts.join(spelled, "ids")
    named = looked_up(named, "lang", words.groupBy("lang").agg(F.sum("n").alias("n")), ["ids"])
    named = named.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = named.groupBy("ids", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    first = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
