"""Exact Jaccard join of word shingle sets, by T-occurrence search.

1. Equal sets become one set, by a hash of the whole set: 64 bits of 128, and the other 64 for the few
   sets whose first ones collide.
2. A lossless partition brings similar sets together. Sets of like size are cut at the same places of
   the hash range into more segments than two similar sets can differ in, so they have a whole
   segment in common; its digest is the key of an inverted list of sets. Passages that many documents
   share do not make long lists, since the rest of a segment differs.
3. In blocks of such lists, the T-occurrence search finds, for each query, all sets that share at
   least T shingles: inverted lists of the block's shingles are divided into the longest, which are
   probed, and the others, which are heap-merged and must alone bring T less the number of long lists.
   In the first round the queries are the lists' least sets; then those lists that still hold more
   than one component are searched in full, with all but their largest component as queries. Before
   a block's shingles are sent, bitmaps of their parities rule out sets that differ too much.
4. Components of the links; one row per document.

Lists and blocks of any length are cut into chunks, so no task holds a large group of copies; links
inside a block are reduced to a spanning forest, so a group never gives all its pairs. A task sends one
set of each list on, the list's head there, and ties the others it reads to it; joins on lists and sets
broadcast the most frequent keys.
"""

import heapq
import math
from collections.abc import Callable
from functools import lru_cache, partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import bit_filter, in_filter, join_hot, materialize, slices
from helixframe.llm.components import components

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BLOCK = 2000
#: Shingles of a set of usual size: blocks with shingles have at most about BLOCK times so many.
SHINGLES = 300
PARITIES = 1024
#: Lists that a task has found to be long, at most; then it starts anew.
KEPT_LISTS = 1_000_000
#: Short lists with more entries are merged by a stable sort, which merges sorted runs, instead of a heap.
HEAP_MERGED = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


class Shingler:
    """Sorted distinct shingle hashes of texts; a word is hashed faster than its hash is found again."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.in_order(self.hashes(words_of(text))))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))

    def in_order(self, hashes: np.ndarray) -> np.ndarray:
        """The shingle at each place of a text, from the hashes of its words."""
        if not len(hashes):
            return hashes
        size = min(self.words, len(hashes))
        total = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total *= M1
            total += hashes[k : k + len(total)]
            for shift, factor in ((30, M2), (27, M3), (31, None)):  # mixed(), in place
                total ^= total >> np.uint64(shift)
                if factor is not None:
                    total *= factor
        return total


def halves(digest: int) -> tuple[int, int]:
    """The low and the high 64 bits of 128, signed."""
    low, high = np.array([digest & 0xFFFFFFFFFFFFFFFF, digest >> 64], dtype=np.uint64).view(np.int64).tolist()
    return low, high


def set_digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_128_intdigest(shingles.tobytes())


def set_id(shingles: np.ndarray, doubled: frozenset[int]) -> int | None:
    """The set's number: the low bits of its digest, the high ones where other sets share the low ones; null for the empty set."""
    if not len(shingles):
        return None
    low, high = halves(set_digest(shingles))
    return high if low in doubled else low


def text_digest(text: str | None) -> int:
    return xxhash.xxh3_128_intdigest((text or "").encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=4)
def size_levels(num: int, den: int, most: int) -> tuple[tuple[int, int, int], ...]:
    """(least size, segments, spare) of each level up to size most.

    Two similar sets are on one level or on neighbouring ones; each set is cut for its own level and
    the next, so both are cut for the higher. There they differ in at most segments - 1 - spare
    elements. spare is for segments that are empty in both.
    """
    levels, low, before = [], 1, 1
    while low <= most:
        top = max(low, (low - 1) * den // num) if low > 1 else max(1, den // num)
        differ = 2 * top * (den - num) // (den + num)
        empty = (differ + 1) * math.exp(-before / (differ + 1))
        spare = 0 if not differ else 2 + math.ceil(2 * empty)
        levels.append((low, differ + 1 + spare, spare))
        low, before = top + 1, low
    return tuple(levels)


def signatures(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Digests of the segments of one set, on its level and the next."""
    n = len(shingles)
    levels = size_levels(num, den, 1 << max(8, (2 * n).bit_length() + 1))
    own = np.searchsorted([low for low, _, _ in levels], n, side="right") - 1
    values, found = mixed(shingles ^ M1), []
    for level in (own, own + 1):
        _, segments, spare = levels[level]
        if segments == 1:  # only equal sets are similar
            continue
        cuts = np.array([(i << 64) // segments for i in range(segments)], dtype=np.uint64)
        starts = np.searchsorted(shingles, cuts)
        ends = np.append(starts[1:], n)
        full = ends > starts
        sums = np.zeros(segments, dtype=np.uint64)
        sums[full] = np.add.reduceat(values, starts[full])
        places = mixed(np.arange(segments, dtype=np.uint64) + np.uint64(level << 32))
        digests = mixed(sums * M3 + places)
        found.append(digests if np.count_nonzero(~full) > spare else digests[full])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


class Heads:
    """For each list, the first set that this task has read of it: by slice for all lists, by task for those that have had two."""

    def __init__(self):
        self.known: dict[int, int] = {}

    def __call__(self, sigs: np.ndarray, sids: np.ndarray) -> np.ndarray:
        """The head of each row's list; sigs and sids stand for rows of several sets."""
        values, first, at, counts = np.unique(sigs, return_index=True, return_inverse=True, return_counts=True)
        heads = sids[first]
        if self.known:
            old = np.fromiter((self.known.get(x, 0) for x in values.tolist()), dtype=np.int64, count=len(values))
            heads = np.where(old != 0, old, heads)
        more = np.flatnonzero(counts > 1)
        if len(self.known) + len(more) > KEPT_LISTS:
            self.known.clear()
        self.known.update(zip(values[more].tolist(), heads[more].tolist(), strict=True))
        return heads[at]


class SetColumns:
    """The columns n, low, high, tid, bits, sigs and heads of texts and their sets, without sign the first five (OWN); remembers what this task has given.

    n: set size; low, high: the set's hash, null for the empty set; tid: half of the text's; bits:
    parities; sigs: what sign makes of the shingles, keys (uint64) of lists in which similar sets meet,
    which a task gives once for equal sets; heads: low of the head of each one's list.
    """

    LONGS, OWN = ("n", "low", "high", "tid"), 5
    ARROW = [*[(c, pa.int64()) for c in LONGS], ("bits", pa.binary()), ("sigs", pa.list_(pa.int64())), ("heads", pa.list_(pa.int64()))]
    SPARK = [*[T.StructField(c, T.LongType()) for c in LONGS], T.StructField("bits", T.BinaryType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("sigs", "heads")]]

    def __init__(self, sign: Callable[[np.ndarray], np.ndarray] | None = None):
        self.sign, self.given, self.heads_of = sign, set(), Heads()

    def __call__(self, texts: list[str | None], sets: list[np.ndarray]) -> list[pa.Array]:
        digests = [set_digest(s) if len(s) else None for s in sets]
        lows, highs = zip(*[(None, None) if d is None else halves(d) for d in digests], strict=True)
        columns = [[len(s) for s in sets], lows, highs, [halves(text_digest(t))[0] for t in texts]]
        own = [*[pa.array(c, pa.int64()) for c in columns], pa.array(map(parities, sets), pa.binary())]
        if self.sign is None:
            return own
        found = []
        for shingles, digest in zip(sets, digests, strict=True):
            new = digest is not None and digest not in self.given
            if new:
                self.given.add(digest)
            found.append(self.sign(shingles).view(np.int64) if new else None)
        new = [i for i, f in enumerate(found) if f is not None]
        sizes = np.array([0 if f is None else len(f) for f in found])
        flat = np.concatenate([found[i] for i in new]) if new else np.zeros(0, dtype=np.int64)
        heads = self.heads_of(flat, np.repeat(np.array([lows[i] or 0 for i in range(len(texts))], dtype=np.int64), sizes)) if len(flat) else flat
        offsets, empty = np.concatenate([[0], np.cumsum(sizes)]), pa.array([f is None for f in found])
        return own + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x), mask=empty) for x in (flat, heads)]


def set_rows(docs: DataFrame, id_col: str, text_col: str, words: int, sign: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc, n, low, high, tid, bits, sigs, heads) of each row, as SetColumns gives them, in one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def run(batches):
        shingler, columns_of = Shingler(words), SetColumns(sign)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            columns = columns_of(texts, [shingler(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", *[c for c, _ in SetColumns.ARROW]])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *SetColumns.SPARK]))


def collided(keyed: DataFrame) -> frozenset[int]:
    """Low halves that sets with different high ones share: of 10**11 sets some hundreds, so the driver may hold them."""
    both = keyed.where("low is not null").groupBy("low").agg(F.min("high").alias("a"), F.max("high").alias("b"))
    return frozenset(r["low"] for r in both.where("a <> b").select("low").collect())


def numbered(keyed: DataFrame, doubled: frozenset[int]) -> DataFrame:
    """keyed with sid, the number of its set."""
    if not doubled:
        return keyed.withColumn("sid", F.col("low"))
    return keyed.withColumn("sid", F.when(F.col("low").isin(*doubled), F.col("high")).otherwise(F.col("low")))


def distinct_sets(keyed: DataFrame) -> DataFrame:
    """(sid, size, bits, tid, first, docs): one row a set, by sums of each task first, so that copies make no hot key."""
    own = keyed.where("sid is not null").groupBy("sid")
    return own.agg(F.first("n").alias("size"), F.first("bits").alias("bits"), F.min("tid").alias("tid"), F.min("doc").alias("first"), F.count(F.lit(1)).alias("docs"))


def sets_of(docs: DataFrame, sets: DataFrame, sids: DataFrame, doubled: frozenset[int], text_col: str, words: int) -> DataFrame:
    """(sid, shingles) of the sids asked for: one text of each is found again by its hash, so no text is shuffled."""
    wanted = materialize(sets.join(sids, "sid", "left_semi").select(F.col("tid").alias("id")))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted))

    def run(batches):
        bits, shingler, given = shared.value, Shingler(words), set()
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            digests = [text_digest(t) for t in texts]
            hit = in_filter(bits, np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], dtype=np.uint64))
            found = []
            for i in np.flatnonzero(hit).tolist():
                if digests[i] not in given:
                    given.add(digests[i])
                    shingles = shingler(texts[i])
                    if len(shingles):
                        found.append((set_id(shingles, doubled), shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], names=["sid", "shingles"])

    rows = docs.select(text_col).mapInArrow(run, "sid long, shingles array<long>")
    return rows.join(sids, "sid", "left_semi").dropDuplicates(["sid"])


def parities(shingles: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each of so many bits: two sets differ in at least as many shingles as their parities in bits.

    A power of two of bits, at least PARITIES and the number of shingles; folded() brings two sets to the smaller one's.
    """
    bits = max(PARITIES, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Parities (sets x words) over half as many bits."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def needed(n1: int, n2: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles that sets of these sizes must share."""
    return -(-num * (n1 + n2) // (num + den))


def merge_counts(merged: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets in sorted lists of lengths `reach` that stand in one array, and how many lists have each."""
    if len(merged) > HEAP_MERGED:
        merged = np.sort(merged, kind="stable")
        starts = np.flatnonzero(np.diff(merged, prepend=-1))
        return merged[starts], np.diff(starts, append=len(merged))
    ends = np.cumsum(reach)
    entries = merged.tolist()
    runs = [(x, sum(1 for _ in same)) for x, same in groupby(heapq.merge(*[entries[e - n : e] for e, n in zip(ends.tolist(), reach.tolist(), strict=True)]))]
    return np.array([x for x, _ in runs], dtype=int), np.array([c for _, c in runs], dtype=int)


def t_occurrence(queries: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links of the queries to other sets of the block, as a spanning forest: DivideSkip over the block's inverted lists."""
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, list_of, lengths = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    postings = np.repeat(np.arange(len(sets)), sizes)[np.argsort(list_of, kind="stable")]  # within a list, sets stand in ascending order
    first = np.concatenate([[0], np.cumsum(lengths)])
    forest, links = Forest(len(sets)), []
    for q in queries:
        own = list_of[bounds[q] : bounds[q + 1]]
        own = own[lengths[own] > 1]  # other lists have the query only
        least = int(needed(int(sizes[q]), np.array([-(-num * sizes[q] // den)]), num, den)[0])
        if len(own) < least:
            continue
        by_length = own[np.argsort(-lengths[own], kind="stable")]
        # the longest lists are left for probing as long as the others can still show T less their number
        most = int(lengths[by_length[0]])
        divide = 0 if most <= 2 else min(least - 1, max(int(least / (0.0085 * math.log2(most) + 1)), int(np.count_nonzero(lengths[own] > 64))))
        long, short = np.sort(by_length[:divide]), by_length[divide:]
        reach = lengths[short]
        merged = postings[np.repeat(first[short] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())]
        found, counts = merge_counts(merged, reach)
        fit = (found != q) & (counts >= np.maximum(1, needed(int(sizes[q]), sizes[found], num, den) - len(long))) & (den * sizes[found] >= num * sizes[q]) & (den * sizes[q] >= num * sizes[found])
        for other, count in zip(found[fit].tolist(), counts[fit].tolist(), strict=True):
            if forest.top(other) == forest.top(q):
                continue
            wanted = int(needed(int(sizes[q]), np.array([sizes[other]]), num, den)[0])
            if count < wanted:  # probe the long lists for the other set, by binary search over its own lists
                theirs = list_of[bounds[other] : bounds[other + 1]]
                at = np.minimum(np.searchsorted(theirs, long), len(theirs) - 1)
                count += np.count_nonzero(theirs[at] == long)
            if count >= wanted:
                forest.join(q, other)
                links.append((q, other))
    return links


class Forest:
    """Union-find over numbers; join() tells whether two were apart."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.root[j] = i
        return i != j


def prune_block(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """(a, b) pairs that may link, as a spanning forest, and (a, null) for each query with such a pair.

        In such a pair, sizes fit, components differ, and parities differ in no more bits than similar sets may in shingles.
        """
        sids = table["sid"].to_numpy()
        queries, sizes, comps = table["query"].to_numpy(zero_copy_only=False), table["size"].to_numpy(), table["comp"].to_numpy()
        raw = table["bits"].to_pylist()
        widths = np.array([len(x) for x in raw])
        rows = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
        bits = {w: np.frombuffer(b"".join([raw[i] for i in at]), dtype=np.uint64).reshape(len(at), -1) for w, at in rows.items()}
        place = np.zeros(len(raw), dtype=int)
        for at in rows.values():
            place[at] = np.arange(len(at))
        halves = {w: folded(x) for w, x in bits.items()}
        forest, out = Forest(len(sids)), []
        for q in np.flatnonzero(queries).tolist():
            width, hits = int(widths[q]), []
            for other in (width, 2 * width, width // 2):  # similar sets are at most one step apart
                if other not in rows:
                    continue
                at = rows[other]
                fit = np.flatnonzero((comps[at] != comps[q]) & (den * sizes[at] >= num * sizes[q]) & (den * sizes[q] >= num * sizes[at]))
                mine = (halves if other < width else bits)[width][place[q]]
                theirs = (halves if other > width else bits)[other][fit]
                off = np.bitwise_count(theirs ^ mine).sum(axis=1)
                hits.append(at[fit][off <= sizes[at[fit]] + sizes[q] - 2 * needed(int(sizes[q]), sizes[at[fit]], num, den)])
            near = np.concatenate(hits)
            if len(near):
                out.append((int(sids[q]), None))
                out += [(int(sids[q]), int(sids[j])) for j in near.tolist() if forest.join(q, j)]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def search_blocks(members: DataFrame, rows: int, small: DataFrame, fetch, num: int, den: int) -> DataFrame:
    """(a, b) links among the lists of members (list, sid, query, comp), about so many rows; comp is what is known to be linked already.

    small has (sid, size, bits). Sets that may link, by pruning, are grouped anew, so that each is sent
    once however many lists it has; fetch gives the shingles of the sids that are left.
    """
    full = chunked(members, max(1, rows // BLOCK)).groupBy("block", "sid").agg(F.max("query").alias("query"), F.max("comp").alias("comp")).join(small, "sid")
    maybe = materialize(full.groupBy("block").applyInArrow(prune_block(num, den), "a long, b long"))
    groups = components(maybe.where("b is not null"))
    asking = maybe.where("b is null").select(F.col("a").alias("sid")).distinct().withColumn("query", F.lit(True))
    left = groups.select(F.col("component").alias("list"), F.col("node").alias("sid")).join(asking, "sid", "left")
    left = left.join(small.select("sid", "size"), "sid")
    left = materialize(left.select("list", "sid", F.coalesce("query", F.lit(False)).alias("query"), F.col("sid").alias("comp"), "size"))
    most = BLOCK * SHINGLES
    blocks = chunked(left, (left.agg(F.sum("size")).first()[0] or 0) // most + 1, "size", most).groupBy("block", "sid").agg(F.max("query").alias("query"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sid")
        sids = table["sid"].to_pylist()
        sets = [x.values.to_numpy().view(np.uint64) for x in table["shingles"]]
        queries = np.flatnonzero(table["query"].to_numpy(zero_copy_only=False)).tolist()
        links = t_occurrence(queries, sets, num, den)
        return pa.table({"a": pa.array([sids[a] for a, _ in links], pa.int64()), "b": pa.array([sids[b] for _, b in links], pa.int64())})

    return blocks.join(fetch(left.select("sid").distinct()), "sid").groupBy("block").applyInArrow(run, "a long, b long")


def chunked(members: DataFrame, blocks: int, weight: str | None = None, most: int | None = None) -> DataFrame:
    """(block, sid, query, comp) from (list, sid, query, comp): small lists share blocks, large ones are cut into chunks of queries by chunks of all.

    A chunk has about BLOCK rows, or `most` of the sum of the column weight.
    """
    each, most = F.lit(1) if weight is None else F.col(weight), most or BLOCK
    counts = members.groupBy("list").agg(F.sum(each).alias("m"), F.sum(F.when(F.col("query"), each).otherwise(0)).alias("q"))
    rows = join_hot(members, materialize(counts), ["list"], "m", ["sid"])
    parts = lambda n: F.ceil(F.col(n) / most).cast("int")
    rows = rows.withColumn("pd", parts("m")).withColumn("pq", parts("q"))
    chunk = lambda p, seed: F.pmod(F.xxhash64(F.lit(seed), "sid"), F.col(p)).cast("int")
    small = (F.col("pd") == 1) & (F.col("pq") == 1)
    place = lambda i, j: F.when(small, F.pmod(F.xxhash64("list"), F.lit(blocks))).otherwise(F.xxhash64("list", i, j))
    as_doc = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pq") - 1))).select(place(chunk("pd", "d"), F.col("j")).alias("block"), "sid", F.lit(False).alias("query"), "comp")
    as_query = rows.where("query").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pd") - 1))).select(place(F.col("i"), chunk("pq", "q")).alias("block"), "sid", F.lit(True).alias("query"), "comp")
    return as_doc.unionByName(as_query)


def lists_of(keyed: DataFrame) -> DataFrame:
    """(sig, sid, pivot) of the lists with two sets or more; pivot is the least of the heads in a head's row, the head in other rows."""
    rows = keyed.select("sid", F.explode(F.arrays_zip("sigs", "heads")).alias("s")).select("sid", F.col("s.sigs").alias("sig"), F.col("s.heads").alias("head"))
    tails = rows.where("head <> sid").select("sig", "sid", F.col("head").alias("pivot"))
    at = Window.partitionBy("sig")
    heads = rows.where("head = sid").select("sig", "sid", F.min("sid").over(at).alias("pivot"), F.max("sid").over(at).alias("last")).where("pivot < last").drop("last")
    of_tails = tails.select("sig", F.col("pivot").alias("sid"), "pivot")
    return heads.unionByName(tails).unionByName(of_tails).distinct()


def similar_sets(docs: DataFrame, keyed: DataFrame, sets: DataFrame, doubled: frozenset[int], text_col: str, words: int, num: int, den: int) -> DataFrame:
    """(node, component) over sids that are linked to another; keyed as set_rows() and numbered() give it, sets as distinct_sets()."""
    lists = materialize(lists_of(keyed))
    involved = lists.select("sid").distinct()
    small = materialize(sets.join(involved, "sid", "left_semi").select("sid", "size", "bits"))
    fetch = lambda sids: sets_of(docs, sets, sids, doubled, text_col, words)

    pairs = materialize(lists.where("sid <> pivot").select(F.col("pivot").alias("list"), "sid").distinct())
    stars = pairs.select("list", "sid", F.lit(False).alias("query")).unionByName(pairs.select("list", F.col("list").alias("sid"), F.lit(True).alias("query")).distinct())
    stars = stars.withColumn("comp", F.col("sid"))
    found = materialize(search_blocks(stars, pairs.count(), small, fetch, num, den))
    known = materialize(components(found))

    members = lists.select("sig", "sid").distinct()
    named = materialize(members.join(known.withColumnRenamed("node", "sid"), "sid", "left").select("sig", "sid", F.coalesce("component", "sid").alias("comp")))
    h = F.xxhash64("sid")
    open_lists = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")).where("lo < hi")
    open_lists = materialize(open_lists.groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "m"))  # lists of the same sets count once
    left = materialize(join_hot(named, open_lists, ["sig"], "m", ["sid"]).drop("m"))
    per_comp = left.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("m"))
    largest = materialize(per_comp.groupBy("sig").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.sum("m").alias("m")))
    queries = join_hot(left, largest, ["sig"], "m", ["sid"]).select(F.col("sig").alias("list"), "sid", (F.col("comp") != F.col("largest")).alias("query"), "comp")
    more = search_blocks(queries, left.count(), small, fetch, num, den)
    stars_known = known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars_known.unionByName(more))


def set_classes(docs: DataFrame, keyed: DataFrame, text_col: str, words: int, num: int, den: int) -> tuple[frozenset[int], DataFrame]:
    """The doubled low halves, and (sid, first, docs, least) of each set: its least id, how many rows it has, the least id of its component; keyed as set_rows() gives it."""
    doubled = collided(keyed)
    keyed = numbered(keyed, doubled)
    if doubled:  # heads are low halves, which do not tell these sets apart: each of their rows is a head
        alone = F.transform("heads", lambda h: F.when(h.isin(*doubled) | F.col("low").isin(*doubled), F.col("sid")).otherwise(h))
        keyed = keyed.withColumn("heads", alone)
    sets = materialize(distinct_sets(keyed))
    linked = similar_sets(docs, keyed, sets, doubled, text_col, words, num, den)
    named = materialize(sets.select("sid", "first", "docs").join(linked.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component"))
    least = materialize(named.groupBy("comp").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("sets")))
    return doubled, join_hot(named, least, ["comp"], "sets", ["sid"]).select("sid", "first", "docs", "least")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs: doc, n_shingles, component.

    A document's set: its distinct shingles of so many words (ASCII white space between, A-Z
    lower-cased), of its whole text however long; all words as one shingle where they are fewer; empty
    for null and blank texts. Documents link when den * shared >= num * all shingles of the two, and a
    component is the least id reachable by links. Empty sets link with nothing. Rows with one id are
    one document; a null id is a component by itself (null) unless its set links to others. An empty
    table gives an empty one; other columns of docs are not read.
    """
    keyed = materialize(set_rows(docs, id_col, text_col, words, partial(signatures, num=num, den=den)))
    doubled, of_sid = set_classes(docs, keyed, text_col, words, num, den)
    of_sid = materialize(of_sid.select("sid", "least", "docs"))
    rows = join_hot(numbered(keyed, doubled).select("doc", "n", "sid"), of_sid, ["sid"], "docs", ["doc"], "left")
    return rows.select("doc", F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component"))
