"""Alignment of two tokenizers over each text, and how often two ids end together in the corpus.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B); both spell the bytes of a
space and the text. Cumulative ends go into dictionaries from end to index; the keys that both have,
sorted, cut the two id lists into groups, and the last tokens of a group are linked. Links of a block
of documents are counted by id pair, so the corpus counts come from one row for each pair and block,
and go back to the blocks the same way: what a task holds is a block, whatever the vocabularies hold.
"""

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.byte_level import token_bytes, token_ids
from helixframe.llm.common import join_hot, materialize, slices

#: Rows and bytes of text in a block, at most (a longer text is a block of its own).
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 23
#: A's id in the high bits of a pair, B's in the low ones.
LOW = 32


@lru_cache(maxsize=2)
def pieces(model: str | None):
    """The piece vocabulary, and the bytes of each of its ids."""
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
    spelled = []
    for i in range(own.get_piece_size()):
        piece = own.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        spelled.append(bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode())
    return own, spelled


@lru_cache(maxsize=2)
def spelling(vocabulary: str | None, model: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Byte lengths of A's ids and of B's; the strings of A's ids with , and with |, then of B's with , and with ; and how many ids A has."""
    a, b = token_bytes(vocabulary), pieces(model)[1]
    strings = [f"{i}{end}" for n, ends in ((len(a), ",|"), (len(b), ",;")) for end in ends for i in range(n)]
    return np.array([len(x) for x in a]), np.array([len(x) for x in b]), np.array(strings, dtype=object), len(a)


def encode(text: str | None, vocabulary: str | None = None, model: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of A over space and text and of B over the text, none where the text is empty or one of the two does not spell it."""
    none = np.zeros(0, dtype=np.int64)
    if not text:
        return none, none
    own, of_b = pieces(model)
    whole, of_a = b" " + text.encode(), token_bytes(vocabulary)
    a, b = token_ids(" " + text, vocabulary, special=False).tolist(), own.encode(text, num_threads=1)
    if b"".join(map(of_a.__getitem__, a)) != whole or b"".join(map(of_b.__getitem__, b)) != whole:
        return none, none
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of A's and B's tokens that end together, in order; a and b are byte lengths."""
    at_a = dict(zip(np.cumsum(a).tolist(), range(len(a)), strict=True))
    at_b = dict(zip(np.cumsum(b).tolist(), range(len(b)), strict=True))
    ends = sorted(at_a.keys() & at_b.keys())
    n = len(ends)
    return np.fromiter(map(at_a.__getitem__, ends), np.int64, n), np.fromiter(map(at_b.__getitem__, ends), np.int64, n)


def align(a: np.ndarray, b: np.ndarray, vocabulary: str | None = None, model: str | None = None) -> tuple[int, str, np.ndarray]:
    """(groups, their spelling, linked pairs) of the ids of one text; a group's last ids are its link, as no token is without bytes."""
    if not len(a):
        return 0, "", np.zeros(0, dtype=np.int64)
    len_a, len_b, strings, n_a = spelling(vocabulary, model)
    last_a, last_b = common_ends(len_a[a], len_b[b])
    # A's ids and B's of each group in turn: an id's place is its own index and the other's ids of the groups before (and of its own, for B)
    out = np.empty(len(a) + len(b), dtype=np.int64)
    sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    name_a, name_b = a.copy(), 2 * n_a + b
    name_a[last_a] += n_a
    name_b[last_b] += len(len_b)
    out[np.arange(len(a)) + np.repeat(last_b - sizes_b + 1, sizes_a)] = name_a
    out[np.arange(len(b)) + np.repeat(last_a + 1, sizes_b)] = name_b
    return len(last_a), "".join(strings[out].tolist())[:-1], a[last_a] << LOW | b[last_b]


DOC = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("groups", T.StringType())]


def aligned_blocks(docs: DataFrame, id_col: str, text_col: str, digest: bool, vocabulary: str | None, model: str | None) -> DataFrame:
    """A row for each document, with the places of its pairs in its block's and how often it has each; then a row for the block with its pairs and counts."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc", docs.schema[id_col].dataType), *[T.StructField(*f) for f in DOC], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("pairs", longs), T.StructField("counts", longs)])
    arrow = {"at": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices([batch], BLOCK_ROWS, BLOCK_BYTES):
                rows, own, times = [], [], []
                for text in part.column(1).to_pylist():
                    a, b = encode(text, vocabulary, model)
                    groups, spelled, links = align(a, b, vocabulary, model)
                    pairs, n = np.unique(links, return_counts=True)
                    own.append(pairs)
                    times.append(n)
                    rows.append((len(a), len(b), groups, (hashlib.sha256(spelled.encode()).hexdigest() if spelled else "") if digest else spelled))
                pairs, at = np.unique(np.concatenate(own), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate(times), minlength=len(pairs)).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in own])])
                listed = lambda x, k: pa.ListArray.from_arrays(pa.array(k, pa.int32()), pa.array(x))
                n = len(rows)
                known = [pa.array(np.full(n, block)), part.column(0), *[pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]]
                known += [listed(at.astype(np.int32), bounds), listed(np.concatenate(times).astype(np.int32), bounds), pa.nulls(n, arrow["pairs"]), pa.nulls(n, arrow["counts"])]
                names = [f.name for f in schema]
                yield pa.RecordBatch.from_arrays(known, names=names)
                last = [pa.array([block])] + [pa.nulls(1, c.type) for c in known[1:8]] + [pa.array([pairs], arrow["pairs"]), pa.array([counts], arrow["counts"])]
                yield pa.RecordBatch.from_arrays(last, names=names)
                block += 1

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, block, place, n, best, blocks) of each block's pairs: their links in the corpus, and whether no other pair of B's id has more."""
    rows = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("own"))
    sums = materialize(rows.groupBy("pair").agg(F.sum("own").alias("n"), F.count(F.lit(1)).alias("blocks")).withColumn("b", F.expr(f"pair & {(1 << LOW) - 1}")))
    most = materialize(sums.groupBy("b").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("pairs")))
    counts = materialize(join_hot(sums, most, ["b"], "pairs", ["pair"]).select("pair", "n", "blocks", (F.col("n") == F.col("most")).alias("best")))
    return join_hot(rows.select("block", "place", "pair"), counts, ["pair"], "blocks", ["block"])


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """One row per row of docs: doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A encodes a space and the text, B the text (it adds the space); strings of special tokens are plain
    text. groups spells the ids as a1,a2|b1;a3|b2,b3 (digest: its SHA-256 as hex). n_best counts the
    links whose pair has most links in the corpus among the pairs of its B id, ties included; count_sum
    adds up the corpus counts of the links' pairs. Texts that are null, empty or not spelled in full by
    both (a character that a vocabulary changes) have zeros and an empty groups. Repeated rows each
    count, in the corpus, too; a null id stays null. Texts may have any length. An empty table gives an
    empty one; other columns of docs are not read.
    """
    blocks = materialize(aligned_blocks(docs, id_col, text_col, digest, vocabulary, model))
    known = pair_counts(blocks).select(F.col("block").alias("of"), "place", "n", "best")
    rows = blocks.where("pairs is null").drop("pairs", "counts")
    kind = T.StructType([rows.schema["doc"], *[rows.schema[c] for c in ("n_a", "n_b", "n_groups")], *[T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")], T.StructField("groups", T.StringType())])

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        places = right["place"].to_numpy()
        n, best = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        n[places], best[places] = right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        at, times = (left[c].combine_chunks() for c in ("at", "times"))
        bounds, flat, m = at.offsets.to_numpy(), at.values.to_numpy(), times.values.to_numpy().astype(np.int64)
        sums = []
        for each in (m, m * best[flat], m * n[flat]):
            total = np.concatenate([[0], np.cumsum(each)])
            sums.append(pa.array(total[bounds[1:]] - total[bounds[:-1]]))
        return pa.Table.from_arrays([*[left[c] for c in ("doc", "n_a", "n_b", "n_groups")], *sums, left["groups"]], names=[f.name for f in kind])

    return rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, kind)
