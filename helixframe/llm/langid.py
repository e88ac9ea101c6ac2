"""Language identification by unigram pieces with all segmentations summed.

A fixed public vocabulary gives the pieces. Each language's piece probabilities are counted, by Spark,
over a bounded sample of its labelled texts. The probability of a word in a language is the sum over
all ways to cut it into pieces, by a forward pass; a text's is the product over its words. The forward
pass runs over the distinct words of a batch at once, for all languages.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import materialize, slices

#: Words of one length up to this are summed over together; longer ones each alone.
TOGETHER = 96
#: Words whose sums are in memory at once.
AT_ONCE = 1 << 12
#: Characters of such a word whose pieces are looked up at once.
STRETCH = 1 << 14
SPACE = "▁"
UNKNOWN = 1e-7
#: Keeps products of small probabilities in range: each character's factor is raised by this.
LIFT = 64.0
#: Sums below SMALL are raised by its inverse, which the logarithm takes back.
SMALL = 1e-150
KEPT_WORDS = 200_000
#: A table of so many languages is broadcast.
FEW = 10_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SLOT_BITS = 20
POWERS = np.array([pow(1_000_003, k, 1 << 64) for k in range(TOGETHER + 1)], dtype=np.uint64)


@lru_cache(maxsize=2)
def vocabulary(path: str | None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=2)
def pieces_of(path: str | None) -> dict[str, int]:
    """Pieces that can occur in a lower-cased word, with their ids."""
    model = vocabulary(path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    named = ((model.id_to_piece(i), i) for i in plain)
    return {p: i for p, i in named if p == p.lower() and SPACE not in p[1:] and p != SPACE and len(p) <= TOGETHER}


def words_of(text: str) -> list[str]:
    return text.lower().split()


def is_held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text has remainder 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_for_fit(labelled: DataFrame, key: Column, lang_col: str, max_docs: int) -> DataFrame:
    """About max_docs rows of each language, those with the smallest hash of the key; all of a language with fewer."""
    counts = labelled.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts.select("__lang", F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("__n")).alias("__part")))
    if counts.count() <= FEW:  # else the join deals the texts out by language
        counts = F.broadcast(counts)
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(counts, F.col(lang_col) == F.col("__lang")).where(place < F.col("__part")).drop("__lang", "__part")


def count_pieces(labelled: DataFrame, lang_col: str, text_col: str, path: str | None) -> DataFrame:
    """(lang, piece, n) over the labelled texts; each task sends its sums."""

    def count(batches):
        known, model, sums = pieces_of(path), vocabulary(path), {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array(model.encode(text.lower()), dtype=np.int64)
                if lang not in sums:
                    sums[lang] = np.zeros(model.get_piece_size(), dtype=np.int64)
                sums[lang] += np.bincount(ids, minlength=len(sums[lang]))
        keep = np.array(sorted(known.values()))
        for lang, counted in sums.items():
            seen = keep[counted[keep] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counted[seen])], names=["lang", "piece", "n"])

    parts = labelled.select(F.col(lang_col).cast("string"), text_col).mapInArrow(count, "lang string, piece long, n long")
    return parts.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class PieceModel:
    """Piece probabilities of each language, found by hash; probabilities are by row of self.table."""

    def __init__(self, langs: list[str], counts: np.ndarray, texts: list[str], smoothing: float = 0.1):
        self.langs = langs
        probabilities = (counts + smoothing) / (counts + smoothing).sum(axis=0)
        lifts = LIFT ** np.array([[len(t)] for t in texts], dtype=float)
        self.table = np.vstack([probabilities * lifts, np.zeros((1, len(langs)))])
        self.longest = max(map(len, texts), default=1)
        self.keys = np.array([self.hash_of(t) for t in texts], dtype=np.uint64)
        self.slots = np.full((2, 1 << SLOT_BITS), len(texts), dtype=np.int32)
        self.slots[0, self.slot(self.keys, A)] = np.arange(len(texts))
        lost = np.flatnonzero(self.slots[0, self.slot(self.keys, A)] != np.arange(len(texts)))
        self.slots[1, self.slot(self.keys[lost], B)] = lost
        self.keys = np.append(self.keys, np.uint64(0))
        self.cached: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    @staticmethod
    def slot(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys * factor) >> np.uint64(64 - SLOT_BITS)

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * 1_000_003 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the table for hashes of strings; the last row, of zeros, for what is no piece."""
        first = self.slots[0, self.slot(keys, A)]
        miss = np.flatnonzero(self.keys[first] != keys)
        second = self.slots[1, self.slot(keys[miss], B)]
        first[miss] = np.where(self.keys[second] == keys[miss], second, len(self.keys) - 1)
        return first

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probabilities (words x languages), summed over all segmentations of each word of at most TOGETHER characters."""
        out = np.zeros((len(words), len(self.langs)))
        lengths = np.array([len(w) for w in words])
        for size in np.unique(lengths):
            of_size = np.flatnonzero(lengths == size)
            for first in range(0, len(of_size), AT_ONCE):
                at = of_size[first : first + AT_ONCE]
                out[at] = self.forward_of_size([words[i] for i in at], int(size))
        return out

    def forward_of_size(self, words: list[str], size: int) -> np.ndarray:
        """The same of words of one length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), size).astype(np.uint64) + np.uint64(1)
        alpha = np.zeros((size + 1, len(words), len(self.langs)))
        alpha[0], carried = 1.0, np.zeros((len(words), len(self.langs)))
        for end in range(1, size + 1):
            h = np.zeros(len(words), dtype=np.uint64)
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                h += codes[:, start] * POWERS[end - 1 - start]
                row = self.rows(h)
                found = np.flatnonzero(row != len(self.keys) - 1)
                if len(found):
                    alpha[end, found] += alpha[start, found] * self.table[row[found]]
            alpha[end] += alpha[end - 1] * (UNKNOWN * LIFT)
            low = alpha[end] < SMALL
            if low.any():  # all that later ends start from
                alpha[max(0, end + 1 - self.longest) : end + 1] *= np.where(low, 1 / SMALL, 1.0)
                carried[low] += np.log(SMALL)
        return np.log(alpha[size]) + carried - size * np.log(LIFT)

    def forward_alone(self, word: str) -> np.ndarray:
        """The same of one word of any length, by language; it keeps the sums of the last characters only."""
        codes = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        widest, carried = min(self.longest, len(codes)), np.zeros(len(self.langs))
        last = np.zeros((widest, len(self.langs)))  # sums that end k characters before
        last[0] = 1.0
        for start in range(0, len(codes), STRETCH):
            ends = np.arange(start, min(start + STRETCH, len(codes)))
            found = np.full((len(ends), widest), len(self.keys) - 1, dtype=np.int32)  # by end and length, the rows of pieces
            h = np.zeros(len(ends), dtype=np.uint64)
            for k in range(widest):
                here = ends >= k
                h[here] += codes[ends[here] - k] * POWERS[k]
                found[here, k] = self.rows(h[here])
            for rows in found:
                total = (self.table[rows] * last).sum(axis=0) + last[0] * (UNKNOWN * LIFT)
                last = np.vstack([total, last[:-1]])
                low = total < SMALL
                if low.any():
                    last *= np.where(low, 1 / SMALL, 1.0)
                    carried[low] += np.log(SMALL)
        return np.log(last[0]) + carried - len(codes) * np.log(LIFT)

    def score_new(self, words: list[str]) -> None:
        """Adds what self.scores lacks of distinct words; starts anew when it has got large."""
        new = [w for w in words if w not in self.cached]
        if len(self.cached) + len(new) > KEPT_WORDS:
            self.cached, self.scores, new = {}, np.zeros((0, len(self.langs))), words
        if new:
            whole, total = [SPACE + w for w in new], np.zeros((len(new), len(self.langs)))
            short = np.array([len(w) <= TOGETHER for w in whole])
            total[short] = self.forward([w for w, s in zip(whole, short, strict=True) if s])
            for i in np.flatnonzero(~short).tolist():
                total[i] = self.forward_alone(whole[i])
            start = len(self.scores)
            self.cached.update(zip(new, range(start, start + len(new)), strict=True))
            self.scores = np.vstack([self.scores, total])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and posteriors under equal priors; und and 0 for null and for texts without a letter."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        full = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        distinct: dict[str, None] = {}
        for i in full:  # texts are split once more below, so that the words of one text at a time are in memory
            distinct.update(dict.fromkeys(words_of(texts[i])))
        self.score_new(list(distinct))
        del distinct
        sizes, sums = np.zeros(len(texts), dtype=int), np.zeros((len(texts), len(self.langs)))
        for i in full:
            rows = np.fromiter(map(self.cached.__getitem__, words_of(texts[i])), dtype=np.int64)
            sizes[i], sums[i] = len(rows), self.scores[rows].sum(axis=0)
        best = sums.argmax(axis=1)
        posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if n else "und" for b, n in zip(best, sizes, strict=True)], [float(p) if n else 0.0 for p, n in zip(posterior, sizes, strict=True)]


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", max_docs: int = 3000, path: str | None = None) -> tuple[list[str], np.ndarray, list[str]]:
    """Languages, counts (pieces x languages) and pieces, from at most about max_docs texts of each language.

    The vocabulary bounds what comes to the driver: at most one number for each piece and language.
    Rows with null language or text are not learned from.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = sample_for_fit(usable, F.col(key_col), lang_col, max_docs)
    rows = count_pieces(sample, lang_col, text_col, path).collect()
    langs = sorted({r["lang"] for r in rows})
    known = pieces_of(path)
    texts = sorted(known)
    at = {known[t]: i for i, t in enumerate(texts)}
    counts = np.zeros((len(texts), len(langs)))
    for r in rows:
        counts[at[r["piece"]], langs.index(r["lang"])] = r["n"]
    return langs, counts, texts


def identify(docs: DataFrame, fitted: tuple, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score besides its columns (clashing ones are replaced).

    score, 0 to 1, is the language's posterior under equal priors; of equal ones the first by name wins.
    Null texts and texts without a letter are und, 0, and so is every text if no language was learned.
    Texts and words are read whole, however long. Repeated rows give a row each; an empty table an empty one.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(names)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    place = names.index(text_col)

    def score(batches):
        model = PieceModel(*shared.value)
        for batch in slices(batches, 1024):
            langs, scores = model.predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)
