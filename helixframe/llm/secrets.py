"""Secret scans, with ownership frequency over the whole corpus.

A scan finds candidates in each text: base kinds, which always count, and further kinds that also hit
harmless strings. Hashes of the candidates are counted over the corpus by distinct owners and
repositories. A further candidate that many owners or many repositories have is a copied example; one
that belongs to a few of both looks live, and its span is added to the document's.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import join_hot, materialize, slices


def by_pattern(pattern: str, group: int = 0):
    """(start, end, value) of the leftmost non-overlapping matches."""
    compiled = re.compile(pattern)
    return lambda text: ((m.start(), m.end(), m[group]) for m in compiled.finditer(text))


SIGNED = re.compile(r"[A-Za-z0-9_.-]{29,}")


def signed_tokens(text: str):
    """As by_pattern() for eyJ and three parts of [A-Za-z0-9_-]{8,} with dots between; each run of such characters is read once."""
    for run in SIGNED.finditer(text):
        parts, at, i = run[0].split("."), run.start(), 0
        while i + 2 < len(parts):
            begin = parts[i].find("eyJ")
            if begin >= 0 and len(parts[i]) >= begin + 11 and len(parts[i + 1]) >= 8 and len(parts[i + 2]) >= 8:
                size = len(parts[i]) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                yield at + begin, at + size, text[at + begin : at + size]
                at, i = at + size + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1


# Fixed patterns. Base kinds: name, finder, least length of the value; matches that are too short are dropped after matching.
BASE = (
    ("assign", by_pattern(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2), 6),
    ("access", by_pattern(r"AKIA[A-Z0-9]+"), 20),
    ("hex", by_pattern(r"[0-9a-f]{24,}"), 24),  # runs are maximal, so shorter ones can be skipped at once
)
# Further kinds; they count only where their value belongs to few owners.
FURTHER = (
    ("pem", by_pattern(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,20}PRIVATE KEY-----"), 0),
    ("jwt", signed_tokens, 0),
    ("vendor", by_pattern(r"(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}"), 0),
    ("mixed", by_pattern(r"[A-Za-z0-9+/_-]{32,}"), 0),
)
KINDS = [kind for kind, *_ in BASE + FURTHER]
MIXED = (re.compile(r"[0-9]"), re.compile(r"[a-z]"), re.compile(r"[A-Z]"))

SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.BinaryType())])


def find(text: str, kinds=BASE + FURTHER) -> list[tuple[int, int, int, bytes]]:
    """(kind's number, start, end, hash of the value) by start, then kind; starts and ends count code points."""
    found = []
    for number, (kind, finder, least) in enumerate(kinds):
        for start, end, value in finder(text):
            if len(value) < least or kind == "mixed" and not all(p.search(value) for p in MIXED):
                continue
            found.append((start, number, end, hashlib.blake2b(value.encode(), digest_size=16).digest()))
    return [(number, start, end, value) for start, number, end, value in sorted(found)]


def scan(docs: DataFrame, id_col: str, text_col: str, repo_cols: list[str], owner_col: str) -> DataFrame:
    """(doc, repo, owner, spans) of each row; null texts are empty."""
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols])
    rows = docs.select(F.col(id_col).alias("doc"), repo.alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("spans", T.ArrayType(SPAN))])
    names = ["doc", "repo", "owner", "spans"]
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())]))

    def run(batches):
        for batch in slices(batches, 1024):
            spans = [[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in find(t or "")] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, kind)], names=names)

    return rows.mapInArrow(run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners, n_docs): distinct repositories and owners, pre-aggregated, so a value that is everywhere is no hot key."""
    places = candidates.groupBy("value", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_docs"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: list[str] | None = None, owner_col: str = "source", max_owners: int = 2, max_repos: int = 3) -> DataFrame:
    """One row per row of docs: doc, n_assign, n_access, n_hex, n_further, n_live, n_copied, base, found.

    A value is live if at most max_owners owners and at most max_repos repositories have it; a value
    within one owner that many of its repositories copy is an example, too. base and found are arrays
    of (start, kind, end, name, n_owners, n_repos, live) by start, then kind: the base spans, and
    those with the further spans that are live. n_live counts the live spans of found, n_copied base spans
    that are not and further ones left out. Null and empty texts have no spans; whole texts are read,
    however long. A null owner is one owner. Repeated rows give a row each, but count once for their
    repository. An empty table gives an empty one; other columns of docs are not read.
    """
    scanned = materialize(scan(docs, id_col, text_col, repo_cols or [owner_col], owner_col).withColumn("row", F.monotonically_increasing_id()))
    spans = scanned.select("row", "repo", "owner", F.explode("spans").alias("s")).select("row", "repo", "owner", "s.*")
    counts = materialize(ownership(spans.select("value", "repo", "owner")))
    judged = join_hot(spans, counts, ["value"], "n_docs", ["row", "start"]).withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    base, names = F.col("kind") < len(BASE), F.array(*[F.lit(k) for k in KINDS])
    span = F.struct("start", "kind", "end", F.element_at(names, F.col("kind") + 1).alias("name"), "n_owners", "n_repos", "live")
    by_row = judged.groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[: len(BASE)])],
        F.count_if(~base & F.col("live")).alias("n_further"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.sort_array(F.collect_list(F.when(base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(base | F.col("live"), span))).alias("found"),
    )
    joined = scanned.select("row", "doc").join(by_row, "row", "left")
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*(f"n_{k}" for k in KINDS[: len(BASE)]), "n_further", "n_live", "n_copied")]
    none = F.array().cast(by_row.schema["found"].dataType)
    return joined.select("doc", *counted, F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
