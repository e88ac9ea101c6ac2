"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one pieces;
run() writes what a stage returns and reads it again for the next.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import jaccard, langid, lines, mixing, packing
from helixframe.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) or with a posterior under one half go."""
    fitted = langid.fit(docs, max_docs=3000)
    scored = langid.identify(docs, fitted)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in 5 documents or more stay in the largest doc_id only; every document stays."""
    deduped = lines.dedup_lines(docs, min_chars=40, min_docs=5, keep="last")
    return deduped.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their 5-word shingles, the smallest doc_id stays."""
    joined = jaccard.jaccard_join(docs, words=5, num=80, den=100)
    gone = joined.where(F.col("doc") != F.col("component")).select(F.col("doc").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn; rows as often as they are taken, in training order."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each a sequence; a document taken twice is packed twice."""
    return packing.pack(docs, longest=1024, end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
