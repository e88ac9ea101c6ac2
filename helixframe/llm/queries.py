"""The queries of the ten corpus operators over the given tables, and the SQL that checks them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import alignment, jaccard, langid, licenses, lines, minhash, mixing, packing, phrases, quality, secrets, substrings, vectors
from helixframe.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of at least 85 % of a template's words."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), band=8, least=0.85)
    return found.select(F.col("doc").alias("doc_id"), "license", "start", "end", "matched_words", "template_words", F.round("coverage", 6).alias("coverage"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three phases whose weights integrate to 5, 2, 1 in turn; at most three passes."""
    mixed = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("position"))


OP2 = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS share
    FROM sized GROUP BY source),
levels AS (
    SELECT *, 3 * source_size AS cap,
           ((SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(share) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here
    FROM sources WINDOW o AS (ORDER BY 3 * source_size / share, source NULLS LAST)),
targets AS (
    SELECT source, source_size, share, round(least(cap::DOUBLE, share * (SELECT max(level_here) FROM levels)), 6) AS target FROM levels),
placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.share, round(t.target)::BIGINT AS quota,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
phases AS (SELECT * FROM (VALUES  -- share, integral before the phase, in it, start, end
    (5.0::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE, 0.0::DOUBLE, 0.25::DOUBLE), (5.0, 2.0, 2.0, 0.25, 0.75), (5.0, 4.0, 1.0, 0.75, 1.0),
    (2.0, 0.0, 0.25, 0.0, 0.25), (2.0, 0.25, 1.0, 0.25, 0.75), (2.0, 1.25, 0.75, 0.75, 1.0),
    (1.0, 0.0, 0.5, 0.25, 0.75), (1.0, 0.5, 0.5, 0.75, 1.0)) v(share, before, mass, t_start, t_end)),
timed AS (
    SELECT p.*, round(least(1.0, h.t_start + (h.t_end - h.t_start) * greatest((p.place / p.target * p.share - h.before) / h.mass, 0.0)), 9) AS time_at
    FROM placed p LEFT JOIN phases h ON h.share = p.share AND p.place / p.target * p.share >= h.before AND p.place / p.target * p.share < h.before + h.mass)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, quota - place)) + greatest(0, least(size, quota - source_size - place)) + greatest(0, least(size, quota - 2 * source_size - place)))::BIGINT AS taken,
       CASE WHEN least(size, quota - place) > 0 THEN coalesce(time_at, 1.0) END AS position
FROM timed
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of at least 120 characters in chunks of 12 to 80 that stand before in the corpus, in pieces with one source each."""
    found = substrings.repeated_spans(table(spark, sf_dir, "documents"), least=12, bits=4, most=80, min_chars=120)
    return found.select(F.col("doc").alias("doc_id"), "start", "end", "n_chunks", F.col("kept_doc").alias("kept_doc_id"), "kept_start", "span_start", "span_end")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 40 code points or more in 5 documents or more; the largest doc_id keeps them."""
    deduped = lines.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5, keep="last")
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4 = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> o.keeper, false) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of 0.93 or more within a label."""
    linked = vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return linked.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens; id 0 ends a document."""
    return packing.pack(table(spark, sf_dir, "documents"), longest=1024, end_id=0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2, at most about 3000 of each language; predicts for all."""
    docs = table(spark, sf_dir, "documents")
    held_out = langid.is_held_out(F.col("doc_id"))
    fitted = langid.fit(docs.where(~held_out), max_docs=3000)
    return langid.identify(docs.select("doc_id", "text"), fitted).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner is a source, a repository a source and language; values of at most 2 owners and 3 repositories look live."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), repo_cols=["source", "lang"], owner_col="source", max_owners=2, max_repos=3)
    base = F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256")
    return found.select(F.col("doc").alias("doc_id"), "n_assign", "n_access", "n_hex", base, secrets.spelled(F.col("found")).alias("spans"), "n_further", "n_live", "n_copied")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of 3-word shingles; a link takes 90 % of both sets' shingles."""
    joined = jaccard.jaccard_join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return joined.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 3.5 median deviations about each language's median bits per character."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    bits = F.round("bits_per_char", 4).alias("bits_per_char")
    return judged.select(F.col("doc").alias("doc_id"), *quality.BASE_FIELDS, "base_failed", "kept", bits)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128 functions over 5-word shingles; components of documents that share 80 % of them."""
    rows = minhash.fingerprint_documents(table(spark, sf_dir, "documents"), words=5, num=80, den=100)
    return rows.withColumnsRenamed({"doc": "doc_id", "component": "component_id"})


def op12_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases found 100 times or more; the first 2000 of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, share=100, top=2000)


OP12 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k.k, w[i:i + k.k - 1] AS g FROM places, (SELECT unnest(range(1, 6)) AS k) k WHERE i + k.k - 1 <= len(w)),
counts AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
kept AS (
    SELECT * FROM counts c WHERE k > 1 AND NOT EXISTS (
        SELECT 1 FROM counts o WHERE o.lang = c.lang AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.f >= 100 * c.f)),
cuts AS (SELECT lang, phrase, f AS a, g, k, unnest(range(1, k)) AS cut FROM kept),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, s.n, ((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1:c.cut], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[c.cut + 1:c.k], ' ') JOIN sizes s ON s.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """byte_bpe_50k against piece_bpe_32k."""
    aligned = alignment.align_tokenizers(table(spark, sf_dir, "documents"), digest=True)
    return aligned.select(F.col("doc").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_mix_sources": op2_mix_sources,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_packing": op6_packing,
        "op7_language_id": op7_language_id,
        "op8_secret_scan": op8_secret_scan,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_quality_rules": op10_quality_rules,
        "op11_document_fingerprints": op11_document_fingerprints,
        "op12_phrase_collocation": op12_phrase_collocation,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2, "op4_line_dedup": OP4, "op12_phrase_collocation": OP12}
