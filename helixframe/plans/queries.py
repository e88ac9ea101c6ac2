"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequences as seqs
from helixframe.functions.register import register
from helixframe.functions.tables import register_tables
from helixframe.operators import analysis, barcodes, graph, leiden, matrix, neighbours, qc, reads, umis, validation
from helixframe.plans import pipelines, views
from helixframe.plans.views import COUNTS_A, COUNTS_B, CORRECTED, EXTRACTED, GRID, READS
from helixframe.schemas import PROTOCOLS, Protocol, protocol_or_default, protocol_table
from helixframe.sinks import bam as bam_sink
from helixframe.sinks import files as sinks
from helixframe.sinks.files import matrix_lines
from helixframe.sources import bam, fastq
from helixframe.sources.files import whitelist_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- reads to counts


@query(f"WITH {CORRECTED} SELECT gene, cell, count(DISTINCT umi)::BIGINT AS n_umis FROM matched WHERE cell IS NOT NULL AND is_mapped AND mapq >= 10 GROUP BY ALL")
def flagship_count_matrix(spark, d):
    found = reads.mapped(pipelines.extract(views.reads(spark, d), views.whitelist(spark, d), min_barcode_qual=None), 10)
    return umis.distinct_umis(found.where("cell is not null")).select("gene", "cell", "n_umis")


PROTOCOL_SQL = " UNION ALL ".join(
    f"SELECT '{p.name}' AS protocol, rec_no, substr(seq, {p.barcode_start + 1}, {p.barcode_len}) AS barcode, substr(seq, {p.umi_start + 1}, {p.umi_len}) AS umi, length(seq)::BIGINT - {max(p.barcode_start + p.barcode_len, p.umi_start + p.umi_len)} AS cdna_len FROM reads WHERE length(seq) >= {p.min_length}"
    for p in PROTOCOLS.values()
    if not p.whole_read
)


@query(f"WITH {READS} {PROTOCOL_SQL}")
def protocol_extract(spark, d):
    """All layouts in one pass over the reads."""
    rows = reads.extract_each(views.reads(spark, d), [p for p in PROTOCOLS.values() if not p.whole_read])
    return rows.select("protocol", "rec_no", "barcode", "umi", F.length("cdna").cast("long").alias("cdna_len"))


@query(f"WITH {READS} SELECT rec_no, 'plate_A1' AS barcode, '' AS umi, seq AS cdna, 'IIIIIIII' AS barcode_qual, length(qual)::BIGINT AS cdna_qual_len FROM reads")
def protocol_whole_read(spark, d):
    rows = reads.extract(views.reads(spark, d), "smart-seq2", sample="plate_A1")
    return rows.select("rec_no", "barcode", "umi", "cdna", "barcode_qual", F.length("cdna_qual").cast("long").alias("cdna_qual_len"))


@query(f"WITH {READS} SELECT rec_no, substr(seq, 3, 10) AS barcode, substr(seq, 15, 6) AS umi, substr(seq, 21) AS cdna FROM reads WHERE length(seq) >= 20")
def protocol_custom(spark, d):
    """A layout of one's own: two bases, barcode of ten, two bases, UMI of six."""
    rows = reads.extract(views.reads(spark, d), Protocol("own", 2, 10, 14, 6))
    return rows.where("barcode is not null").select("rec_no", "barcode", "umi", "cdna")


@query("SELECT event_type AS asked, CASE event_type WHEN 'view' THEN 'drop-seq' WHEN 'click' THEN 'indrop' ELSE '10x-3prime-v3' END AS used, count(*)::BIGINT AS n_reads FROM events GROUP BY ALL")
def protocol_fallback(spark, d):
    """Each sample's protocol as the web jobs take it: unknown ones and whole reads become the default."""
    asked = {"view": "drop-seq", "click": "indrop", "signup": "smart-seq2"}
    used = F.create_map(*[F.lit(x) for e in ("view", "click", "signup", "error", "purchase") for x in (e, protocol_or_default(asked.get(e, e)).name)])
    rows = views.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_reads"))
    return rows.select(F.col("event_type").alias("asked"), F.element_at(used, F.col("event_type")).alias("used"), "n_reads")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p.name}', {p.barcode_len}::BIGINT, {p.umi_len}::BIGINT, {p.min_length}::BIGINT)" for p in PROTOCOLS.values()) + ") t(protocol, barcode_len, umi_len, min_length), (SELECT count(*)::BIGINT AS n_reads FROM events)")
def protocols(spark, d):
    n = views.table(spark, d, "events").agg(F.count(F.lit(1)).alias("n_reads"))
    rows = protocol_table(spark).select("protocol", *long("barcode_len", "umi_len"), (F.col("barcode_start") + F.col("barcode_len") + F.col("umi_len")).cast("long").alias("min_length"))
    return rows.crossJoin(F.broadcast(n))  # one row


@query(f"WITH {READS} SELECT rec_no, CASE WHEN length(seq) >= 26 THEN substr(seq, 19, 8) END AS part, CASE WHEN length(qual) >= 26 THEN substr(qual, 19, 8) END AS qual_part, CASE WHEN length(seq) >= 24 THEN '' END AS none FROM reads")
def subsequence_bounds(spark, d):
    return views.reads(spark, d).select("rec_no", seqs.subsequence("seq", 18, 8).alias("part"), seqs.subsequence("qual", 18, 8).alias("qual_part"), seqs.subsequence("seq", 24, 0).alias("none"))


@query(f"WITH {READS} SELECT rec_no, CASE WHEN rec_no % 10 = 0 THEN 0 ELSE q END::DOUBLE AS mean_quality, CASE WHEN length(qual) >= 28 THEN q END::DOUBLE AS region_quality FROM reads")
def mean_quality(spark, d):
    qual = F.when(F.col("rec_no") % 10 == 0, F.lit("")).otherwise(F.col("qual"))
    return views.reads(spark, d).select("rec_no", seqs.mean_quality(qual).alias("mean_quality"), seqs.mean_quality_region("qual", 16, 12).alias("region_quality"))


@query(f"WITH {EXTRACTED} SELECT rec_no, barcode, umi FROM extracted WHERE barcode IS NOT NULL AND q >= 10")
def quality_filter(spark, d):
    return reads.good_umi(reads.good_barcode(reads.extract(views.reads(spark, d)), 10), 10).select("rec_no", "barcode", "umi")


@query(f"WITH {READS} SELECT rec_no, nullif(trim(split_part(id, ':', 3)), 'NONE') AS gene FROM reads")
def read_id_gene(spark, d):
    return reads.gene_from_id(views.reads(spark, d)).select("rec_no", "gene")


@query(f"WITH {READS} SELECT rec_no, mapq::BIGINT AS mapq FROM reads WHERE is_mapped AND mapq >= 30")
def mapq_filter(spark, d):
    return reads.mapped(views.reads(spark, d), 30).select("rec_no", F.col("mapq").cast("long"))


@query(f"WITH {READS} SELECT gene, count(*)::BIGINT AS n FROM (SELECT CASE WHEN rec_no % 3 = 0 THEN gene WHEN rec_no % 3 = 1 THEN 'ID_' || event_type END AS gene FROM reads) GROUP BY gene")
def gene_coalesce(spark, d):
    names = F.when(F.col("rec_no") % 3 == 0, F.col("gene"))
    ids = F.when(F.col("rec_no") % 3 < 2, F.concat(F.lit("ID_"), "event_type"))
    rows = views.reads(spark, d).select(names.alias("gene_name"), ids.alias("gene_id"))
    return reads.with_gene(rows).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {READS} SELECT rec_no FROM reads WHERE rec_no % 4 <> 0 AND rec_no % 6 <> 0")
def tag_filter(spark, d):
    rows = views.reads(spark, d).select("rec_no", F.when(F.col("rec_no") % 4 != 0, F.col("seq")).alias("cell_barcode"), F.when(F.col("rec_no") % 6 != 0, F.col("seq")).alias("umi"))
    return reads.tagged(rows).select("rec_no")


@query(
    f"""WITH {CORRECTED} SELECT count(*)::BIGINT AS total_reads, count(*) FILTER (status IN ('exact', 'corrected'))::BIGINT AS valid_barcodes, count(*) FILTER (status = 'corrected')::BIGINT AS corrected_barcodes,
    round(100.0 * count(*) FILTER (status IN ('exact', 'corrected')) / greatest(count(*), 1), 6)::DOUBLE AS valid_percent, round(100.0 * count(*) FILTER (status = 'corrected') / greatest(count(*), 1), 6)::DOUBLE AS corrected_percent FROM matched"""
)
def extract_counters(spark, d):
    return reads.extraction_counters(pipelines.extract(views.reads(spark, d), views.whitelist(spark, d), min_barcode_qual=None))


@query(f"WITH {READS} SELECT a.rec_no, a.seq AS r1_seq, reverse(a.seq) AS r2_seq FROM reads a")
def paired_reads(spark, d):
    r1 = views.reads(spark, d)
    return reads.pair(r1, r1.withColumn("seq", F.reverse("seq"))).select("rec_no", "r1_seq", "r2_seq")


@query(f"WITH {READS} SELECT rec_no, rec_no % 4 AS shard FROM reads")
def shard_records(spark, d):
    rows = views.reads(spark, d)
    out = None
    for i in range(4):
        part = reads.shard(rows, 4, i).select("rec_no", F.lit(i).cast("long").alias("shard"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {READS}, c AS (SELECT count(*)::BIGINT AS total_reads, count(*) FILTER (is_mapped AND mapq >= 30 AND rec_no % 4 <> 0 AND rec_no % 3 < 2)::BIGINT AS assigned_reads FROM reads) SELECT *, round(100.0 * assigned_reads / greatest(total_reads, 1), 6)::DOUBLE AS assigned_percent FROM c")
def count_counters(spark, d):
    i = F.col("rec_no")
    rows = views.reads(spark, d).select("mapq", "is_mapped", F.when(i % 4 != 0, F.col("seq")).alias("cell_barcode"), F.when(i % 3 == 0, F.col("gene")).alias("gene_name"), F.when(i % 3 == 1, F.col("event_type")).alias("gene_id"))
    return reads.count_counters(rows, 30)


@query(f"WITH {READS} SELECT gene, barcode, count(*)::BIGINT AS n FROM (SELECT coalesce(CASE WHEN rec_no % 3 = 0 THEN gene END, CASE WHEN rec_no % 3 = 1 THEN 'ID_' || event_type END) AS gene, true_barcode AS barcode FROM reads WHERE is_mapped AND mapq >= 30) WHERE gene IS NOT NULL GROUP BY ALL")
def count_reads(spark, d):
    """The count command over alignments."""
    i = F.col("rec_no")
    rows = views.reads(spark, d).select("mapq", "is_mapped", F.col("true_barcode").alias("cell_barcode"), F.when(i % 3 == 0, F.col("gene")).alias("gene_name"), F.when(i % 3 == 1, F.concat(F.lit("ID_"), "event_type")).alias("gene_id"))
    return pipelines.count_reads(rows, 30)


@query(f"WITH {READS} SELECT rec_no, length(seq)::BIGINT AS size, (length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')))::BIGINT AS gc FROM reads")
def mapped_records(spark, d):
    """A function of one's own over batches of records."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def gc(batches):
        for b in batches:
            size = pc.utf8_length(b["seq"]).cast(pa.int64())
            rest = pc.utf8_length(pc.replace_substring_regex(b["seq"], "[GC]", "")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b["rec_no"], size, pc.subtract(size, rest)], names=["rec_no", "size", "gc"])

    return reads.map_records(views.reads(spark, d).select("rec_no", "seq"), gc, "rec_no long, size long, gc long")


@query(f"WITH {READS} SELECT id, seq, qual FROM reads")
def fastq_round_trip(spark, d):
    """Reads written as FASTQ files and read back in byte ranges."""
    where = graph.shared_folder(spark, "fastq")
    sinks.write_fastq(views.reads(spark, d), where, compress=False)
    return fastq.read_fastq(spark, where, range_bytes=4 << 20).select("id", "seq", "qual")


@query(f"WITH {READS} SELECT count(*)::BIGINT AS records, count(DISTINCT rec_no)::BIGINT AS numbers, min(rec_no)::BIGINT AS first, max(rec_no)::BIGINT AS last FROM (SELECT row_number() OVER () - 1 AS rec_no FROM reads)")
def fastq_numbers(spark, d):
    """One file in ranges of a size that cuts it at every scale: numbers run from 0 without a gap."""
    where = graph.shared_folder(spark, "fastq")
    sinks.write_fastq(views.reads(spark, d).coalesce(1), where, compress=False)
    rows = fastq.read_fastq(spark, where, range_bytes=50_000)
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("rec_no").alias("numbers"), F.min("rec_no").alias("first"), F.max("rec_no").alias("last"))


@query(f"WITH {READS} SELECT id AS name, seq, mapq::BIGINT AS mapq, (rec_no % 3 - 1)::BIGINT AS tid, rec_no AS pos, length(seq) || 'M' AS cigar, CASE WHEN rec_no % 4 <> 0 THEN true_barcode END AS cell_barcode, gene AS gene_name, is_mapped, length(seq)::BIGINT AS qualities, (mapq % 42)::BIGINT AS quality FROM reads WHERE mapq >= 20")
def bam_round_trip(spark, d):
    """Reads written as BAM files by tasks and read back by ranges of blocks, the mapping quality pushed down."""
    r, i, none = views.reads(spark, d), F.col("rec_no"), F.lit(None).cast("string")
    qual = F.unhex(F.repeat(F.lpad(F.hex(F.col("mapq") % 42), 2, "0"), F.length("seq")))
    rows = r.select(F.col("id").alias("name"), "seq", qual.alias("qual"), F.col("mapq").cast("short").alias("mapq"), (i % 3 - 1).cast("int").alias("tid"), i.alias("pos"), F.concat(F.length("seq"), F.lit("M")).alias("cigar"), F.when(i % 4 != 0, F.col("true_barcode")).alias("cell_barcode"), none.alias("umi"), F.col("gene").alias("gene_name"), none.alias("gene_id"), "is_mapped", F.lit(False).alias("is_reverse"))
    where = graph.shared_folder(spark, "bam")
    bam_sink.write_bam(rows, [("chr1", 1 << 30), ("chr2", 1 << 30)], where)
    back = bam.read_bam(spark, where, range_bytes=1 << 20).where("mapq >= 20")
    return back.select("name", "seq", *long("mapq", "tid"), "pos", "cigar", "cell_barcode", "gene_name", "is_mapped", F.length("qual").cast("long").alias("qualities"), F.conv(F.hex(F.substring("qual", 1, 1)), 16, 10).cast("long").alias("quality"))


@query(f"WITH {READS} SELECT rec_no, substr(seq, 5, 8) AS part, hamming(substr(seq, 1, 8), substr(seq, 9, 8))::BIGINT AS off, nullif(trim(split_part(id, ':', 3)), 'NONE') AS gene, gene LIKE 'MT-%' OR gene LIKE 'mt-%' AS mito, (q * length(qual))::BIGINT AS phred FROM reads")
def sql_functions(spark, d):
    """The scalar functions by name in SQL."""
    register(spark)
    views.reads(spark, d).createOrReplaceTempView("helixframe_reads")
    return spark.sql("SELECT rec_no, subsequence(seq, 4, 8) AS part, CAST(hamming(substring(seq, 1, 8), substring(seq, 9, 8)) AS BIGINT) AS off, gene_of_read_id(id) AS gene, is_mito(gene) AS mito, byte_sum(qual) - 33 * length(qual) AS phred FROM helixframe_reads")


@query(f"WITH {READS} SELECT rec_no, CASE WHEN length(seq) >= 20 THEN substr(seq, 1, 12) END AS barcode, CASE WHEN length(seq) >= 20 THEN substr(seq, 13, 8) END AS umi, CASE WHEN length(seq) >= 20 THEN length(substr(seq, 21)) END::BIGINT AS cdna_len FROM reads")
def sql_extract_protocol(spark, d):
    """A protocol's layout as a table function in SQL."""
    register_tables(spark)
    views.reads(spark, d).select("rec_no", "seq").createOrReplaceTempView("helixframe_reads")
    return spark.sql("SELECT rec_no, barcode, umi, CAST(length(cdna) AS BIGINT) AS cdna_len FROM extract_protocol(TABLE(helixframe_reads), protocol => 'drop-seq')")


@query(f"WITH {EXTRACTED} SELECT e.barcode AS cell, r.gene, count(*)::BIGINT AS n_reads, count(DISTINCT e.umi)::BIGINT AS n_umis FROM extracted e JOIN reads r ON r.rec_no = e.rec_no WHERE e.barcode IS NOT NULL GROUP BY ALL")
def sql_umi_counts(spark, d):
    """Reads and UMIs of each cell and gene by a table function over partitions."""
    register_tables(spark)
    found = reads.extract(views.reads(spark, d)).where("barcode is not null").select(F.col("barcode").alias("cell"), "gene", "umi")
    found.createOrReplaceTempView("helixframe_found")
    return spark.sql("SELECT * FROM umi_counts(TABLE(helixframe_found) PARTITION BY (cell, gene) ORDER BY umi)")


# ---- barcodes


@query(f"WITH {EXTRACTED} SELECT DISTINCT e.barcode, CASE WHEN wl.barcode IS NULL THEN 'no_match' ELSE 'exact' END AS status FROM extracted e LEFT JOIN wl ON e.barcode = wl.barcode WHERE e.barcode IS NOT NULL")
def barcode_exact(spark, d):
    found = reads.extract(views.reads(spark, d)).where("barcode is not null")
    return barcodes.match_exact(found, views.whitelist(spark, d))


@query(f"WITH {CORRECTED} SELECT barcode, status, corrected, distance::BIGINT AS distance FROM fixed")
def barcode_correct_d1(spark, d):
    found = reads.extract(views.reads(spark, d))
    return barcodes.correct(found, views.whitelist(spark, d), 1).select("barcode", "status", "corrected", *long("distance"))


@query(
    f"""WITH {CORRECTED}, two AS (SELECT DISTINCT CASE WHEN rec_no % 7 = 0 AND length(barcode) = 16 THEN translate(substr(barcode, 1, 2), 'ACGTN', 'GTACA') || substr(barcode, 3) ELSE barcode END AS barcode FROM extracted WHERE barcode IS NOT NULL),
    near AS (SELECT t.barcode, w.barcode AS original, hamming(t.barcode, w.barcode) AS dist FROM two t, wl w WHERE hamming(t.barcode, w.barcode) <= 2),
    best AS (SELECT barcode, min(dist) AS dist FROM near GROUP BY barcode),
    ties AS (SELECT n.barcode, n.dist, count(*) AS c, min(original) AS original FROM near n JOIN best b ON n.barcode = b.barcode AND n.dist = b.dist GROUP BY ALL)
    SELECT t.barcode, CASE WHEN wl.barcode IS NOT NULL THEN 'exact' WHEN i.n = 1 THEN 'corrected' WHEN i.n > 1 THEN 'no_match' WHEN s.c = 1 THEN 'corrected' ELSE 'no_match' END AS status,
    CASE WHEN wl.barcode IS NOT NULL THEN wl.barcode WHEN i.n = 1 THEN i.original WHEN i.n > 1 THEN NULL WHEN s.c = 1 THEN s.original END AS corrected,
    (CASE WHEN wl.barcode IS NOT NULL THEN 0 WHEN i.n = 1 THEN 1 WHEN i.n > 1 THEN 0 WHEN s.c = 1 THEN s.dist ELSE 0 END)::BIGINT AS distance
    FROM two t LEFT JOIN wl ON t.barcode = wl.barcode LEFT JOIN idx i ON t.barcode = i.variant LEFT JOIN ties s ON t.barcode = s.barcode"""
)
def barcode_correct_d2(spark, d):
    found = reads.extract(views.reads(spark, d))
    two = F.when((F.col("rec_no") % 7 == 0) & (F.length("barcode") == 16), F.concat(F.translate(F.substring("barcode", 1, 2), "ACGTN", "GTACA"), F.substring("barcode", 3, 16))).otherwise(F.col("barcode"))
    return barcodes.correct(found.select(two.alias("barcode")), views.whitelist(spark, d), 2).select("barcode", "status", "corrected", *long("distance"))


@query(f"WITH {CORRECTED} SELECT rec_no, status, cell, distance::BIGINT AS distance FROM matched")
def barcode_correct_batch(spark, d):
    found = pipelines.extract(views.reads(spark, d), views.whitelist(spark, d), min_barcode_qual=None)
    return found.select("rec_no", "status", "cell", *long("distance"))


@query(f"WITH {CORRECTED}, near AS (SELECT DISTINCT e.barcode, w.barcode AS other, hamming(e.barcode, w.barcode)::BIGINT AS distance FROM extracted e JOIN wl w ON hamming(e.barcode, w.barcode) <= 6 WHERE e.barcode IS NOT NULL), best AS (SELECT barcode, min(distance) AS distance FROM near GROUP BY ALL) SELECT n.barcode, n.distance, count(*)::BIGINT AS n, min(other) AS original FROM near n JOIN best b ON n.barcode = b.barcode AND n.distance = b.distance GROUP BY ALL")
def hamming_pairs(spark, d):
    """Nearest whitelist entries within six bases of every distinct barcode, and how many there are."""
    seen = graph.checkpointed(reads.extract(views.reads(spark, d)).where("barcode is not null").select("barcode").distinct())
    wl = graph.checkpointed(views.whitelist(spark, d))
    return barcodes.nearest(seen, wl, 6).select("barcode", *long("distance"), "n", "original")


@query(f"WITH {CORRECTED} SELECT variant, n::BIGINT AS n, original FROM idx")
def one_mismatch_neighbors(spark, d):
    return barcodes.mismatch_index(views.whitelist(spark, d))


@query("SELECT DISTINCT trim(c_mktsegment) AS barcode FROM customer WHERE trim(c_mktsegment) <> '' AND trim(c_mktsegment) NOT LIKE '#%'")
def whitelist_rules(spark, d):
    return whitelist_lines(views.table(spark, d, "customer").select(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("value")))


# ---- UMIs

UMIS = CORRECTED + ", counted AS (SELECT gene, cell, umi, count(*)::BIGINT AS n FROM matched WHERE cell IS NOT NULL GROUP BY ALL)"


def counted_umis(spark, d):
    return umis.exact_umis(pipelines.extract(views.reads(spark, d), views.whitelist(spark, d), min_barcode_qual=None).where("cell is not null"))


#: UMIs of four bases, so that many are one base apart.
SHORT = "short AS (SELECT gene, event_type AS cell, translate(substr(md5((event_id % 97)::VARCHAR), 1, 4), '0123456789abcdef', 'ACGTACGTACGTACGT') AS umi, count(*)::BIGINT AS n FROM ev GROUP BY ALL)"


def short_umis(spark, d):
    e = views.table(spark, d, "events")
    rows = e.select(views.gene_of(F.col("props")).alias("gene"), F.col("event_type").alias("cell"), views.dna(F.col("event_id") % 97, 4).alias("umi"))
    return umis.exact_umis(rows)


@query(f"WITH {CORRECTED} SELECT gene, cell, count(DISTINCT umi)::BIGINT AS n_umis, min(umi) AS umi FROM matched WHERE cell IS NOT NULL GROUP BY ALL")
def umi_distinct(spark, d):
    return pipelines.count_umis(views.reads(spark, d), views.whitelist(spark, d))


@query(f"WITH {UMIS} SELECT * FROM counted")
def umi_exact(spark, d):
    return counted_umis(spark, d)


@query(f"WITH {READS}, {SHORT} SELECT a.gene, a.cell, a.umi AS a, b.umi AS b, hamming(a.umi, b.umi)::BIGINT AS distance FROM short a JOIN short b ON a.gene = b.gene AND a.cell = b.cell AND a.umi < b.umi WHERE hamming(a.umi, b.umi) <= 1")
def umi_hamming_edges(spark, d):
    return umis.umi_edges(short_umis(spark, d), 1).select("gene", "cell", "a", "b", *long("distance"))


@query(
    f"""WITH RECURSIVE {READS}, {SHORT},
    edges AS (SELECT a.gene, a.cell, a.umi AS a, b.umi AS b FROM short a JOIN short b ON a.gene = b.gene AND a.cell = b.cell WHERE hamming(a.umi, b.umi) <= 1),
    reach AS (SELECT gene, cell, umi, umi AS other FROM short UNION SELECT r.gene, r.cell, r.umi, e.b FROM reach r JOIN edges e ON r.gene = e.gene AND r.cell = e.cell AND r.other = e.a),
    comps AS (SELECT gene, cell, umi, min(other) AS comp FROM reach GROUP BY ALL)
    SELECT c.gene, c.cell, arg_min(c.umi, (-s.n, c.umi)) AS representative, count(*)::BIGINT AS n_members, sum(s.n)::BIGINT AS total
    FROM comps c JOIN short s ON c.gene = s.gene AND c.cell = s.cell AND c.umi = s.umi GROUP BY c.gene, c.cell, c.comp"""
)
def umi_components(spark, d):
    return umis.umi_groups(short_umis(spark, d), 1).select("gene", "cell", "representative", "n_members", "total")


# ---- matrix


@query(f"WITH {COUNTS_B} SELECT dense_rank() OVER (ORDER BY gene) - 1 AS gene_idx, dense_rank() OVER (ORDER BY barcode) - 1 AS cell_idx, n FROM counts")
def count_coo(spark, d):
    return matrix.coo(views.counts_b(spark, d))


@query(f"WITH {COUNTS_B} SELECT 'CELL_' || lpad(c_custkey::VARCHAR, 6, '0') AS barcode, coalesce(sum(n), 0)::BIGINT AS total FROM customer LEFT JOIN counts ON barcode = 'CELL_' || lpad(c_custkey::VARCHAR, 6, '0') GROUP BY ALL")
def counts_per_cell(spark, d):
    return matrix.counts_per_cell(views.counts_b(spark, d), views.customers(spark, d))


@query(f"WITH {COUNTS_B} SELECT gene, sum(n)::BIGINT AS total FROM counts GROUP BY ALL")
def counts_per_gene(spark, d):
    return matrix.counts_per_gene(views.counts_b(spark, d))


@query(f"WITH {COUNTS_B} SELECT 'CELL_' || lpad(c_custkey::VARCHAR, 6, '0') AS barcode, count(DISTINCT gene)::BIGINT AS n_genes FROM customer LEFT JOIN counts ON barcode = 'CELL_' || lpad(c_custkey::VARCHAR, 6, '0') GROUP BY ALL")
def genes_per_cell(spark, d):
    return matrix.genes_per_cell(views.counts_b(spark, d), views.customers(spark, d))


@query(f"WITH {COUNTS_B} SELECT gene, count(DISTINCT barcode)::BIGINT AS n_cells FROM counts GROUP BY ALL")
def cells_per_gene(spark, d):
    return matrix.cells_per_gene(views.counts_b(spark, d))


@query(f"WITH {COUNTS_B} SELECT count(DISTINCT gene)::BIGINT AS n_genes, count(DISTINCT barcode)::BIGINT AS n_cells, count(*)::BIGINT AS nnz, sum(n)::BIGINT AS total FROM counts")
def matrix_dims(spark, d):
    return matrix.dims(views.counts_b(spark, d))


@query(f"WITH {COUNTS_A} SELECT coalesce(sum(n), 0)::BIGINT AS n FROM counts WHERE gene = 'GENE_0007' AND barcode = 'CELL_000007'")
def matrix_get(spark, d):
    return matrix.value_at(views.counts_a(spark, d), "GENE_0007", "CELL_000007")


@query(f"WITH {CORRECTED} SELECT umi AS gene, cell AS barcode, count(*)::BIGINT AS n FROM matched WHERE cell IS NOT NULL AND q >= 10 GROUP BY ALL")
def shard_merge(spark, d):
    rows, wl = views.reads(spark, d), views.whitelist(spark, d)
    return matrix.merge([pipelines.shard_counts(rows, wl, 3, i) for i in range(3)])


@query(
    f"""WITH {COUNTS_B}, ix AS (SELECT dense_rank() OVER (ORDER BY gene) - 1 AS gene_idx, dense_rank() OVER (ORDER BY barcode) - 1 AS cell_idx, n FROM counts),
    packed AS (SELECT gene_idx, count(*) AS c, list(cell_idx ORDER BY cell_idx) AS cells, list(n ORDER BY cell_idx) AS vals FROM ix GROUP BY gene_idx)
    SELECT gene_idx, coalesce(sum(c) OVER (ORDER BY gene_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, array_to_string(cells, ',') AS cells, array_to_string(vals, ',') AS values FROM packed"""
)
def csr_indptr(spark, d):
    counts = views.counts_b(spark, d)
    packed = matrix.csr(matrix.coo(counts), matrix.genes(counts))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return packed.select("gene_idx", "start", join("cells"), join("values"))


@query("SELECT p_brand AS gene, p_type AS barcode, sum(p_size)::BIGINT AS n FROM part GROUP BY ALL HAVING sum(p_size) > 0")
def matrix_from_dense(spark, d):
    sums = views.table(spark, d, "part").groupBy(F.col("p_brand").alias("gene"), "p_type").agg(F.sum("p_size").alias("n"))
    rows = sums.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("values"))
    return matrix.from_dense(rows)


@query(f"WITH {COUNTS_B}, g AS (SELECT DISTINCT gene FROM counts), c AS (SELECT 'CELL_' || lpad(c_custkey::VARCHAR, 6, '0') AS barcode FROM customer) SELECT g.gene, c.barcode, coalesce(n, 0)::BIGINT AS n FROM g CROSS JOIN c LEFT JOIN counts ON g.gene = counts.gene AND c.barcode = counts.barcode")
def matrix_to_dense(spark, d):
    counts = views.counts_b(spark, d)
    return matrix.dense(counts, counts, views.customers(spark, d))


@query("SELECT p_brand AS gene, p_type AS barcode, arg_max(p_size, p_partkey)::BIGINT AS n FROM part GROUP BY ALL")
def matrix_last_wins(spark, d):
    return matrix.last_wins(views.table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("barcode"), F.col("p_size").cast("long").alias("n"), F.col("p_partkey").alias("line_no")))


@query(f"WITH {COUNTS_B}, ix AS (SELECT dense_rank() OVER (ORDER BY gene) AS r, dense_rank() OVER (ORDER BY barcode) AS c, n FROM counts) SELECT r || ' ' || c || ' ' || n AS line FROM ix")
def mtx_triples(spark, d):
    return matrix_lines(views.counts_b(spark, d))


# ---- quality


CELLS = COUNTS_A + ", cells AS (SELECT barcode, count(DISTINCT gene)::BIGINT AS n_genes, sum(n)::BIGINT AS total, round(100.0::DOUBLE * sum(n) FILTER (gene LIKE 'MT-%' OR gene LIKE 'mt-%') / sum(n), 6) AS mito0 FROM counts GROUP BY ALL), cm AS (SELECT barcode, n_genes, total, coalesce(mito0, 0)::DOUBLE AS mito_percent FROM cells)"


def cell_table(spark, d):
    return qc.cell_metrics(views.counts_a(spark, d))


@query(f"WITH {CELLS} SELECT * FROM cm")
def qc_cell_metrics(spark, d):
    return cell_table(spark, d)


@query(
    f"""WITH {CELLS} SELECT count(*)::BIGINT AS n_cells, round(avg(n_genes), 6) AS mean_n_genes, round(avg(total), 6) AS mean_total, floor(median(n_genes))::BIGINT AS int_median_n_genes, floor(median(total))::BIGINT AS int_median_total,
    list_sort(list(n_genes))[count(*) // 2 + 1]::BIGINT AS median_n_genes, list_sort(list(total))[count(*) // 2 + 1]::BIGINT AS median_total FROM cm"""
)
def qc_summary(spark, d):
    return qc.summary(cell_table(spark, d))


RATES = "totals AS (SELECT event_type, count(*)::BIGINT AS total_reads, count(*) FILTER (event_id % 10 <> 3)::BIGINT AS valid_reads, count(*) FILTER (event_id % 10 <> 3 AND event_id % 61 >= 10)::BIGINT AS mapped_reads, count(*) FILTER (event_id % 10 <> 3 AND event_id % 61 >= 30)::BIGINT AS assigned_reads, count(DISTINCT event_id % 500)::BIGINT AS unique_umis FROM events GROUP BY ALL), rates AS (SELECT *, round(valid_reads / total_reads, 6) AS barcode_validity, round(mapped_reads / valid_reads, 6) AS mapping_rate, round(assigned_reads / mapped_reads, 6) AS assignment_rate, round(1 - unique_umis / assigned_reads, 6) AS saturation FROM totals)"


def rate_table(spark, d):
    i = F.col("event_id")
    valid = i % 10 != 3
    totals = views.table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_reads"), F.count_if(valid).alias("valid_reads"), F.count_if(valid & (i % 61 >= 10)).alias("mapped_reads"), F.count_if(valid & (i % 61 >= 30)).alias("assigned_reads"), F.count_distinct(i % 500).alias("unique_umis")
    )
    return qc.rates(totals)


@query(f"WITH {RATES} SELECT * FROM rates")
def qc_rates(spark, d):
    return rate_table(spark, d)


@query(
    f"WITH {RATES} SELECT event_type, concat_ws('; ', CASE WHEN barcode_validity < 0.5 THEN 'low barcode validity' END, CASE WHEN mapping_rate < 0.5 THEN 'low mapping rate' END, CASE WHEN saturation < 0.3 THEN 'low sequencing saturation' END, CASE WHEN unique_umis < 200 THEN 'low median genes per cell' END) AS warnings FROM rates"
)
def qc_warnings(spark, d):
    rows = qc.warnings_of(rate_table(spark, d).withColumn("median_genes", F.col("unique_umis")))
    return rows.select("event_type", F.array_join("warnings", "; ").alias("warnings"))


@query(
    f"WITH {RATES} SELECT event_type, concat_ws('; ', CASE WHEN 100 * barcode_validity < 50 THEN 'valid barcodes under 50 %' END, CASE WHEN unique_umis < 500 THEN 'median genes under 500' END, CASE WHEN assigned_reads < 100 THEN 'fewer than 100 cells' END) AS warnings FROM rates"
)
def qc_live_warnings(spark, d):
    rows = rate_table(spark, d).withColumns({"valid_percent": 100 * F.col("barcode_validity"), "median_genes": F.col("unique_umis"), "n_cells": F.col("assigned_reads")})
    return qc.live_warnings(rows).select("event_type", F.array_join("warnings", "; ").alias("warnings"))


@query(f"WITH {CELLS} SELECT barcode, n_genes FROM cm WHERE n_genes >= 40 AND n_genes < 60 AND mito_percent < 6.0")
def cell_filter(spark, d):
    return qc.filter_cells(cell_table(spark, d), 40, 60, 6.0).select("barcode", "n_genes")


@query(f"WITH {CELLS} SELECT count(*) FILTER (n_genes BETWEEN 40 AND 60)::BIGINT AS passing, count(*)::BIGINT AS n_cells FROM cm")
def cells_passing(spark, d):
    cells = cell_table(spark, d)
    return cells.agg(F.count_if(qc.passing(cells, 40, 60)).alias("passing"), F.count(F.lit(1)).alias("n_cells"))


@query(f"WITH {COUNTS_A} SELECT * FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY gene HAVING count(DISTINCT barcode) >= 70)")
def gene_filter(spark, d):
    return qc.filter_genes(views.counts_a(spark, d), 70)


@query(f"WITH {CELLS} SELECT barcode, mito_percent FROM cm")
def mito_percent(spark, d):
    return cell_table(spark, d).select("barcode", "mito_percent")


@query(f"WITH {CELLS} SELECT barcode, total, row_number() OVER (ORDER BY total DESC, barcode) AS rank FROM cm")
def knee_rank(spark, d):
    return qc.knee(cell_table(spark, d))


@query(
    f"""WITH {CELLS}, cl AS (SELECT *, substr(barcode, 11, 1) AS cluster FROM cm) SELECT cluster, count(*)::BIGINT AS n_cells, list_sort(list(n_genes))[count(*) // 2 + 1]::BIGINT AS median_genes,
    list_sort(list(total))[count(*) // 2 + 1]::BIGINT AS median_total, round(100 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM cl GROUP BY cluster"""
)
def cluster_stats(spark, d):
    return qc.cluster_stats(cell_table(spark, d).withColumn("cluster", F.substring("barcode", 11, 1)))


@query(f"WITH {CELLS} SELECT (total // 5 * 5)::BIGINT AS bucket, count(*)::BIGINT AS n FROM cm GROUP BY 1")
def qc_histogram(spark, d):
    return qc.histogram(cell_table(spark, d), "total", 5)


@query(f"WITH {RATES} SELECT 'sample' AS sample_name, to_json({{'event_type': event_type, 'total_reads': total_reads, 'valid_reads': valid_reads}}) AS report FROM rates")
def report_json(spark, d):
    return qc.report(rate_table(spark, d).select("event_type", "total_reads", "valid_reads"))


@query(f"WITH {CELLS}, cl AS (SELECT *, substr(barcode, 11, 1) AS cluster FROM cm) SELECT barcode, cluster, total FROM cl WHERE cluster IN ('1', '3')")
def cluster_filter(spark, d):
    cells = cell_table(spark, d).withColumn("cluster", F.substring("barcode", 11, 1))
    return qc.of_clusters(cells, ["1", "3"]).select("barcode", "cluster", "total")


@query(f"WITH {CELLS} SELECT barcode, 'n_genes' AS metric, n_genes::DOUBLE AS value FROM cm UNION ALL SELECT barcode, 'mito_percent', mito_percent FROM cm")
def violin_rows(spark, d):
    """Those of the keys asked for that the cells have."""
    return qc.long_metrics(cell_table(spark, d), ("n_genes", "no_such_key", "mito_percent"))


@query(
    f"""WITH {CORRECTED}, u AS (SELECT gene, cell AS barcode, count(DISTINCT umi)::BIGINT AS n FROM matched WHERE cell IS NOT NULL GROUP BY ALL), pc AS (SELECT barcode, count(*) AS n_genes, sum(n) AS total FROM u GROUP BY ALL)
    SELECT 'job' AS job_id, (SELECT count(*) FROM matched)::BIGINT AS total_reads, (SELECT count(cell) FROM matched)::BIGINT AS valid_barcodes, (SELECT count(*) FROM matched WHERE status = 'corrected')::BIGINT AS corrected_barcodes, (SELECT count(*) - count(cell) FROM matched)::BIGINT AS invalid_barcodes,
    (SELECT count(*) FROM pc)::BIGINT AS cells, (SELECT count(DISTINCT gene) FROM u)::BIGINT AS genes, (SELECT list_sort(list(n_genes))[count(*) // 2 + 1] FROM pc)::BIGINT AS median_genes_per_cell, (SELECT list_sort(list(total))[count(*) // 2 + 1] FROM pc)::BIGINT AS median_umis_per_cell"""
)
def web_report(spark, d):
    found = graph.checkpointed(pipelines.extract(views.reads(spark, d), views.whitelist(spark, d), min_barcode_qual=None))
    counts = umis.distinct_umis(found.where("cell is not null and gene is not null")).select("gene", F.col("cell").alias("barcode"), F.col("n_umis").alias("n"))
    return qc.web_report("job", reads.extraction_counters(found), qc.cell_metrics(counts), counts)


@query(f"WITH {CELLS}, t AS (SELECT count(*)::BIGINT AS total_reads, count(*) FILTER (event_id % 10 <> 3)::BIGINT AS valid_reads FROM events) SELECT count(*)::BIGINT AS n_cells, count(*) FILTER (n_genes BETWEEN 40 AND 60)::BIGINT AS cells_passing, any_value(round(valid_reads / total_reads, 6)) AS barcode_validity, list_sort(list(n_genes))[count(*) // 2 + 1]::BIGINT AS median_genes FROM cm, t")
def sample_report(spark, d):
    """The qc command: metrics of a sample with the rates of its reads."""
    valid = F.col("event_id") % 10 != 3
    totals = views.table(spark, d, "events").agg(F.count(F.lit(1)).alias("total_reads"), *[F.count_if(valid).alias(c) for c in ("valid_reads", "mapped_reads", "assigned_reads", "unique_umis")])
    return pipelines.sample_qc(views.counts_a(spark, d), "s", totals, 40, 60).select("n_cells", "cells_passing", "barcode_validity", "median_genes")


# ---- analysis

NORMALIZED = COUNTS_B + ", norm AS (SELECT gene, barcode, n, n * 10000.0::DOUBLE / sum(n) OVER (PARTITION BY barcode) AS x FROM counts), logged AS (SELECT gene, barcode, ln(1 + x) AS x FROM norm), nc AS (SELECT count(DISTINCT barcode) AS c FROM counts), stats AS (SELECT gene, sum(x) / any_value(c) AS mean, sum(x * x) / any_value(c) - (sum(x) / any_value(c)) ** 2 AS variance FROM logged, nc GROUP BY gene)"


def logged(spark, d):
    return analysis.log1p(analysis.normalize_total(views.counts_b(spark, d)))


def stats(spark, d):
    counts = views.counts_b(spark, d)
    return analysis.gene_stats(analysis.log1p(analysis.normalize_total(counts)), counts.select("barcode").distinct().count())


@query(f"WITH {NORMALIZED} SELECT gene, barcode, round(x, 6) AS x FROM norm")
def normalize_total(spark, d):
    return analysis.normalize_total(views.counts_b(spark, d)).select("gene", "barcode", F.round("x", 6).alias("x"))


@query(f"WITH {NORMALIZED} SELECT gene, barcode, round(x, 6) AS x FROM logged")
def log1p_norm(spark, d):
    return logged(spark, d).select("gene", "barcode", F.round("x", 6).alias("x"))


@query(f"WITH {NORMALIZED} SELECT gene, round(mean, 6) AS mean, round(variance / mean, 6) AS dispersion FROM stats WHERE mean BETWEEN 0.0125 AND 7 AND variance / mean >= 0.5")
def hvg(spark, d):
    return analysis.variable_genes(stats(spark, d), 0.0125, 7.0, 0.5).select("gene", F.round("mean", 6).alias("mean"), F.round("dispersion", 6).alias("dispersion"))


@query(f"WITH {NORMALIZED} SELECT gene FROM stats ORDER BY round(variance / mean, 9) DESC, gene LIMIT 10")
def hvg_top_n(spark, d):
    return analysis.top_genes(stats(spark, d), 10).select("gene")


@query(f"WITH {GRID}, s AS (SELECT gene, avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT gene, greatest(x, 0) AS x FROM grid) GROUP BY gene) SELECT g.gene, g.barcode, round(greatest(least((greatest(x, 0) - m) / greatest(sd, 1e-12), 2.0), -2.0), 5) AS z FROM grid g JOIN s ON g.gene = s.gene")
def scale_clip(spark, d):
    """Positive components only are entries; scaling brings the zeros back."""
    grid = views.vector_grid(spark, d)
    return analysis.scale(grid.where("x > 0"), grid, 2.0).select("gene", "barcode", F.round("z", 5).alias("z"))


KNN = """cosines AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM cosines), graph AS (SELECT * FROM ranked WHERE rank <= 5)"""


@query(f"WITH {KNN} SELECT src, dst, rank, round(dist, 6) AS dist FROM graph")
def knn_graph(spark, d):
    links = analysis.knn(views.vectors(spark, d), 5)
    return links.select("src", "dst", *long("rank"), (F.round(F.col("dist") * 1e6) / 1e6).alias("dist"))  # as in SQL: not by decimal digits, which differ for halves


@query("SELECT (count(*) * 5)::BIGINT AS links, TRUE AS recalled FROM embeddings")
def knn_forest_recall(spark, d):
    """Neighbours from a forest of as many trees as they need, all links of the table, and whether an audit of its own finds 95 % of the true ones."""
    vectors = views.vectors(spark, d)
    links = graph.checkpointed(neighbours.knn_recalled(vectors, 5))
    found = neighbours.recall(vectors, links)
    return links.agg(F.count(F.lit(1)).alias("links")).withColumn("recalled", F.lit(found >= 0.95))


@query(f"WITH {KNN} SELECT DISTINCT src, dst FROM (SELECT src, dst FROM graph UNION ALL SELECT dst, src FROM graph)")
def knn_connectivity(spark, d):
    return analysis.connectivity(analysis.knn(views.vectors(spark, d), 5))


def scaled_genes(spark, d):
    return analysis.scaled_cells(logged(spark, d), matrix.cells(views.counts_b(spark, d)))


@query()
def pca_variance(spark, d):
    """Variances of the ten first components; a test holds them against numpy."""
    _, variances = analysis.pca_scaled(scaled_genes(spark, d), 10)
    return spark.createDataFrame(list(enumerate(variances)), "component int, variance double")


@query(
    f"""WITH {NORMALIZED}, cl AS (SELECT DISTINCT barcode FROM counts), full_grid AS (SELECT g.gene, cl.barcode, coalesce(l.x, 0) AS x FROM (SELECT DISTINCT gene FROM counts) g CROSS JOIN cl LEFT JOIN logged l ON l.gene = g.gene AND l.barcode = cl.barcode),
    s AS (SELECT gene, avg(x) AS m, stddev_pop(x) AS sd FROM full_grid GROUP BY gene), z AS (SELECT f.gene, barcode, greatest(least((x - m) / greatest(sd, 1e-12), 10.0), -10.0) AS z FROM full_grid f JOIN s ON s.gene = f.gene),
    products AS (SELECT a.gene AS i, b.gene AS j, sum(a.z * b.z) / (SELECT count(*) FROM cl) AS v FROM z a JOIN z b ON a.barcode = b.barcode GROUP BY ALL)
    SELECT (SELECT count(*) FROM s)::BIGINT AS components, round(sum(v) FILTER (i = j), 6) AS total, round(sum(v * v), 4) AS squares FROM products"""
)
def pca_moments(spark, d):
    """Of all components: the variances add up to the trace of the genes' products, and their squares to its squared norm."""
    scaled = scaled_genes(spark, d)
    _, variances = analysis.pca_scaled(scaled, len(scaled.zeros))
    kept = spark.createDataFrame([(v,) for v in variances], "v double")
    total = kept.agg(F.round(F.sum("v"), 6).alias("total"), F.round(F.sum(F.col("v") * F.col("v")), 4).alias("squares"))
    genes = scaled.rows.select(F.explode("genes").alias("g")).agg(F.count_distinct("g").alias("components"))
    return genes.crossJoin(total)  # one row each


@query()
def label_propagation(spark, d):
    """A test holds it against one loop over the nodes."""
    edges = graph.checkpointed(analysis.knn(views.vectors(spark, d), 5))
    return graph.label_propagation(spark, edges.select(F.col("src").alias("node")), edges.select("src", "dst", "dist"))


@query()
def leiden_clusters(spark, d):
    """Communities of the neighbour graph; tests hold them against planted partitions."""
    links = graph.checkpointed(analysis.connectivity(analysis.knn(views.vectors(spark, d), 5)).where("src < dst").withColumn("w", F.lit(1.0)))
    return leiden.leiden(views.vectors(spark, d).select("node"), links)


@query()
def analyze_clusters(spark, d):
    """Counts to cluster sizes, through all steps."""
    return analysis.cluster_sizes(pipelines.analyze(views.counts_b(spark, d), n_pcs=10, n_neighbors=10, max_mean=20.0, min_disp=0.0)["clusters"])


@query(
    f"""WITH {NORMALIZED}, cl AS (SELECT DISTINCT barcode, (substr(barcode, 11, 1)::INT % 3)::BIGINT AS cluster FROM counts), full_grid AS (SELECT g.gene, cl.barcode, cl.cluster, coalesce(l.x, 0) AS x FROM (SELECT DISTINCT gene FROM counts) g CROSS JOIN cl LEFT JOIN logged l ON l.gene = g.gene AND l.barcode = cl.barcode),
    ranked AS (SELECT gene, cluster, rank() OVER (PARTITION BY gene ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY gene, round(x, 9)) - 1) / 2 AS r FROM full_grid),
    sums AS (SELECT gene, cluster, sum(r) AS r, count(*)::DOUBLE AS m FROM ranked GROUP BY ALL), total AS (SELECT count(*)::DOUBLE AS n FROM cl),
    scored AS (SELECT cluster, gene, round((r - m * (n + 1) / 2) / sqrt(m * (n - m) * (n + 1) / 12), 6) AS z FROM sums, total)
    SELECT * FROM (SELECT cluster, gene, z, row_number() OVER (PARTITION BY cluster ORDER BY z DESC, gene) AS rank FROM scored) WHERE rank <= 5"""
)
def marker_ranksum(spark, d):
    values = logged(spark, d).withColumn("x", F.round("x", 9))
    clusters = views.counts_b(spark, d).select("barcode", (F.substring("barcode", 11, 1).cast("long") % 3).alias("cluster")).distinct()
    return analysis.markers(values, clusters, 5).select("cluster", "gene", "z", *long("rank"))


# ---- validation

CONFUSION = "c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::BIGINT AS tp, count(*) FILTER (quality = 0 AND toxic = 1)::BIGINT AS fp, count(*) FILTER (quality = 0 AND toxic = 0)::BIGINT AS tn, count(*) FILTER (quality = 1 AND toxic = 0)::BIGINT AS fn FROM labels)"
RATED = "tp, fp, tn, fn, coalesce(round(tp / nullif(tp + fn, 0), 9), 0) AS sensitivity, coalesce(round(tn / nullif(tn + fp, 0), 9), 0) AS specificity, coalesce(round(tp / nullif(tp + fp, 0), 9), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 9), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 9), 0) AS f1"


@query(f"WITH {CONFUSION} SELECT {RATED} FROM c")
def confusion_metrics(spark, d):
    rows = views.table(spark, d, "labels")
    return validation.rated(validation.confusion(rows, F.col("quality") == 1, F.col("toxic") == 1))


@query(
    f"""WITH {CORRECTED}, t AS (SELECT barcode FROM wl), dd AS (SELECT DISTINCT corrected AS barcode FROM fixed WHERE corrected IS NOT NULL UNION SELECT barcode FROM fixed WHERE status = 'no_match'), o AS (SELECT barcode FROM fixed),
    c AS (SELECT (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM dd))::BIGINT AS tp, (SELECT count(*) FROM (SELECT * FROM dd EXCEPT SELECT * FROM t))::BIGINT AS fp, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM t EXCEPT SELECT * FROM dd))::BIGINT AS tn, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM dd))::BIGINT AS fn)
    SELECT {RATED} FROM c"""
)
def barcode_detection_sets(spark, d):
    fixed = graph.checkpointed(barcodes.correct(reads.extract(views.reads(spark, d)), views.whitelist(spark, d), 1))
    detected = fixed.where("corrected is not null").select(F.col("corrected").alias("barcode")).union(fixed.where("status = 'no_match'").select("barcode"))
    return validation.detection_sets(views.whitelist(spark, d), detected, fixed)


@query(
    f"""WITH {CORRECTED}, k AS (SELECT rec_no, status, cell, true_barcode, rec_no % 10 = 0 AS mutation, rec_no % 20 = 1 AND barcode LIKE 'NNNNN%' AS bad FROM matched WHERE barcode IS NOT NULL),
    c AS (SELECT count(*) FILTER (status = 'exact' OR status = 'corrected' AND (mutation AND cell = true_barcode OR NOT mutation AND NOT bad))::BIGINT AS tp,
      count(*) FILTER (status = 'corrected' AND (mutation AND cell <> true_barcode OR NOT mutation AND bad))::BIGINT AS fp, count(*) FILTER (status = 'no_match' AND bad)::BIGINT AS tn, count(*) FILTER (status = 'no_match' AND NOT bad)::BIGINT AS fn,
      count(*) FILTER (status <> 'exact' AND mutation)::BIGINT AS total_mutations, count(*) FILTER (status = 'corrected' AND mutation AND cell = true_barcode)::BIGINT AS correct_corrections FROM k)
    SELECT {RATED}, total_mutations, correct_corrections, CASE WHEN total_mutations = 0 THEN 1.0::DOUBLE ELSE round(correct_corrections / total_mutations, 9) END AS correction_accuracy FROM c"""
)
def extract_confusion(spark, d):
    """Each read has a truth of its own, as barcodes of several users may be mutated to the same sequence; the whitelist is the truth, so exact ones are known."""
    rows = pipelines.extract(views.reads(spark, d), views.whitelist(spark, d), min_barcode_qual=None).where("barcode is not null")
    i, right = F.col("rec_no"), F.coalesce(F.col("cell") == F.col("true_barcode"), F.lit(False))
    bad = (i % 20 == 1) & F.col("barcode").startswith("NNNNN")
    return validation.read_confusion(rows.select("status", F.lit(True).alias("known"), bad.alias("bad"), (i % 10 == 0).alias("mutation"), right.alias("right")))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def pearson(spark, d):
    return validation.correlation(views.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, d):
    return validation.spearman(views.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


@query("SELECT round(avg(abs(l_discount - l_tax)), 6) AS mae, round(sqrt(avg((l_discount - l_tax) ** 2)), 6) AS rmse FROM lineitem")
def mae_rmse(spark, d):
    return validation.errors(views.table(spark, d, "lineitem"), "l_discount", "l_tax")


CLUSTERING = """pairs AS (SELECT o_orderstatus AS t, o_orderpriority AS p FROM orders), both_ AS (SELECT t, p, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL), ts AS (SELECT t, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL), ps AS (SELECT p, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM both_) AS cb, (SELECT sum(n * (n - 1) / 2) FROM ts) AS ct, (SELECT sum(n * (n - 1) / 2) FROM ps) AS cp, (SELECT count(*)::DOUBLE FROM pairs) AS n, (SELECT sum(n * ln(n)) FROM both_) AS lb, (SELECT sum(n * ln(n)) FROM ts) AS lt, (SELECT sum(n * ln(n)) FROM ps) AS lp),
e AS (SELECT *, n * (n - 1) / 2 AS ca, ln(n) - lt / n AS ht, ln(n) - lp / n AS hp, ln(n) - lb / n AS hb FROM s)"""


@query(f"WITH {CLUSTERING} SELECT round((cb - ct * cp / ca) / ((ct + cp) / 2 - ct * cp / ca), 8) AS ari FROM e")
def ari(spark, d):
    return validation.clustering_scores(views.table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select("ari")


@query(f"WITH {CLUSTERING} SELECT round(greatest(0, least(1, (ht + hp - hb) / ((ht + hp) / 2))), 8) AS nmi FROM e")
def nmi(spark, d):
    return validation.clustering_scores(views.table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select("nmi")


OBSERVED = COUNTS_B + ", obs AS (SELECT p_brand AS gene, 'CELL_' || lpad(o_custkey::VARCHAR, 6, '0') AS barcode, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 20 <> 0 GROUP BY ALL)"


def observed(spark, d):
    li, o, p = (views.table(spark, d, t) for t in ("lineitem", "orders", "part"))
    joined = li.where("l_orderkey % 20 <> 0").join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("p_brand").alias("gene"), F.format_string("CELL_%06d", "o_custkey").alias("barcode")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OBSERVED}, g AS (SELECT DISTINCT gene FROM counts), c AS (SELECT DISTINCT barcode FROM counts) SELECT g.gene, c.barcode, coalesce(counts.n, 0)::BIGINT AS truth, coalesce(obs.n, 0)::BIGINT AS observed FROM g CROSS JOIN c LEFT JOIN counts ON counts.gene = g.gene AND counts.barcode = c.barcode LEFT JOIN obs ON obs.gene = g.gene AND obs.barcode = c.barcode")
def align_matrices(spark, d):
    return validation.aligned(views.counts_b(spark, d), observed(spark, d))


@query(
    f"""WITH {OBSERVED}, a AS (SELECT barcode, sum(n) AS t FROM counts GROUP BY ALL), b AS (SELECT barcode, sum(n) AS o FROM obs GROUP BY ALL), ga AS (SELECT gene, sum(n) AS t FROM counts GROUP BY ALL), gb AS (SELECT gene, sum(n) AS o FROM obs GROUP BY ALL)
    SELECT (SELECT round(count(*) FILTER (abs(o - t)::DOUBLE / t <= 0.1) / count(*), 9) FROM a JOIN b ON a.barcode = b.barcode) AS barcode_concordance, (SELECT round(count(*) FILTER (abs(o - t)::DOUBLE / t <= 0.1) / count(*), 9) FROM ga JOIN gb ON ga.gene = gb.gene) AS gene_concordance"""
)
def concordance(spark, d):
    truth, obs = views.counts_b(spark, d), observed(spark, d)
    return validation.concordance(truth, obs, "barcode").crossJoin(F.broadcast(validation.concordance(truth, obs, "gene")))  # one row each


@query(f"WITH {CONFUSION}, r AS (SELECT {RATED} FROM c), s AS (SELECT 'extract' AS stage, f1::DOUBLE AS score, 0.95::DOUBLE AS threshold FROM r UNION ALL SELECT 'count', specificity::DOUBLE, 0.5::DOUBLE FROM r UNION ALL SELECT 'analysis', NULL, 0.7::DOUBLE) SELECT stage, coalesce(score, -1) AS score, threshold, CASE WHEN score >= threshold THEN 'passed' WHEN score < threshold THEN 'failed' ELSE 'not run' END AS outcome FROM s UNION ALL SELECT 'overall', -1, -1, CASE WHEN coalesce(bool_and(score >= threshold), false) THEN 'passed' ELSE 'failed' END FROM s")
def pass_fail(spark, d):
    r = confusion_metrics(spark, d)
    stage = lambda name, score, least: r.select(F.lit(name).alias("stage"), score.cast("double").alias("score"), F.lit(least).alias("threshold"))
    judged = validation.pass_fail(stage("extract", F.col("f1"), 0.95).unionByName(stage("count", F.col("specificity"), 0.5)).unionByName(stage("analysis", F.lit(None), 0.7)))
    outcome = F.when(F.col("passed"), "passed").when(~F.col("passed"), "failed").otherwise("not run")
    return judged.select("stage", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("score", "threshold")], outcome.alias("outcome"))


# ---- batches and live views


@query(f"WITH {CORRECTED} SELECT event_type AS sample, count(*)::BIGINT AS total_reads, count(cell)::BIGINT AS valid_reads, count(DISTINCT cell)::BIGINT AS n_cells FROM matched WHERE true GROUP BY event_type")
def batch_samples(spark, d):
    rows = views.reads(spark, d).withColumn("sample", F.col("event_type")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    return pipelines.batch(rows, views.whitelist(spark, d))


@query(
    f"""WITH {READS}, s AS (SELECT event_type AS sample, seq, true_barcode, CASE event_type WHEN 'click' THEN 12 WHEN 'view' THEN 10 ELSE 16 END AS len, CASE event_type WHEN 'click' THEN 20 WHEN 'view' THEN 18 ELSE 28 END AS least FROM reads),
    own AS (SELECT DISTINCT sample, substr(true_barcode, 1, len) AS barcode FROM s), nb AS (SELECT sample, substr(barcode, 1, p - 1) || b || substr(barcode, p + 1) AS variant, barcode FROM own, (SELECT unnest(range(1, 17)) AS p), (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) u(b) WHERE p <= length(barcode) AND substr(barcode, p::INT, 1) <> b),
    idx AS (SELECT sample, variant, count(*) AS n, min(barcode) AS original FROM nb GROUP BY ALL), seen AS (SELECT sample, CASE WHEN length(seq) >= least THEN substr(seq, 1, len) END AS barcode FROM s),
    m AS (SELECT seen.sample, CASE WHEN own.barcode IS NOT NULL THEN own.barcode WHEN idx.n = 1 THEN idx.original END AS cell FROM seen LEFT JOIN own ON seen.sample = own.sample AND seen.barcode = own.barcode LEFT JOIN idx ON seen.sample = idx.sample AND seen.barcode = idx.variant)
    SELECT sample, count(*)::BIGINT AS total_reads, count(cell)::BIGINT AS valid_reads, count(DISTINCT cell)::BIGINT AS n_cells FROM m GROUP BY sample"""
)
def batch_each(spark, d):
    """Samples with a protocol and a whitelist of their own in one job."""
    used = F.when(F.col("event_type") == "click", "drop-seq").when(F.col("event_type") == "view", "sci-rna-seq").otherwise("10x-3prime-v3")
    rows = views.reads(spark, d).select(F.col("event_type").alias("sample"), used.alias("protocol"), "seq", "qual", "true_barcode")
    size = F.when(F.col("protocol") == "drop-seq", 12).when(F.col("protocol") == "sci-rna-seq", 10).otherwise(16)
    own = rows.select("sample", F.substring("true_barcode", F.lit(1), size).alias("barcode")).distinct()
    return pipelines.batch_each(rows, own)


@query("SELECT count(*)::BIGINT AS samples, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS succeeded, count(*) FILTER (o_orderstatus <> 'F')::BIGINT AS failed FROM orders")
def batch_summary(spark, d):
    return pipelines.batch_summary(views.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status")))


@query("SELECT o_orderkey AS sample, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def compare_samples(spark, d):
    results = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_totalprice").alias("score"))
    wanted = views.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("sample"))
    return pipelines.compare_samples(results, wanted).select("sample", "score")


@query("SELECT event_type, regexp_replace(regexp_replace(event_type || ' ' || props, '[^A-Za-z0-9._-]', '_', 'g'), '^\\.+', '') AS name, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def safe_file_names(spark, d):
    rows = views.table(spark, d, "events").select("event_type", seqs.safe_file_name(F.concat_ws(" ", "event_type", "props")).alias("name"))
    return rows.groupBy("event_type", "name").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT user_id AS node, min(event_id % 7) AS label FROM events GROUP BY ALL), f AS (SELECT label, min(node) AS first FROM r GROUP BY ALL) SELECT node, number FROM r JOIN (SELECT label, row_number() OVER (ORDER BY first) - 1 AS number FROM f) g ON r.label = g.label")
def label_renumber(spark, d):
    rows = views.table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.min(F.col("event_id") % 7).alias("label"))
    return graph.renumbered(rows).select("node", F.col("label").alias("number"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*)::BIGINT AS reads, count(*) FILTER (event_type <> 'error')::BIGINT AS mapped FROM events GROUP BY ALL")
def stream_live_qc(spark, d):
    from helixframe.streaming import jobs

    return jobs.live_qc(spark, f"{d}/events.parquet")


#: Cells of events that are no errors, with event_id % 7 as UMI.
LIVE_CELLS = CELLS.replace("count(*)::BIGINT AS n FROM events", "count(DISTINCT event_id % 7)::BIGINT AS n FROM events WHERE event_type <> 'error'")


def live_folder(spark, d):
    from helixframe.streaming import jobs

    rows = views.user_cells(jobs.stream_of(spark, f"{d}/events.parquet"))
    cell = F.when(F.col("event_type") != "error", F.col("barcode"))
    folder = jobs.shared(spark, "live")
    for running in jobs.start_live_cells(rows.select(cell.alias("cell"), "gene", (F.col("event_id") % 7).cast("string").alias("umi")), folder):
        running.awaitTermination()
    return folder


@query(f"WITH {LIVE_CELLS} SELECT * FROM cm")
def stream_live_cells(spark, d):
    """Distinct UMIs of each cell from a stream, with what has been seen as state."""
    from helixframe.streaming import jobs

    return jobs.live_cells(spark, live_folder(spark, d))


@query(
    f"""WITH {LIVE_CELLS}, v AS (SELECT (SELECT round(100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*), 6) FROM events) AS valid_percent, count(*)::BIGINT AS n_cells, list_sort(list(n_genes))[count(*) // 2 + 1]::BIGINT AS median_genes FROM cm)
    SELECT *, concat_ws('; ', CASE WHEN valid_percent < 50 THEN 'valid barcodes under 50 %' END, CASE WHEN median_genes < 500 THEN 'median genes under 500' END, CASE WHEN n_cells < 100 THEN 'fewer than 100 cells' END) AS warnings FROM v"""
)
def stream_live_view(spark, d):
    from helixframe.streaming import jobs

    return jobs.live_view(spark, live_folder(spark, d)).withColumn("warnings", F.array_join("warnings", "; "))


@query(f"WITH {READS} SELECT rec_no // 3000 AS chunk, count(*)::BIGINT AS records, sum(length(seq))::BIGINT AS bases FROM reads GROUP BY ALL")
def stream_record_chunks(spark, d):
    from helixframe.streaming import jobs

    return jobs.record_chunks(views.reads(spark, d), 3000)


@query("SELECT count(*)::BIGINT AS records FROM events")
def stream_chunk_stats(spark, d):
    from helixframe.streaming import jobs

    return jobs.chunk_stats(spark, f"{d}/events.parquet")


