import gzip

import zstandard
from helixframe.operators import matrix
from helixframe.sinks import files as sinks
from helixframe.sources import files

READS = [(0, "read1", "ACGTACGT", "IIIIIIII"), (1, "read2", "AC", "!!")]


def test_fastq_plain_gzip_zstd(spark, tmp_path):
    text = "".join(f"@{i}\n{s}\n+\n{q}\n" for _, i, s, q in READS).encode()
    (tmp_path / "a.fastq").write_bytes(text)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text))
    (tmp_path / "c.fq.zst").write_bytes(zstandard.compress(text))
    for name in ("a.fastq", "b.fastq.gz", "c.fq.zst"):
        assert [tuple(r) for r in files.read_fastq(spark, str(tmp_path / name)).collect()] == READS
        assert files.looks_like_fastq(str(tmp_path / name))
    assert files.read_fastq(spark, str(tmp_path)).count() == 6


def test_fasta_has_no_quality(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(">x\nACGT\n")
    assert tuple(files.read_fastq(spark, str(tmp_path / "a.fastq")).first()) == (0, "x", "ACGT", "")


def test_fastq_round_trip(spark, tmp_path):
    df = spark.createDataFrame(READS, "rec_no long, id string, seq string, qual string")
    sinks.write_fastq(df.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part*"))
    assert [tuple(r) for r in files.read_fastq(spark, str(part)).collect()] == READS


def test_bam_round_trip_and_pushdown(spark, tmp_path):
    kind = "name string, seq string, qual binary, mapq short, tid int, pos long, cigar string, cell_barcode string, umi string, gene_name string, gene_id string, is_mapped boolean, is_reverse boolean"
    rows = [
        ("r1", "ACGTN", bytearray([30] * 5), 60, 0, 10, "5M", "CB1", "UMI1", "G1", "ENS1", True, False),
        ("r2", "ACG", bytearray([2] * 3), 5, 0, 20, "2M1S", None, None, None, "ENS2", True, True),
        ("r3", "A", bytearray([0]), 0, -1, -1, "", None, None, None, None, False, False),
    ]
    sinks.write_bam(spark.createDataFrame(rows, kind), [("chr1", 1000)], str(tmp_path / "x.bam"))
    back = files.read_bam(spark, str(tmp_path / "x.bam"))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in rows]
    assert [r["name"] for r in back.where("mapq >= 10").collect()] == ["r1"]
    assert files.read_bam(spark, str(tmp_path / "x.bam"), 5).count() == 2
    assert tuple(files.bam_references(spark, str(tmp_path / "x.bam")).first()) == (0, "chr1", 1000)
    assert files.looks_like_alignments(str(tmp_path / "x.bam"))


def test_matrix_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([("GENE1", "CELL1", 10), ("GENE2", "CELL1", 3), ("GENE1", "CELL2", 5)], "gene string, barcode string, n long")
    for compress in (False, True):
        where = str(tmp_path / str(compress))
        sinks.write_matrix(counts, where, compress)
        back = files.read_matrix(spark, where)
        assert sorted(map(tuple, back["counts"].collect())) == sorted(map(tuple, counts.collect()))
        assert matrix.dims(back["counts"]).first()["nnz"] == 3


def test_repeated_and_stray_matrix_lines(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket\n%\n2 1 3\n1 1 4\n1 1 6\n9 1 1\nx y z\n")
    (tmp_path / "barcodes.tsv").write_text("C1\n")
    (tmp_path / "genes.tsv").write_text("G1\tG1\nG2\tG2\n")
    assert [tuple(r) for r in files.read_matrix(spark, str(tmp_path))["counts"].collect()] == [("G1", "C1", 10)]
    assert files.read_matrix(spark, str(tmp_path), "last")["counts"].first()["n"] == 6


def test_whitelist_and_manifest(spark, tmp_path):
    (tmp_path / "wl.txt").write_text("# note\n\nAAAA \nCCCC\nAAAA\n")
    assert sorted(r[0] for r in files.read_whitelist(spark, str(tmp_path / "wl.txt")).collect()) == ["AAAA", "CCCC"]
    (tmp_path / "m.csv").write_text("sample_name,r1,r2,whitelist,protocol\nsample1,a,b,w,\nsample2,a,b,w,drop-seq\n")
    rows = files.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("sample_name").collect()
    assert rows[0]["sample_name"] == "sample1" and rows[1]["protocol"] == "drop-seq"
