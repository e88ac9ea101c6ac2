"""Files in ranges: FASTQ and BAM records are the same wherever files are cut."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from helixframe.sinks import bam as bam_sink
from helixframe.sources import bam, fastq, files, splits


def plain_records(data: bytes):
    """Four-line and two-line records, read line by line."""
    lines = data.replace(b"\r\n", b"\n").split(b"\n")
    out, i = [], 0
    while i < len(lines):
        if not lines[i]:
            i += 1
        elif lines[i][:1] == b"@":
            out.append((lines[i][1:], lines[i + 1], lines[i + 3]))
            i += 4
        else:
            out.append((lines[i][1:], lines[i + 1], b""))
            i += 2
    return [tuple(x.decode("utf-8", "replace") for x in r) for r in out]


def fastq_bytes(n, seed=0, ends="\n"):
    """Records whose qualities begin with @, + and > now and then."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        size = int(rng.integers(1, 12))
        qual = "".join(rng.choice(list("@+>I!#"), size=size))
        out.append(f"@r{i}{ends}{''.join(rng.choice(list('ACGTN'), size=size))}{ends}+{'r' * int(rng.integers(0, 2))}{ends}{qual}{ends}")
    return "".join(out).encode()


def read_ranges(path, size):
    out = []
    for part in splits.ranges_of([path], size):
        number = 0
        for first, columns in fastq.records(part):
            assert first == number
            rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
            number += len(rows)
            out += rows
    return out


@pytest.mark.parametrize("kind", ["plain", "returns", "no last line end", "fasta", "blank lines", "not ascii"])
def test_fastq_is_the_same_for_every_cut(tmp_path, kind):
    data = fastq_bytes(40, 1, "\r\n" if kind == "returns" else "\n")
    if kind == "no last line end":
        data = data[:-1]
    if kind == "fasta":
        data = b"".join(b">s%d\n%s\n" % (i, b"ACGT" * (i % 3 + 1)) for i in range(60))
    if kind == "blank lines":
        data = b"\n\n" + data.replace(b"\n@r7\n", b"\n\n\n@r7\n") + b"\n\n"
    if kind == "not ascii":
        data = data.replace(b"@r9\n", b"@r\xff\xc3\xa9\n")
    path = str(tmp_path / "x.fastq")
    (tmp_path / "x.fastq").write_bytes(data)
    want = plain_records(data)
    assert len(want) in (40, 60)
    for size in [*range(1, len(data) + 2, 1 if len(data) < 900 else 3)]:
        assert read_ranges(path, size) == want, size


def bgzf(data: bytes, rng) -> bytes:
    out, at = [], 0
    while at < len(data):
        size = int(rng.integers(1, 200))
        out.append(bam_sink.bgzf_block(data[at : at + size]))
        at += size
    return b"".join(out) + bam_sink.bgzf_block(b"")


def test_bgzf_is_the_same_for_every_cut(tmp_path):
    data = fastq_bytes(150, 2)
    packed = bgzf(data, np.random.default_rng(3))
    (tmp_path / "x.fastq.gz").write_bytes(packed)
    path, want = str(tmp_path / "x.fastq.gz"), plain_records(data)
    assert splits.kind_of(path) == "bgzf" and gzip.decompress(packed) == data
    for size in (1 << 20, *range(40, len(packed), 97)):
        assert read_ranges(path, size) == want, size


def test_broken_records_are_told(tmp_path):
    for text, said in (("@a\nACGT\n+\nIII\n", "4 bases and 3 qualities"), ("x\nA\n", "neither @ nor >")):
        (tmp_path / "x.fastq").write_text(text)
        with pytest.raises(ValueError, match=said):
            read_ranges(str(tmp_path / "x.fastq"), 1 << 20)


def test_fastq_numbers_run_over_ranges(spark, tmp_path):
    for name, n in (("a.fastq", 500), ("b.fastq", 7), ("c.fastq", 0)):
        (tmp_path / name).write_bytes(fastq_bytes(n, n))
    (tmp_path / "d.fastq.gz").write_bytes(gzip.compress(fastq_bytes(9, 9)) + gzip.compress(fastq_bytes(3, 3)))
    rows = fastq.read_fastq(spark, str(tmp_path), range_bytes=700)
    assert rows.rdd.getNumPartitions() > 10
    want = sorted((i, *r) for n in ("a.fastq", "b.fastq") for i, r in enumerate(plain_records((tmp_path / n).read_bytes())))
    want = sorted([*want, *((i, *r) for i, r in enumerate(plain_records(fastq_bytes(9, 9) + fastq_bytes(3, 3))))])
    assert sorted(map(tuple, rows.collect())) == want
    assert sorted(map(tuple, fastq.read_fastq(spark, f"file://{tmp_path}").collect())) == want


KIND = "name string, seq string, qual binary, mapq short, tid int, pos long, cigar string, cell_barcode string, umi string, gene_name string, gene_id string, is_mapped boolean, is_reverse boolean"


def alignment_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    text = lambda k: "".join(rng.choice(list("ACGTN"), size=k))
    out = []
    for i in range(n):
        size = int(rng.integers(0, 60))
        tags = [text(8) if rng.random() < 0.7 else None for _ in range(4)]
        out.append((f"read{i}" * int(rng.integers(1, 3)), text(size), bytearray(rng.integers(0, 42, size, dtype=np.uint8).tobytes()), int(rng.integers(0, 61)), int(rng.integers(-1, 3)), int(rng.integers(-1, 10**8)), f"{size}M2S" if size else "", *tags, bool(rng.random() < 0.8), bool(rng.random() < 0.5)))
    return out


def test_bam_is_the_same_for_every_cut(spark, tmp_path):
    rows = alignment_rows(400, 1)
    records = [bam_sink.bam_bytes(dict(zip([c.split()[0] for c in KIND.split(", ")], r, strict=True))) for r in rows]
    data = bam_sink.header_bytes([("chr1", 1000), ("chr2", 500), ("x", 9)]) + b"".join(records)
    packed = bgzf(data, np.random.default_rng(4))
    (tmp_path / "x.bam").write_bytes(packed)
    path = str(tmp_path / "x.bam")

    def read(size, least=0):
        return [tuple(r.values()) for part in splits.ranges_of([path], size, ("bgzf",)) for batch in bam.records(part, least) for r in batch.to_pylist()]

    want = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows]
    for size in (1 << 20, 5000, *range(60, len(packed) // 4, 613)):
        assert read(size) == want, size
    assert read(3000, 30) == [r for r in want if r[3] >= 30]
    assert bam.read_bam(spark, path, range_bytes=4000).rdd.getNumPartitions() > 5
    assert sorted(r["name"] for r in bam.read_bam(spark, path, range_bytes=4000).where("mapq > 40").collect()) == sorted(r[0] for r in rows if r[3] > 40)
    (tmp_path / "cut.bam").write_bytes(packed[: len(packed) // 2])
    with pytest.raises((ValueError, zlib.error, struct.error)):
        list(bam.records(splits.ranges_of([str(tmp_path / "cut.bam")], 1 << 20)[0]))


def test_bam_writer_commits_whole_parts(spark, tmp_path):
    rows, where = alignment_rows(900, 2), str(tmp_path / "out.bam")
    df = spark.createDataFrame(rows, KIND).repartition(5)
    bam_sink.write_bam(df, [("chr1", 1000), ("chr2", 500), ("x", 9)], where)
    assert len(list((tmp_path / "out.bam").iterdir())) == 5
    told = lambda rs: sorted(str([bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r]) for r in rs)
    assert told(bam.read_bam(spark, where, range_bytes=5000).collect()) == told(rows)
    assert bam.bam_references(spark, where).count() == 3 and files.looks_like_alignments(where)
    broken = spark.createDataFrame([*rows[:3], (*rows[3][:6], "1Z", *rows[3][7:])], KIND).repartition(2)
    with pytest.raises(Exception, match="substring not found"):
        bam_sink.write_bam(broken, [("chr1", 1000)], str(tmp_path / "failed.bam"))
    assert not (tmp_path / "failed.bam").exists() or not list((tmp_path / "failed.bam").iterdir())
