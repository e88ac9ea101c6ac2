import pytest

from helixframe.functions import sequences as seqs
from helixframe.operators import barcodes, reads, umis
from helixframe.schemas import protocol
from pyspark.sql import functions as F

CASES = [
    ("10x-3prime-v3", "AAACCCAAGAAACACTGGGGTTTTAAAA", "AAACCCAAGAAACACT", "GGGGTTTTAAAA"),
    ("10x-5prime-v2", "AAACCCAAGAAACACTGGGGTTTTAA", "AAACCCAAGAAACACT", "GGGGTTTTAA"),
    ("drop-seq", "AAAAGGGGCCCCTTTTAAAA", "AAAAGGGGCCCC", "TTTTAAAA"),
    ("indrop", "AAAAGGGGCCCCTTTTAAAAGG", "AAAAGGGGCCCCTTTT", "AAAAGG"),
    ("sci-rna-seq", "AAAAGGGGCCTTTTAAAA", "AAAAGGGGCC", "TTTTAAAA"),
]


@pytest.mark.parametrize("name,seq,barcode,umi", CASES)
def test_protocols(spark, name, seq, barcode, umi):
    rows = spark.createDataFrame([(seq, "I" * len(seq)), (seq[:9], "I" * 9)], "seq string, qual string")
    found = reads.extract(rows, name).select("barcode", "umi").collect()
    assert found[0] == (barcode, umi) and found[1] == (None, None)


def test_whole_read_protocol(spark):
    row = reads.extract(spark.createDataFrame([("ACGT" * 6, "I" * 24)], "seq string, qual string"), "smart-seq2", "WellA01").first()
    assert (row["barcode"], row["umi"], len(row["cdna"]), row["barcode_qual"]) == ("WellA01", "", 24, "IIIIIII")


def test_unknown_protocol():
    with pytest.raises(ValueError):
        protocol("none")


def test_quality(spark):
    rows = spark.createDataFrame([("",), ("I" * 4,), ("!I",)], "q string")
    got = rows.select(seqs.mean_quality("q"), seqs.mean_quality_region("q", 0, 2), seqs.quality_ok("q", 20)).collect()
    assert [tuple(r) for r in got] == [(0.0, None, False), (40.0, 40.0, True), (20.0, 20.0, True)]


def test_gene_of_read_id(spark):
    rows = spark.createDataFrame([("r:b:G1",), ("r:b",), ("r:b:NONE",), ("r:b:",)], "id string")
    assert [r[0] for r in rows.select(seqs.gene_of_read_id("id")).collect()] == ["G1", None, None, None]


def test_hamming(spark):
    rows = spark.createDataFrame([("AAAA", "AAAT"), ("AA", "AAA"), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(seqs.hamming("a", "b")).collect()] == [1, None, 0]


@pytest.mark.parametrize(
    "whitelist,seen,most,expected",
    [
        (["AAACCCAAGAAACACT"], "AAACCCAAGAAACACT", 1, ("exact", "AAACCCAAGAAACACT", 0)),
        (["AAACCCAAGAAACACT"], "TAACCCAAGAAACACT", 1, ("corrected", "AAACCCAAGAAACACT", 1)),
        (["AAACCCAAGAAACACT"], "TTACCCAAGAAACACT", 1, ("no_match", None, 0)),
        (["AAACCCAAGAAACACT"], "TTACCCAAGAAACACT", 2, ("corrected", "AAACCCAAGAAACACT", 2)),
        (["AAAA", "CCCC"], "AAAT", 1, ("corrected", "AAAA", 1)),
        (["AAAA", "CCCC"], "TTTT", 1, ("no_match", None, 0)),
        (["AAAA", "AACC"], "AAAC", 2, ("no_match", None, 0)),  # two candidates one base away end the search
        (["AAAA"], "aAAA", 1, ("no_match", None, 0)),  # not in the index
        (["AAAA"], "aAAA", 2, ("corrected", "AAAA", 1)),
        (["AAAA"], "AAA", 2, ("no_match", None, 0)),
        (["AAAA"], "AAAN", 1, ("corrected", "AAAA", 1)),
        (["AAAA"], "AAAN", 0, ("no_match", None, 0)),
    ],
)
def test_correction(spark, whitelist, seen, most, expected):
    wl = spark.createDataFrame([(b,) for b in whitelist], "barcode string")
    row = barcodes.correct(spark.createDataFrame([(seen,)], "barcode string"), wl, most).first()
    assert (row["status"], row["corrected"], row["distance"]) == expected


def test_umi_groups(spark):
    rows = [("g", "c", "A" * 12, 10), ("g", "c", "A" * 11 + "C", 2), ("g", "c", "C" * 12, 5)]
    got = umis.umi_groups(spark.createDataFrame(rows, "gene string, cell string, umi string, n long")).collect()
    assert sorted((r["representative"], r["n_members"], r["total"]) for r in got) == [("A" * 12, 2, 12), ("C" * 12, 1, 5)]


def test_pairs_of_unequal_files_fail(spark):
    one = spark.createDataFrame([(0, "a", "A", "I"), (1, "b", "C", "I")], "rec_no long, id string, seq string, qual string")
    assert reads.pair(one, one).count() == 2
    with pytest.raises(Exception, match="different numbers"):
        reads.pair(one, one.where("rec_no = 0")).collect()


def test_shards_are_the_input_once(spark):
    rows = spark.range(10).select(F.col("id").alias("rec_no"))
    assert sorted(r[0] for i in range(3) for r in reads.shard(rows, 3, i).collect()) == list(range(10))


@pytest.mark.parametrize("letters", ["ACGT", "ACGTN", "ab"])
def test_nearest_equals_all_pairs(spark, letters):
    """Barcodes at all distances, with N for sure off and N in the whitelist, letters of no index, ties, other lengths."""
    import random

    rng = random.Random(len(letters))
    word = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    wl = sorted({word(8, letters) for _ in range(40)} | {"ACGT", ""})
    seen = sorted({word(8, "ACGTN") for _ in range(60)} | {"NNNN" + w[4:] for w in wl[:20]} | {"N" + w[1:7] + "x" for w in wl[:20]} | set(wl[:5]) | {"ACGG", "A", "", "xCGT"})
    want = []
    for b in seen:
        dist = sorted((sum(x != y for x, y in zip(b, w, strict=True)), w) for w in wl if len(w) == len(b))
        if dist and dist[0][0] <= 6:
            want.append((b, dist[0][0], sum(x == dist[0][0] for x, _ in dist), dist[0][1]))
    df = lambda rows: spark.createDataFrame([(r,) for r in rows], "barcode string")
    got = barcodes.nearest(df(seen), df(wl), 6).select("barcode", "distance", "n", "original").collect()
    assert sorted(map(tuple, got)) == want


def test_barcodes_that_are_near_meet_few_entries(spark, monkeypatch):
    """Barcodes with five N do not meet all the entries that share two bases with them."""
    wl = spark.range(3000).select(F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 16), "0123456789abcdef", "ACGTACGTACGTACGT").alias("barcode"))
    some = wl.limit(300)
    off = some.select(F.concat(F.lit("NNNNN"), F.substring("barcode", 6, 11)).alias("barcode"), F.lit(5).alias("off"))
    monkeypatch.setattr(barcodes, "hamming", lambda a, b: F.lit(5))  # all that meet
    assert barcodes.at_distance(off, wl.withColumnRenamed("barcode", "original"), 5, ()).count() < 330
