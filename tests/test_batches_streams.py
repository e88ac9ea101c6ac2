"""Batches of any distance, samples side by side, FASTQ as a stream, table functions on odd rows."""

import numpy as np
import pytest
from helixframe import schemas
from helixframe.functions.tables import register_tables
from helixframe.operators import reads
from helixframe.plans import pipelines
from helixframe.streaming import jobs


def sample_rows(seed=0):
    rng = np.random.default_rng(seed)
    text = lambda n: "".join(rng.choice(list("ACGT"), size=n))
    lists = {"a": [text(16) for _ in range(6)], "b": [text(12) for _ in range(6)], "c": [text(10) for _ in range(6)]}
    protocols = {"a": "10x-3prime-v3", "b": "drop-seq", "c": "sci-rna-seq", "d": "none"}
    rows = []
    for sample, protocol in protocols.items():
        for _ in range(60):
            barcode = list(rng.choice(lists.get(sample, lists["a"])))
            for at in rng.choice(len(barcode), int(rng.integers(0, 4)), replace=False):
                barcode[at] = str(rng.choice(list("ACGTN")))
            rows.append((sample, protocol, "".join(barcode) + text(14), "I" * (len(barcode) + 14)))
    return rows, [(s, b) for s, bs in lists.items() for b in bs]


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_batch_each_equals_each_sample_alone(spark, distance):
    rows, lists = sample_rows()
    samples = spark.createDataFrame(rows, "sample string, protocol string, seq string, qual string")
    whitelists = spark.createDataFrame(lists, "sample string, barcode string")
    got = {r["sample"]: tuple(r)[1:] for r in pipelines.batch_each(samples, whitelists, distance).collect()}
    for sample in "abc":
        own = samples.where(samples["sample"] == sample)
        protocol = schemas.protocol_or_default(own.first()["protocol"])
        found = pipelines.extract(own, whitelists.where(whitelists["sample"] == sample).select("barcode"), protocol, distance, None)
        cells = [r["cell"] for r in found.select("cell").collect()]
        assert got[sample] == (60, sum(c is not None for c in cells), len({*cells} - {None}))
    assert got["d"] == (60, 0, 0)


def fastq(path, records):
    path.write_text("".join(f"@{name}\n{seq}\n+\n{'I' * len(seq)}\n" for name, seq in records))
    return str(path)


def test_samples_side_by_side(spark, tmp_path):
    cells = ["AAACCCAAGAAACACT", "TTTGGGTTCTTTGTGA"]
    (tmp_path / "wl.txt").write_text("\n".join(cells) + "\n")
    lines = ["sample_name,r1,r2,whitelist,protocol"]
    for i in range(3):
        r1 = fastq(tmp_path / f"a{i}.fastq", [(f"r{k}", cells[k % 2] + "ACGTACGTACGT") for k in range(4 + i)])
        r2 = fastq(tmp_path / f"b{i}.fastq", [(f"r{k}:x:G{k % 2}", "ACGT") for k in range(4 + i)])
        lines.append(f"s{i},{r1},{r2},{tmp_path}/wl.txt,")
    lines.insert(2, f"broken,{tmp_path}/none.fastq,{tmp_path}/none.fastq,{tmp_path}/wl.txt,")
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    results = {}
    for n in (1, 3):
        rows = pipelines.run_manifest(spark, str(tmp_path / "m.csv"), str(tmp_path / f"out{n}"), parallel_samples=n).collect()
        assert [r["sample"] for r in rows] == ["s0", "broken", "s1", "s2"] and [r["status"] for r in rows] == ["ok", "failed", "ok", "ok"]
        results[n] = [(tmp_path / f"out{n}" / f"s{i}" / "matrix" / "matrix.mtx").read_text() for i in range(3)]
    assert results[1] == results[3]


def test_fastq_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, checkpoint, out = tmp_path / "in", str(tmp_path / "checkpoint"), tmp_path / "out"
    folder.mkdir()
    seen = lambda: sorted(r["id"] for r in spark.read.schema("id string").parquet(f"{out}/*").collect())

    def keep(chunk, batch, number):
        chunk.select("id").write.mode("overwrite").parquet(f"{out}/{batch}-{number}")

    fastq(folder / "b.fastq", [(f"b{i}", "ACGT") for i in range(25)])
    assert jobs.process_fastq_stream(spark, str(folder), keep, checkpoint, records=10) == 25
    assert sorted(p.name for p in out.iterdir()) == ["0-0", "0-1", "0-2"]
    fastq(folder / "a.fastq", [(f"a{i}", "ACGT") for i in range(5)])  # sorts before the one that has been read

    def fail(chunk, batch, number):
        keep(chunk, batch, number)
        raise RuntimeError("stop")

    with pytest.raises(Exception, match="stop"):
        jobs.process_fastq_stream(spark, str(folder), fail, checkpoint, records=2)
    assert jobs.process_fastq_stream(spark, str(folder), keep, checkpoint, records=2) == 5
    assert jobs.process_fastq_stream(spark, str(folder), keep, checkpoint) == 0
    assert seen() == sorted([f"b{i}" for i in range(25)] + [f"a{i}" for i in range(5)])


def test_table_functions(spark):
    register_tables(spark)
    rows = [(1, "A" * 12 + "C" * 8 + "GG"), (2, "ACGT"), (3, None), (4, "T" * 20)]
    df = spark.createDataFrame([(*r, r[1]) for r in rows], "rec_no long, seq string, qual string")
    df.createOrReplaceTempView("odd_reads")
    got = spark.sql("SELECT rec_no, barcode, umi, cdna FROM extract_protocol(TABLE(odd_reads), protocol => 'drop-seq')").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in reads.extract(df, "drop-seq").select("rec_no", "barcode", "umi", "cdna").collect())
    with pytest.raises(Exception, match="unknown protocol"):
        spark.sql("SELECT * FROM extract_protocol(TABLE(odd_reads), protocol => 'no such')").collect()
    spark.createDataFrame([("c", "g", "u1"), ("c", "g", "u1"), ("c", "g", "u2"), (None, "g", None)], "cell string, gene string, umi string").createOrReplaceTempView("odd_found")
    got = spark.sql("SELECT * FROM umi_counts(TABLE(odd_found) PARTITION BY (cell, gene) ORDER BY umi)").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(["('c', 'g', 3, 2)", "(None, 'g', 1, 1)"])


def test_chunks_run_in_tasks(spark):
    """300 chunks are one job over tasks, not a job each; each has its records in order, the last one what is left."""
    import pyarrow as pa
    from helixframe.streaming import jobs
    from pyspark.sql import functions as F

    reads = spark.range(2995).select((2994 - F.col("id")).alias("rec_no"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("A"), (F.col("id") % 5).cast("int"))).alias("seq"))
    first = lambda number, t: pa.table({"chunk": [number], "first": [t["rec_no"][0].as_py()], "last": [t["rec_no"][-1].as_py()]})
    got = sorted(map(tuple, jobs.map_chunks(reads, first, "chunk long, first long, last long", 10).collect()))
    assert got == [(i, 10 * i, min(10 * i + 9, 2994)) for i in range(300)]
    spark.sparkContext.setJobGroup("chunks", "chunks")
    sums = sorted(map(tuple, jobs.record_chunks(reads, 10).collect()))
    ran = spark.sparkContext.statusTracker().getJobIdsForGroup("chunks")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = reads.groupBy(F.floor(F.col("rec_no") / 10).alias("chunk")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("b"))
    assert sums == sorted(map(tuple, want.collect())) and len(sums) == 300 and 0 < len(ran) < 10
