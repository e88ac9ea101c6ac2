"""Runs from files, batches, chunks of records, settings; single-task-free numbering; sparse against dense."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import schemas
from helixframe.functions.register import register
from helixframe.operators import analysis, barcodes, graph, matrix, reads, validation
from helixframe.plans import pipelines
from helixframe.streaming import jobs


def fastq(path, records):
    path.write_text("".join(f"@{name}\n{seq}\n+\n{'I' * len(seq)}\n" for name, seq in records))
    return str(path)


@pytest.fixture
def sample(tmp_path):
    cells, umis = ["AAACCCAAGAAACACT", "TTTGGGTTCTTTGTGA"], ["GGGGTTTTAAAA", "CCCCAAAATTTT", "ACACACACACAC"]
    r1 = [(f"r{i}", cells[i % 2] + umis[i % 3]) for i in range(12)] + [("bad", "N" * 28), ("off", "C" + cells[0][1:] + umis[0])]
    r2 = [(f"r{i}:x:G{i % 2}", "ACGT" * 5) for i in range(12)] + [("bad:x:G0", "ACGT"), ("off:x:G0", "ACGT")]
    whitelist = tmp_path / "whitelist.txt"
    whitelist.write_text("# cells\n" + "\n".join(cells) + "\n")
    return {"r1": fastq(tmp_path / "r1.fastq", r1), "r2": fastq(tmp_path / "r2.fastq", r2), "whitelist": str(whitelist)}


def test_run_from_files(spark, sample, tmp_path):
    report = pipelines.run_sample(spark, output=str(tmp_path / "out"), **sample).first()
    assert report["n_cells"] == 2 and report["total"] if "total" in report else report["n_cells"] == 2
    lines = (tmp_path / "out" / "matrix" / "matrix.mtx").read_text().splitlines()
    assert lines[2] == "2 2 2" and lines[3:] == ["1 1 3", "2 2 3"]
    assert (tmp_path / "out" / "matrix" / "barcodes.tsv").read_text().splitlines() == ["AAACCCAAGAAACACT", "TTTGGGTTCTTTGTGA"]
    assert json.loads((tmp_path / "out" / "qc_report.json").read_text())["n_cells"] == 2
    pipelines.run_sample(spark, output=str(tmp_path / "one"), force_cells=1, **sample)
    assert (tmp_path / "one" / "matrix" / "matrix.mtx").read_text().splitlines()[2] == "1 1 1"
    with pytest.raises(ValueError):
        pipelines.run_sample(spark, output=str(tmp_path / "no"), protocol="none", **sample)


def test_manifest_goes_on_after_a_failure(spark, sample, tmp_path):
    manifest = tmp_path / "manifest.csv"
    manifest.write_text(f"sample_name,r1,r2,whitelist,protocol\nsample1,{sample['r1']},{sample['r2']},{sample['whitelist']},10x-3prime-v3\nsample2,{tmp_path}/none.fastq,{sample['r2']},{sample['whitelist']},\n")
    rows = {r["sample"]: r for r in pipelines.run_manifest(spark, str(manifest), str(tmp_path / "out")).collect()}
    assert rows["sample1"]["status"] == "ok" and rows["sample2"]["status"] == "failed" and rows["sample2"]["error"]
    summary = pipelines.batch_summary(spark.createDataFrame(list(rows.values()), "sample string, status string, error string")).first()
    assert (summary["succeeded"], summary["failed"]) == (1, 1)


def test_record_chunks(spark, sample):
    seen = []
    stats = jobs.process_fastq(spark, sample["r1"], lambda chunk, number: seen.append((number, sorted(r["rec_no"] for r in chunk.collect()))), records=5)
    assert seen == [(0, list(range(5))), (1, list(range(5, 10))), (2, list(range(10, 14)))] and stats == {"chunks_processed": 3, "processed_records": 14}

    def fail(chunk, number):
        seen.append(number)
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        jobs.process_fastq(spark, sample["r1"], fail, records=5)
    assert seen[3:] == [0]


def test_settings_and_layouts(spark):
    assert schemas.check_settings(protocol="drop-seq", max_mismatch=3, resolution=0.01)
    for bad in ({"max_mismatch": 4}, {"n_pcs": 1}, {"max_mito": 100.5}, {"protocol": "x"}):
        with pytest.raises(ValueError):
            schemas.check_settings(**bad)
    assert schemas.protocol_or_default("smart-seq2").name == schemas.protocol_or_default("?").name == "10x-3prime-v3"
    assert schemas.whitelist_table(spark).agg(F.sum("barcodes")).first()[0] == 7_532_160
    rows = spark.createDataFrame([("AAAACCGGTT", "IIIIIIIIII")], "seq string, qual string")
    assert reads.extract(rows, schemas.Protocol("own", 1, 3, 6, 2)).select("barcode", "umi", "cdna").first() == ("AAA", "GG", "TT")
    assert "byte_sum" in register(spark) and spark.sql("select hamming('AC', 'AG'), ratio(1, 0), subsequence('ACG', 2, 2)").first() == (1, 0.0, None)


def test_quality_sums_skip_nulls(spark):
    rows = spark.createDataFrame([("I" * 5,), ("",), (None,), ("!~",)], "qual string").repartition(1)
    assert sorted(rows.select(reads.mean_quality("qual")).collect(), key=str) == [(0.0,), (40.0,), (46.5,), (None,)]


def test_numbers_and_totals(spark):
    names = spark.range(500).select(F.format_string("n%03d", (F.col("id") * 7) % 500).alias("name"), (F.col("id") % 5).alias("n"))
    got = {r["name"]: (r["i"], r["t"]) for r in graph.running_total(graph.numbered(names, ["name"], "i"), ["name"], F.col("n"), "t").collect()}
    before = 0
    for i, r in enumerate(sorted(names.collect())):
        assert got[r["name"]] == (i, before)
        before += r["n"]


def test_components_of_chains(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    edges = spark.range(40).where("id % 10 <> 9").select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    got = {r["node"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert got == {i: i // 10 * 10 if i < 40 else i for i in range(60)}


def test_sparse_correlation_equals_dense(spark):
    rng = np.random.default_rng(1)
    schema = "gene string, barcode string, n long"
    truth = spark.createDataFrame([(f"g{a}", f"c{b}", int(rng.integers(1, 9))) for a in range(8) for b in range(9) if rng.random() < 0.4], schema)
    seen = spark.createDataFrame([(f"g{a}", f"c{b}", int(rng.integers(1, 9))) for a in range(9) for b in range(10) if rng.random() < 0.4], schema)
    dense = validation.correlation(validation.aligned(truth, seen), "truth", "observed").first()[0]
    assert validation.sparse_correlation(truth, seen).first()[0] == pytest.approx(dense, abs=2e-6)
    assert matrix.merge([None, truth]).count() == truth.count()
    constant = spark.createDataFrame([(1, 1)] * 3, "t int, p int")
    assert validation.clustering_scores(constant, "t", "p", constant_nmi=1.0).first()["nmi"] == 1.0


def test_filtered_analysis_normalises_once(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{g:02d}", f"c{c:02d}", int(1 + rng.poisson(20 if g // 10 == c // 12 else 1))) for g in range(30) for c in range(36)]
    out = pipelines.filtered_analysis(spark.createDataFrame(rows, "gene string, barcode string, n long"), min_genes=1, n_top_genes=12, n_pcs=5, n_neighbors=6)
    counts = np.array([n for _, _, n in rows], dtype=float).reshape(30, 36)
    x = np.log1p(counts / counts.sum(axis=0) * 10000)
    dispersion = x.var(axis=1) / x.mean(axis=1)
    assert {r["gene"] for r in out["hvg"].collect()} == {f"g{g:02d}" for g in np.argsort(-dispersion)[:12]}
    labels = {r["barcode"]: r["label"] for r in out["clusters"].join(out["cells"], "node").collect()}
    groups = [{labels[f"c{c:02d}"] for c in range(k, k + 12)} for k in (0, 12, 24)]
    assert not groups[0] & groups[1] and not groups[1] & groups[2] and not groups[0] & groups[2]
    first = x[[int(g[1:]) for g in sorted(r["gene"] for r in out["hvg"].collect())]]
    z = np.clip((first - first.mean(axis=1, keepdims=True)) / first.std(axis=1, keepdims=True), -10, 10).T
    want = np.sort(np.linalg.eigvalsh(z.T @ z))[::-1][:5] / 36
    assert [r["variance"] for r in out["variances"].orderBy("component").collect()] == pytest.approx(want.tolist(), rel=1e-6)


def test_label_propagation_ends_where_no_node_would_change(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(20, 2)) + c for c in ((0, 0), (30, 0), (0, 30))])
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "node long, coords array<double>")
    edges = analysis.knn(vectors, 6)
    labels = {r["node"]: r["label"] for r in graph.label_propagation(spark, vectors.select("node"), edges.select("src", "dst", "dist")).collect()}
    votes = {}
    for r in edges.collect():
        own = votes.setdefault(r["src"], {})
        own[labels[r["dst"]]] = own.get(labels[r["dst"]], 0) + 1 / (r["dist"] + 1e-10)
    assert all(own[labels[node]] >= max(own.values()) - 1e-6 for node, own in votes.items())
    assert all(not {labels[i] for i in range(20)} & {labels[i] for i in range(k, k + 20)} for k in (20, 40))


def test_lookup_by_sample(spark):
    wl = spark.createDataFrame([("s", "AAAA"), ("t", "CCCC"), ("t", "CCCG")], "sample string, barcode string")
    rows = spark.createDataFrame([("s", "AAAT"), ("t", "AAAT"), ("t", "CCCA"), ("t", "CCCC"), ("s", None)], "sample string, barcode string")
    got = {(r["sample"], r["barcode"]): (r["status"], r["corrected"]) for r in barcodes.judged(rows, barcodes.lookup(wl, ("sample",)), 1, ("sample",)).collect()}
    assert got == {("s", "AAAT"): ("corrected", "AAAA"), ("t", "AAAT"): ("no_match", None), ("t", "CCCA"): ("no_match", None), ("t", "CCCC"): ("exact", "CCCC"), ("s", None): (None, None)}
