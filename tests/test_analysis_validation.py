import numpy as np
import pytest

from helixframe.operators import analysis, graph, validation
from helixframe.plans import pipelines
from helixframe.sources.synthetic import SyntheticConfig, generate
from pyspark.sql import functions as F


def table(spark, x):
    return spark.createDataFrame([(f"g{j}", f"c{i}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "gene string, barcode string, x double")


def test_normalize(spark):
    rows = table(spark, [[10, 20, 30], [5, 5, 10]]).withColumnRenamed("x", "n")
    sums = analysis.normalize_total(rows, 100.0).groupBy("barcode").agg(F.sum("x")).collect()
    assert all(abs(r[1] - 100) < 1e-9 for r in sums)


def test_gene_stats_count_all_cells(spark):
    row = analysis.gene_stats(table(spark, [[4.0]]), 4).first()
    assert row["mean"] == 1 and row["variance"] == 3


def test_scale(spark):
    z = analysis.z_scores(table(spark, [[1, 2], [3, 4], [5, 6]]), None)
    assert all(abs(r[1]) < 1e-9 for r in z.groupBy("gene").agg(F.avg("z")).collect())


def test_pca_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(30, 6))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node long, coords array<double>")
    scores, variances = analysis.pca(vectors, 3)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(variances, s[:3] ** 2 / 30)
    got = np.array([r["scores"] for r in scores.orderBy("node").collect()])
    assert np.allclose((got**2).sum(axis=0) / 30, variances)


def test_knn_and_clusters(spark):
    points = [(0, 0), (1, 0), (0, 1), (50, 50), (51, 50), (50, 51)]
    vectors = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(points)], "node long, coords array<double>")
    for blocks in (1, 3):
        edges = analysis.knn(vectors, 2, blocks)
        assert edges.count() == 12
        labels = {r["node"]: r["label"] for r in graph.label_propagation(spark, vectors, edges.select("src", "dst", "dist")).collect()}
        assert labels == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert analysis.connectivity(analysis.knn(vectors, 1)).where("src = 0 and dst = 1").count() == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "src long, dst long")
    got = graph.connected_components(spark.range(42).withColumnRenamed("id", "node"), edges).collect()
    assert {r["component"] for r in got} == {0, 21} | ({41} if not edges.where("dst = 41").count() else set())


@pytest.mark.parametrize("t,p,ari,nmi", [("000111", "111000", 1.0, 1.0), ("0000", "0000", 1.0, 0.0), ("", "", 0.0, 0.0)])
def test_clustering_scores(spark, t, p, ari, nmi):
    rows = spark.createDataFrame(list(zip(t, p, strict=True)), "t string, p string")
    row = validation.clustering_scores(rows, "t", "p").first()
    assert (row["ari"], row["nmi"]) == (ari, nmi)


def test_correlations(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i, -1.0 * i, 1.0) for i in range(1, 6)], "a double, b double, c double, d double")
    assert validation.correlation(rows, "a", "b").first()[0] == 1
    assert validation.correlation(rows, "a", "c").first()[0] == -1
    assert validation.correlation(rows, "a", "d").first()[0] == 0
    tied = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4)], "a int, b int")
    assert validation.spearman(tied, "a", "b").first()[0] > 0.8
    near = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    assert tuple(validation.errors(near, "a", "b").first()) == (1, 1)


def test_confusion_and_sets(spark):
    row = validation.rated(spark.createDataFrame([(80, 10, 90, 20)], "tp long, fp long, tn long, fn long")).first()
    assert (row["sensitivity"], row["specificity"], round(row["precision"], 6)) == (0.8, 0.9, round(80 / 90, 6))
    assert validation.rated(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, tn long, fn long")).first()["f1"] == 0
    of = lambda s: spark.createDataFrame([(x,) for x in s], "barcode string")
    sets = validation.detection_sets(of("ABC"), of("ABD"), of("ABCDE")).first()
    assert (sets["tp"], sets["fp"], sets["fn"], sets["tn"]) == (2, 1, 1, 1)


def test_pass_fail(spark):
    kind = "stage string, score double, threshold double"
    passed = lambda rows: validation.pass_fail(spark.createDataFrame(rows, kind)).where("stage = 'overall'").first()["passed"]
    assert passed([("a", 0.9, 0.5), ("b", None, 0.5)]) is True
    assert passed([("a", 0.9, 0.5), ("b", 0.1, 0.5)]) is False
    assert passed([("a", None, 0.5)]) is False


def test_markers_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(1.0, size=(20, 4)).astype(float)
    cluster = np.arange(20) % 2
    values = table(spark, x).where("x > 0")
    clusters = spark.createDataFrame([(f"c{i}", int(k)) for i, k in enumerate(cluster)], "barcode string, cluster long")
    got = {(r["cluster"], r["gene"]): r["z"] for r in analysis.markers(values, clusters, 10).collect()}
    for j in range(4):
        order = np.sort(x[:, j])
        ranks = np.array([np.mean(np.flatnonzero(order == v) + 1) for v in x[:, j]])
        for k in (0, 1):
            z = (ranks[cluster == k].sum() - 10 * 21 / 2) / np.sqrt(10 * 10 * 21 / 12)
            assert abs(got[k, f"g{j}"] - z) < 1e-5


def test_synthetic_sample_validates(spark):
    config = SyntheticConfig(n_cells=40, n_genes=30, n_cell_types=3, markers_per_type=8, marker_fold=12.0)
    data = {k: graph.checkpointed(v) for k, v in generate(spark, config).items()}
    assert data["truth_cells"].select("barcode").distinct().count() == 40
    assert data["mutated"].count() == 4 and data["invalid"].count() == 2
    again = generate(spark, config)["truth_counts"]
    assert again.exceptAll(data["truth_counts"]).count() == 0
    report = {r["stage"]: r for r in pipelines.validate(data)["report"].collect()}
    assert report["extract"]["passed"] and report["count"]["passed"]


def test_reads_of_a_mutation_with_two_originals_count_once(spark):
    """AAAC comes from AAAA and from AACC; one read is corrected to one of them, another is not corrected."""
    matched = spark.createDataFrame([("AAAC", "corrected", "AAAA"), ("AAAC", "no_match", None), ("AAAC", "corrected", "AAAG"), ("AAAA", "exact", "AAAA")], "barcode string, status string, cell string")
    truth = spark.createDataFrame([("AAAA",), ("AACC",)], "barcode string")
    mutated = spark.createDataFrame([("AAAC", "AAAA"), ("AAAC", "AACC")], "mutated string, original string")
    row = validation.extraction_confusion(matched, truth, mutated, truth.limit(0)).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"], row["total_mutations"], row["correct_corrections"]) == (2, 1, 0, 1, 3, 1)


def test_extract_confusion_of_users_one_base_apart(spark, tmp_path):
    """Two users whose barcodes are two bases apart, and reads that make the same sequence of both: the query equals its SQL."""
    import hashlib

    import __spark_entry__
    import duckdb

    number = {}
    for user in range(200_000):
        code = hashlib.md5(str(user).encode()).hexdigest()[:16].translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT"))
        for place in range(0, 16, 2):  # event 10 i changes places 1, 3, ...
            changed = code[:place] + code[place].translate(str.maketrans("ACGT", "CGTA")) + code[place + 1 :]
            other = number.setdefault(changed, (user, place))
            if other[0] != user:
                break
        else:
            continue
        break
    event = lambda p: next(i for i in range(10, 10_000, 10) if i % 16 == p and i % 50 != 7)
    rows = [(event(place), user), (event(other[1]) + 80_000 * (event(other[1]) == event(place)), other[0]), (2, user), (3, other[0]), (21, user)]
    spark.createDataFrame(rows, "event_id long, user_id long").selectExpr("*", "'view' AS event_type", "'{\"k\": 1}' AS props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = __spark_entry__.queries()["extract_confusion"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()["extract_confusion"]).select(", ".join(got.columns)).fetchall()
    assert list(map(tuple, got.collect())) == want and want[0][got.columns.index("total_mutations")] == 2
