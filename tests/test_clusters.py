"""Labels in the order of nodes against one loop, and principal components without the dense matrix."""

import numpy as np
import pytest
from helixframe.operators import analysis, graph


def looped(n, edges, rounds=100):
    """Labels as one process finds them, node after node."""
    near = [[] for _ in range(n)]
    for a, b, dist in edges:
        near[a].append((b, 1.0 / (dist + 1e-10)))
    labels = list(range(n))
    for _ in range(rounds):
        changed = False
        for i in range(n):
            votes = {}
            for j, w in near[i]:
                votes[labels[j]] = votes.get(labels[j], 0.0) + w
            if votes:
                best = min(votes, key=lambda x: (-round(votes[x], 9), x))
                changed |= best != labels[i]
                labels[i] = best
        if not changed:
            break
    names = {}
    return [names.setdefault(x, len(names)) for x in labels]


def random_graph(n, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + 4 * rng.integers(0, 4, (n, 1))
    edges = []
    for i in range(n):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1)).round(9)
        d[i] = np.inf
        edges += [(i, int(j), float(d[j])) for j in np.argsort(d, kind="stable")[:k]]
    return edges


@pytest.mark.parametrize(("n", "k", "rounds"), [(2000, 6, 100), (300, 2, 100), (300, 5, 1)])
def test_labels_equal_one_loop(spark, n, k, rounds):
    edges = random_graph(n, k, n + k)
    df = spark.createDataFrame(edges, "src long, dst long, dist double")
    rows = graph.label_propagation(spark, spark.range(n).withColumnRenamed("id", "node"), df, most_rounds=rounds).collect()
    assert [r["label"] for r in sorted(rows)] == looped(n, edges, rounds)
    assert all(r["settled"] for r in rows) or rounds == 1


def test_unsettled_labels_are_told(spark):
    """Two nodes that see only each other never settle in parallel, but do one after the other; one round is not enough to know."""
    df = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, dist double")
    nodes = spark.range(3).withColumnRenamed("id", "node")
    assert sorted(map(tuple, graph.label_propagation(spark, nodes, df).collect())) == [(0, 0, True), (1, 0, True), (2, 1, True)]
    assert not all(r["settled"] for r in graph.label_propagation(spark, nodes, df, most_rounds=1).collect())


def sparse_values(spark, n_cells, n_genes, share, seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n_cells, n_genes)) < share, rng.exponential(size=(n_cells, n_genes)) * (1 + 3 * (rng.integers(0, 3, (n_cells, 1)) == np.arange(n_genes) % 3)), 0)
    x[:, 0] = 2.5  # a gene without variance
    x[3] = 0  # a cell without entries
    rows = [(f"g{g:05d}", f"c{c:04d}", float(x[c, g])) for c, g in zip(*map(np.ndarray.tolist, np.nonzero(x)), strict=True)]
    values = spark.createDataFrame(rows, "gene string, barcode string, x double")
    cells = spark.createDataFrame([(f"c{c:04d}",) for c in range(n_cells)], "barcode string")
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-12), -10, 10)
    return values, cells, z


def test_scaled_cells_equal_the_grid(spark):
    values, cells, z = sparse_values(spark, 40, 30, 0.2, 1)
    scaled = analysis.scaled_cells(values, cells)
    got = np.repeat(scaled.zeros[None, :], 40, axis=0)
    for r in scaled.rows.collect():
        assert r["barcode"] == f"c{r['node']:04d}"
        got[r["node"], r["genes"]] = r["z"]
    assert np.allclose(got, z, atol=1e-9)


@pytest.mark.parametrize("exact_genes", [2048, 10])
def test_pca_of_scaled_cells_against_numpy(spark, exact_genes):
    values, cells, z = sparse_values(spark, 120, 300, 0.1, 2)
    scores, variances = analysis.pca_scaled(analysis.scaled_cells(values, cells), 6, exact_genes)
    s = np.linalg.svd(z, compute_uv=False)
    assert np.allclose(variances, s[:6] ** 2 / 120, rtol=1e-6)
    got = np.array([r["scores"] for r in scores.orderBy("node").collect()])
    assert np.allclose((got**2).sum(axis=0) / 120, variances, rtol=1e-6)
    off = got.T @ got / 120
    assert np.abs(off - np.diag(np.diag(off))).max() < 1e-3 * variances[0]


def test_pca_of_many_genes(spark):
    """More genes than a Gram matrix is made for."""
    values, cells, z = sparse_values(spark, 60, 20_000, 0.02, 3)
    _, variances = analysis.pca_scaled(analysis.scaled_cells(values, cells), 5)
    want = np.sort(np.linalg.eigvalsh(z @ z.T))[::-1][:5] / 60
    assert np.allclose(variances, want, rtol=1e-6)


def test_poisson_numbers_have_their_mean_and_variance(spark):
    from helixframe.sources.synthetic import poisson, uniform
    from pyspark.sql import functions as F

    for mean in (0.1, 3.0, 60.0, 900.0):
        row = spark.range(20_000).select(poisson(F.lit(mean), uniform(1, "u", F.col("id")), uniform(1, "v", F.col("id"))).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
        assert row[0] == pytest.approx(mean, rel=0.03) and row[1] == pytest.approx(mean, rel=0.06)


def test_bundle_and_whole_numbers(spark, tmp_path):
    from helixframe.operators import matrix
    from helixframe.sinks.files import write_bundle
    from helixframe.sources.files import read_bundle

    values = spark.createDataFrame([("g", "c", 2.9), ("g", "d", -1.5), ("h", "c", 0.4), ("g", "c", 1.2)], "gene string, barcode string, x double")
    write_bundle({"values": values, "cells": values.select("barcode").distinct()}, str(tmp_path / "b"))
    back = read_bundle(spark, str(tmp_path / "b"))
    assert sorted(back) == ["cells", "values"]
    assert sorted(map(tuple, matrix.from_values(back["values"]).collect())) == [("g", "c", 3), ("h", "c", 0)]


def test_plain_cells_keep_values(spark):
    values, cells, _ = sparse_values(spark, 30, 20, 0.3, 5)
    rows = analysis.vectors_of(analysis.plain_cells(values, cells)).orderBy("node").collect()
    want = np.zeros((30, 20))
    for r in values.collect():
        want[int(r["barcode"][1:]), int(r["gene"][1:])] = r["x"]
    assert np.allclose(np.array([r["coords"] for r in rows]), want)
