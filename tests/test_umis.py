"""UMIs that are alike, against all pairs of each cell and gene."""

from itertools import product

import numpy as np
import pytest
from helixframe.functions.sequences import blanked
from helixframe.operators import matrix, umis


def far(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_edges_and_groups_against_all_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    rows = {(g, c, "".join(rng.choice(list("ACGTN*"), size=int(rng.integers(0, 7))))) for g in "gh" for c in "xyz" for _ in range(40)}
    rows = [(*r, int(rng.integers(1, 5))) for r in sorted(rows)] + [("g", "x", None, 3), (None, "x", "ACGT", 2), (None, "x", "ACGA", 1)]
    counted = spark.createDataFrame(rows, "gene string, cell string, umi string, n long")
    want = {(g, c, a, b, far(a, b)) for g, c, a, _ in rows for h, d, b, _ in rows if g and (g, c) == (h, d) and a is not None and b is not None and len(a) == len(b) and a < b and far(a, b) <= distance}
    got = [tuple(r) for r in umis.umi_edges(counted, distance).select("gene", "cell", "a", "b", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parent = {r[:3]: r[:3] for r in rows}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for g, c, a, b, _ in want:
        parent[top((g, c, a))] = top((g, c, b))
    groups = {}
    for g, c, u, n in rows:
        groups.setdefault(top((g, c, u)), []).append((u, n))
    expected = sorted(str((k[0], k[1], min(m, key=lambda r: (-r[1], r[0] or ""))[0], len(m), sum(n for _, n in m))) for k, m in groups.items())
    found = umis.umi_groups(counted, distance).select("gene", "cell", "representative", "n_members", "total").collect()
    assert sorted(str(tuple(r)) for r in found) == expected


def test_a_saturated_group(spark):
    """All 4,096 UMIs of 6 bases in one cell and gene: one component; a list holds four."""
    rows = [("g", "c", "".join(u), 1) for u in product("ACGT", repeat=6)]
    counted = spark.createDataFrame(rows, "gene string, cell string, umi string, n long")
    lists = umis.alike(counted, "umi", 1).selectExpr("max(size(near)) AS most", "count(*) AS n").first()
    assert tuple(lists) == (4, 6 * 4**5)
    assert umis.umi_edges(counted, 1).count() == 4096 * 18 // 2
    assert [(r["representative"], r["n_members"]) for r in umis.umi_groups(counted, 1).collect()] == [("AAAAAA", 4096)]
    assert umis.umi_groups(counted.limit(0), 1).count() == 0


def test_blanked(spark):
    df = spark.createDataFrame([("ABC",), ("A",), ("",), (None,)], "s string")
    got = [r[0] and [(list(m["at"]), m["text"]) for m in r[0]] for r in df.select(blanked("s", 2)).collect()]
    assert got == [[([1, 2], "**C"), ([1, 3], "*B*"), ([2, 3], "A**"), ([3], "AB*")], [([1], "*")], [([], "")], None]


def test_long_rows_in_pieces(spark):
    entries = [(0, c, c + 1) for c in range(10)] + [(2, 9, 5)]
    counts = spark.createDataFrame(entries, "gene_idx long, cell_idx long, n long")
    genes = spark.createDataFrame([(0,), (1,), (2,)], "gene_idx long")
    whole = sorted(map(tuple, matrix.csr(counts, genes).collect()))
    assert whole == [(0, 0, list(range(10)), list(range(1, 11))), (1, 10, [], []), (2, 10, [9], [5])]
    pieces = sorted(map(tuple, matrix.csr(counts, genes, 4).collect()))
    assert [p[:3] for p in pieces] == [(0, 0, [0, 1, 2, 3]), (0, 4, [4, 5, 6, 7]), (0, 8, [8, 9]), (1, 10, []), (2, 10, [9])]
