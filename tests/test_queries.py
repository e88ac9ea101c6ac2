"""Every registered query of the engine's own operators runs at the smallest scale and has its columns."""

import duckdb
import pytest

import __spark_entry__

HERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in __spark_entry__.cells.QUERIES if n in __spark_entry__.oracle_sql()]


def plain(rows):
    return sorted(tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", ["flagship_count_matrix", "barcode_correct_d2", "umi_components", "csr_indptr", "qc_summary", "hvg", "marker_ranksum", "extract_confusion", "nmi", "concordance", "pass_fail", "umi_hamming_edges", "stream_live_qc", "stream_live_cells", "stream_live_view"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{HERE}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, HERE)
    columns = sorted(df.columns)
    want = db.sql(__spark_entry__.oracle_sql()[name]).select(", ".join(columns)).fetchall()
    key = lambda rows: sorted(map(str, plain(rows)))
    assert key(df.select(columns).collect()) == key(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["gene", "cell", "n_umis"]


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
