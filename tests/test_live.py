"""Live quality by cell: batches, restarts, forgetting, progress."""

import pytest
from helixframe.operators import qc
from helixframe.streaming import jobs

SCHEMA = "cell string, gene string, umi string, ts timestamp"


def write(spark, folder, name, rows):
    spark.createDataFrame([(c, g, u, t) for c, g, u, t in rows], "cell string, gene string, umi string, t long").selectExpr("cell", "gene", "umi", "timestamp_seconds(t) AS ts").coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, source, folder, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    for running in jobs.start_live_cells(stream, str(folder), **more):
        running.awaitTermination()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_final_state_equals_the_batch(spark, tmp_path):
    reads = [(None if i % 11 == 0 else f"c{i % 3}", None if i % 13 == 0 else ("MT-1" if i % 5 == 0 else f"g{i % 4}"), None if i % 17 == 0 else f"u{i % 7}", i) for i in range(400)]
    heard = []
    with jobs.progress_of(spark, heard.append):
        for part in range(4):  # the same cells come in every batch
            write(spark, tmp_path / "in", f"p{part}", reads[part * 100 : part * 100 + 100])
            if part != 1:  # two files in one run, one in each other, all from one folder
                run(spark, tmp_path / "in", tmp_path / "out")
            seen = reads[: part * 100 + 100] if part != 1 else reads[:100]
            distinct = spark.createDataFrame(list({r[:3] for r in seen if None not in r[:3]}), "barcode string, gene string, umi string")
            counts = distinct.groupBy("gene", "barcode").count().withColumnRenamed("count", "n")
            assert rows_of(jobs.live_cells(spark, str(tmp_path / "out"))) == rows_of(qc.cell_metrics(counts))
    view = jobs.live_view(spark, str(tmp_path / "out")).first()
    assert (view["valid_percent"], view["n_cells"], view["warnings"]) == (round(100 * sum(r[0] is not None for r in reads) / 400, 6), 3, ["median genes under 500", "fewer than 100 cells"])
    batches = [h for h in heard if h.get("query") == "live umis" and h.get("rows")]
    assert sum(h["rows"] for h in batches) == 400 and batches[-1]["state_rows"] == len({r[:3] for r in reads if None not in r[:3]})
    assert sum(h.get("ended", False) and h["error"] is None for h in heard) == 6


def test_batch_that_fails_counts_once(spark, tmp_path, monkeypatch):
    write(spark, tmp_path / "in", "a", [("c", "g", "u", 0), ("c", "g", "v", 1)])
    run(spark, tmp_path / "in", tmp_path / "out")
    write(spark, tmp_path / "in", "b", [("c", "g", "u", 2), ("c", "h", "w", 3)])
    from pyspark.sql import DataFrameWriter

    put = DataFrameWriter.parquet

    def late(self, path, *rest, **more):  # the table is there, the batch is not committed
        put(self, path, *rest, **more)
        if "/umis/batch=1" in path:
            raise RuntimeError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", late)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path / "in", tmp_path / "out")
    monkeypatch.undo()
    run(spark, tmp_path / "in", tmp_path / "out")
    assert rows_of(jobs.live_counts(spark, str(tmp_path / "out"))) == [("g", "c", 2), ("h", "c", 1)]


def test_forgotten_umis_count_again(spark, tmp_path):
    for name, rows in {"a": [("c", "g", "u", 0)], "b": [("c", "g", "u", 30)], "c": [("c", "g", "x", 10_000)], "d": [("c", "g", "y", 20_000)], "e": [("c", "g", "u", 20_000)]}.items():
        write(spark, tmp_path / "in", name, rows)
        run(spark, tmp_path / "in", tmp_path / "out", expire="1 minute")
    assert rows_of(jobs.live_counts(spark, str(tmp_path / "out"))) == [("g", "c", 4)]


def test_empty_stream(spark, tmp_path):
    write(spark, tmp_path / "in", "a", [])
    run(spark, tmp_path / "in", tmp_path / "out")
    write(spark, tmp_path / "in", "b", [(None, None, None, 0)])
    run(spark, tmp_path / "in", tmp_path / "out")
    assert jobs.live_cells(spark, str(tmp_path / "out")).count() == 0
    assert tuple(jobs.live_view(spark, str(tmp_path / "out")).first())[:3] == (0.0, 0, 0)
