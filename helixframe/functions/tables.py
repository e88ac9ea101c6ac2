"""Table functions for SQL: protocol extraction, and reads and UMIs of each cell and gene.

SELECT * FROM extract_protocol(TABLE(reads), protocol => 'drop-seq')
SELECT * FROM umi_counts(TABLE(SELECT cell, gene, umi FROM found) PARTITION BY (cell, gene) ORDER BY umi)
"""

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from helixframe import schemas


@udtf
class ExtractProtocol:
    """The columns of the table with barcode, umi and cdna by a protocol's layout; rows too short for it have nulls there."""

    def __init__(self):
        self.layout = None

    @staticmethod
    def analyze(reads: AnalyzeArgument, protocol: AnalyzeArgument) -> AnalyzeResult:
        if not reads.isTable or "seq" not in reads.dataType.fieldNames():
            raise ValueError("the first argument must be a table with a column seq")
        schemas.protocol(protocol.value)  # fails early for unknown names
        added = [T.StructField(c, T.StringType()) for c in ("barcode", "umi", "cdna")]
        return AnalyzeResult(T.StructType([*reads.dataType.fields, *added]))

    def eval(self, reads, protocol):
        layout = self.layout = self.layout or schemas.protocol(protocol)
        seq = reads["seq"]
        if layout.whole_read:
            yield *reads, "sample", "", seq
            return
        after = max(layout.barcode_start + layout.barcode_len, layout.umi_start + layout.umi_len)
        if seq is None or len(seq) < max(layout.min_length, after):
            yield *reads, None, None, None
        else:
            cut = lambda start, size: seq[start : start + size]
            yield *reads, cut(layout.barcode_start, layout.barcode_len), cut(layout.umi_start, layout.umi_len), seq[after:]


@udtf(returnType="cell string, gene string, n_reads long, n_umis long")
class UmiCounts:
    """Reads and distinct UMIs of each partition (cell, gene), whose rows come in the order of umi: a group of any size is streamed."""

    def __init__(self):
        self.key, self.last, self.reads, self.umis = None, None, 0, 0

    def eval(self, row):
        if not self.reads or row["umi"] != self.last:
            self.umis += 1
        self.key, self.last, self.reads = (row["cell"], row["gene"]), row["umi"], self.reads + 1

    def terminate(self):
        if self.reads:
            yield *self.key, self.reads, self.umis


def register_tables(spark: SparkSession) -> list[str]:
    spark.udtf.register("extract_protocol", ExtractProtocol)
    spark.udtf.register("umi_counts", UmiCounts)
    return ["extract_protocol", "umi_counts"]
