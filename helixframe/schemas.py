"""Schemas and the protocol table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FASTQ = "rec_no long, id string, seq string, qual string"
BAM = (
    "name string, seq string, qual binary, mapq short, tid int, pos long, cigar string, cell_barcode string, "
    "umi string, gene_name string, gene_id string, is_mapped boolean, is_reverse boolean"
)
COUNTS = "gene string, barcode string, n long"
MTX = "line_no long, row long, col long, value double"
MANIFEST = "sample_name string, r1 string, r2 string, whitelist string, protocol string"


@dataclass(frozen=True)
class Protocol:
    """Where a read has its barcode and UMI; whole_read: no barcode, the sample is the cell."""

    name: str
    barcode_start: int
    barcode_len: int
    umi_start: int
    umi_len: int
    whole_read: bool = False

    @property
    def min_length(self) -> int:
        return self.barcode_start + self.barcode_len + self.umi_len


# Published library layouts.
PROTOCOLS = {
    p.name: p
    for p in (
        Protocol("10x-3prime-v3", 0, 16, 16, 12),
        Protocol("10x-3prime-v2", 0, 16, 16, 10),
        Protocol("10x-5prime-v2", 0, 16, 16, 10),
        Protocol("10x-5prime-v1.1", 0, 16, 16, 10),
        Protocol("drop-seq", 0, 12, 12, 8),
        Protocol("indrop", 0, 16, 16, 6),
        Protocol("sci-rna-seq", 0, 10, 10, 8),
        Protocol("smart-seq2", 0, 0, 0, 0, True),
    )
}


def protocol(name: str) -> Protocol:
    if name not in PROTOCOLS:
        raise ValueError(f"unknown protocol {name}; there are {', '.join(sorted(PROTOCOLS))}")
    return PROTOCOLS[name]


def protocol_table(spark: SparkSession) -> DataFrame:
    rows = [(p.name, p.barcode_start, p.barcode_len, p.umi_start, p.umi_len) for p in PROTOCOLS.values()]
    return spark.createDataFrame(rows, "protocol string, barcode_start int, barcode_len int, umi_start int, umi_len int")


def protocol_or_default(name: str | None, default: str = "10x-3prime-v3") -> Protocol:
    """The lenient lookup of the web jobs: unknown names, and layouts without a barcode, are taken as the default."""
    known = PROTOCOLS.get(name or "")
    return known if known and not known.whole_read else PROTOCOLS[default]


# Published whitelists.
WHITELISTS = (("10x 3M v3", "3M-february-2018.txt", 6_794_880), ("10x 737K v2", "737K-august-2016.txt", 737_280))


def whitelist_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WHITELISTS), "name string, file string, barcodes long")


# Least and most of the settings of a job.
RANGES = {"max_mismatch": (0, 3), "min_genes": (0, 100_000), "max_genes": (1, 1_000_000), "max_mito": (0.0, 100.0), "n_pcs": (2, 500), "resolution": (0.01, 50.0)}


def check_settings(**settings) -> dict:
    """The settings; fails on an unknown protocol or a value out of its range."""
    if settings.get("protocol") is not None:
        protocol(settings["protocol"])
    for name, (least, most) in RANGES.items():
        if settings.get(name) is not None and not least <= settings[name] <= most:
            raise ValueError(f"{name} must be within {least} and {most}")
    return settings
