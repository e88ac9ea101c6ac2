"""FASTQ and FASTA as a Python data source: byte ranges, records as Arrow batches.

A range owns the records that begin after one of its own line ends, and the file's first. Where it
begins inside a record, the next begins at the first line with @ two lines before one with + (no
sequence begins with +, so a quality that begins with @ is no such line); in FASTA, with >.
"""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader

from helixframe.sources.splits import RANGE_BYTES, ByteRange, chunks, located, paths_of, ranges_of

SCHEMA = "range long, at long, id string, seq string, qual string"
ARROW = pa.schema([("range", pa.int64()), ("at", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
BATCH = 20_000


class Irregular(Exception):
    """The lines are not all of records of four lines in ASCII."""


def line_bounds(data: bytes, start: int, ended: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without line ends) of the whole lines from start on, and where the next line begins. ended: the last line may lack its line end."""
    at = np.flatnonzero(np.frombuffer(data, dtype=np.uint8)[start:] == 10) + start
    after = at + 1
    if ended and (after[-1] if len(after) else start) < len(data):
        at, after = np.append(at, len(data)), np.append(after, len(data))
    starts = np.concatenate([[start], after[:-1]]) if len(after) else after
    raw = np.frombuffer(data, dtype=np.uint8)
    returns = (at > starts) & (raw[np.maximum(at - 1, 0)] == 13) if len(at) else at.astype(bool)
    return starts, at - returns, after


def four_line_records(data: bytes, start: int, limit: int, ended: bool) -> tuple[list[pa.Array], int]:
    """Ids, sequences and qualities of the whole records that begin at start and up to limit, and where the next begins."""
    starts, ends, after = line_bounds(data, start, ended)
    n = len(starts) // 4
    if ended and len(starts) != 4 * n:
        raise Irregular
    n = int(np.searchsorted(starts[: 4 * n : 4], limit, side="right"))
    if not n:
        return [], start
    starts, ends, raw = starts[: 4 * n], ends[: 4 * n], np.frombuffer(data, dtype=np.uint8)
    stop = int(after[4 * n - 1])
    heads, plus = starts[::4], starts[2::4]
    if (raw[heads] != 64).any() or (raw[plus] != 43).any() or (ends[::4] == heads).any() or (ends[1::4] - starts[1::4] != ends[3::4] - starts[3::4]).any() or (raw[start:stop] > 127).any():
        raise Irregular
    # values of one string array over the bytes as they are: what is wanted and what lies between, in turn
    bounds = np.empty((n, 3, 2), dtype=np.int32)
    for i, line in enumerate((0, 1, 3)):
        bounds[:, i, 0], bounds[:, i, 1] = starts[line::4] + (line == 0), ends[line::4]
    spread = pa.StringArray.from_buffers(6 * n - 1, pa.py_buffer(bounds.ravel()), pa.py_buffer(data))
    return [spread.take(pa.array(np.arange(2 * i, 6 * n - 1, 6))) for i in range(3)], stop


def any_records(data: bytes, start: int, limit: int, ended: bool, path: str, number: int) -> tuple[list[pa.Array], int]:
    """As four_line_records(), line by line: blank lines between records, FASTA records, and bytes that are no UTF-8, replaced."""
    starts, ends, after = (x.tolist() for x in line_bounds(data, start, ended))
    rows, i, stop = [], 0, start
    line = lambda k: data[starts[k] : ends[k]]
    while i < len(starts) and starts[i] <= limit:
        if starts[i] == ends[i]:
            i, stop = i + 1, after[i]
            continue
        head, size = line(i), 4 if data[starts[i] : starts[i] + 1] == b"@" else 2
        if i + size > len(starts) and not ended:
            break
        where = f"{path}: record {number + len(rows)}"
        if head[:1] not in (b"@", b">"):
            raise ValueError(f"{where} begins with neither @ nor >")
        seq = line(i + 1) if i + 1 < len(starts) else b""
        qual = (line(i + 3) if i + 3 < len(starts) else b"") if size == 4 else b""
        if size == 4 and len(seq) != len(qual):
            raise ValueError(f"{where} has {len(seq)} bases and {len(qual)} qualities")
        rows.append(tuple(x.decode("utf-8", "replace") for x in (head[1:], seq, qual)))
        i = min(i + size, len(starts))
        stop = after[i - 1]
    return [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [], stop


def first_record(data: bytes, start: int, fasta: bool, ended: bool) -> int | None:
    """Where the first record at or after the line start begins; None if more bytes are needed, the end if there is none."""
    starts, _, _ = line_bounds(data, start, ended)
    raw = np.frombuffer(data, dtype=np.uint8)
    if fasta:
        found = np.flatnonzero(raw[starts] == 62)
    else:
        found = np.flatnonzero((raw[starts[:-2]] == 64) & (raw[starts[2:]] == 43)) if len(starts) > 2 else starts[:0]
    return int(starts[found[0]]) if len(found) else len(data) if ended else None


def is_fasta(path: str) -> bool:
    """Whether the file's first byte that is no line end is >."""
    for data, _ in chunks(ByteRange(path, 0, 0, 1 << 16)):
        if text := data.lstrip(b"\r\n"):
            return text[:1] == b">"
    return False


def records(part: ByteRange):
    """Batches (id, seq, qual) of the records that the range owns."""
    data, own, at, number, found = b"", 0, 0, 0, part.start == 0
    fasta = is_fasta(part.path) if part.start else False
    source = chunks(part)
    more = True
    while more:
        piece, mine = next(source, (None, False))
        more = piece is not None
        if more:
            data = data[at:] + piece
            own, at = own - at + (len(piece) if mine else 0), 0
            if mine and len(data) < 1 << 16:
                continue
        if not found:
            line = data.find(b"\n", at) + 1
            if not line and mine:
                continue
            if not line or line > own:  # it has no line end of its own
                return
            place = first_record(data, line, fasta, not more)
            if place is None:
                continue
            at, found = place, True
        while True:
            if at > own or at >= len(data):
                break
            try:
                columns, stop = four_line_records(data, at, own, not more)
            except Irregular:
                columns, stop = any_records(data, at, own, not more, part.path, number)
            if stop == at:
                break
            at = stop
            if columns:
                yield number, columns
                number += len(columns[0])
        if found and not mine and at > own:
            return


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = paths_of(options, (".fastq", ".fq"))
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        self.counts = options.get("counts", "false").lower() == "true"
        self.firsts = options.get("firsts")

    def partitions(self):
        parts = ranges_of(self.paths, self.size)
        if not self.firsts:
            return parts
        system, where = located(self.firsts)
        table = pq.read_table(where, filesystem=system)
        first = dict(zip(table["range"].to_pylist(), table["first"].to_pylist(), strict=True))
        return [replace(p, first=first[p.place]) for p in parts]

    def read(self, part: ByteRange | None):
        if part is None:  # there are no files
            return
        total = 0
        for number, columns in records(part):
            total += len(columns[0])
            for start in range(0, 0 if self.counts else len(columns[0]), BATCH):
                own = [c.slice(start, BATCH) for c in columns]
                at = np.arange(len(own[0])) + (part.first + number + start)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part.place)), pa.array(at), *own], schema=ARROW)
        if self.counts:
            yield pa.RecordBatch.from_arrays([pa.array([part.place]), pa.array([total]), pa.array([part.path]), *[pa.nulls(1, pa.string())] * 2], schema=ARROW)


class FastqStream(DataSourceStreamReader):
    """Files as they come into folders. An offset names the files up to it with their sizes, so a query that starts anew goes on with those it has not had.

    A file must be whole when it appears under its name, and stay as it is.
    """

    def __init__(self, options: dict):
        self.options, self.batch = options, FastqReader({k: v for k, v in options.items() if k not in ("counts", "firsts")} | {"path": ""})

    def initialOffset(self):
        return {}

    def latestOffset(self):
        out = {}
        for path in paths_of(self.options, (".fastq", ".fq")):
            system, where = located(path)
            out[path] = system.get_file_info(where).size
        return out

    def partitions(self, start: dict, end: dict):
        return ranges_of(sorted(set(end) - set(start)), self.batch.size)

    def read(self, part: ByteRange | None):
        return self.batch.read(part)

    def commit(self, end: dict):
        pass


class FastqSource(DataSource):
    """format("fastq"): range, at, id, seq, qual; range numbers the ranges of all files, at the records of a range from 0; FASTA records have an empty quality.

    Options: path (files and folders, comma-separated), range_bytes (32 MB), counts (a row for each
    range instead: how many records in at, the file in id), firsts (a Parquet table (range, first): the
    number of each range's first record, so that at counts the records of a file). Files are of one
    kind, FASTQ or FASTA, by their first record; those of one range may mix them. As a stream, files
    that come into the folders are read once each.
    """

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)

    def streamReader(self, schema):
        return FastqStream(self.options)


def read_fastq(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(rec_no, id, seq, qual); rec_no counts a file's records from 0.

    Files that fit into a range are read once. Others are read twice: the first time, tasks only count
    the records of their ranges, of which prefix sums (a row for each range) give each its first number.
    """
    from helixframe.operators.graph import shared_folder

    spark.dataSource.register(FastqSource)
    scan = spark.read.format("fastq").option("range_bytes", range_bytes)
    paths = paths_of({"path": path}, (".fastq", ".fq"))
    if len(ranges_of(paths, range_bytes)) > len(paths):
        counts = scan.option("counts", True).load(path)
        before = F.sum("at").over(Window.partitionBy("id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        firsts = shared_folder(spark, "ranges")
        counts.select("range", F.coalesce(before, F.lit(0)).alias("first")).write.parquet(firsts)
        scan = scan.option("counts", False).option("firsts", firsts)
    return scan.load(path).select(F.col("at").alias("rec_no"), "id", "seq", "qual")
