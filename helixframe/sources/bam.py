"""BAM as a Python data source: ranges of BGZF blocks, alignments as Arrow batches.

A range owns the records whose first byte is in its blocks. Where it begins inside a record, the next
one is found by its fields: references, sizes that fit, the name's end, and the records that follow.
"""

import gzip
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual

from helixframe import schemas
from helixframe.sources.splits import RANGE_BYTES, ByteRange, chunks, kind_of, located, paths_of, ranges_of

BASE_CODES = "=ACMGRSVTWYHKDBN"
CIGAR_CODES = "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAGS = ("CB", "UB", "GN", "GX")
#: Bytes before a record's name, its size included.
FIXED = 36
#: Records that must follow one another where a range begins.
FOLLOWING = 6
BATCH = 10_000
PAIRS = np.array([ord(BASE_CODES[b >> 4]) | ord(BASE_CODES[b & 15]) << 8 for b in range(256)], dtype="<u2")


def bam_header(stream) -> tuple[str, list[tuple[str, int]]]:
    """The header's text and the references, and the stream stands at the first record."""
    if stream.read(4) != b"BAM\x01":
        raise ValueError("this is not a BAM file")
    text = stream.read(struct.unpack("<i", stream.read(4))[0]).rstrip(b"\0").decode()
    references = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode()
        references.append((name, struct.unpack("<i", stream.read(4))[0]))
    return text, references


def header_of(path: str) -> tuple[list[tuple[str, int]], int]:
    """The references of a file, and how many bytes its header has when decompressed."""
    system, where = located(path)
    with system.open_input_file(where) as raw:
        stream = raw if kind_of(path) == "plain" else gzip.GzipFile(fileobj=raw)
        references = bam_header(stream)[1]
        return references, stream.tell()


def string_tags(data: bytes) -> dict[str, str]:
    """The string-typed tags among TAGS; those of another type count as absent."""
    out, at = {}, 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            if tag in TAGS and kind == "Z":
                out[tag] = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + TAG_SIZES[chr(data[at])] * struct.unpack("<i", data[at + 1 : at + 5])[0]
        else:
            at += TAG_SIZES[kind]
    return out


@lru_cache(maxsize=100_000)
def cigar_of(packed: bytes) -> str:
    return "".join(f"{x >> 4}{CIGAR_CODES[x & 15]}" for x in struct.unpack(f"<{len(packed) // 4}I", packed))


class Fields:
    """The fixed fields of records that begin at the places given, as arrays."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        whole = raw[at[:, None] + np.arange(FIXED)]
        of = lambda start, kind: np.ascontiguousarray(whole[:, start : start + np.dtype(kind).itemsize]).view(kind).ravel().astype(np.int64)
        self.size, self.tid, self.pos = of(0, "<i4"), of(4, "<i4"), of(8, "<i4")
        self.l_name, self.mapq, self.n_cigar, self.flag = of(12, "u1"), of(13, "u1"), of(16, "<u2"), of(18, "<u2")
        self.l_seq, self.next_tid, self.next_pos = of(20, "<i4"), of(24, "<i4"), of(28, "<i4")
        self.name = at + FIXED
        self.cigar = self.name + self.l_name
        self.seq = self.cigar + 4 * self.n_cigar
        self.qual = self.seq + (self.l_seq + 1) // 2
        self.tags, self.end = self.qual + self.l_seq, at + 4 + self.size


def plausible(raw: np.ndarray, at: np.ndarray, references: int) -> np.ndarray:
    """Whether records may begin at the places given, each at least FIXED bytes before the end."""
    f = Fields(raw, at)
    fine = (f.tid >= -1) & (f.tid < references) & (f.next_tid >= -1) & (f.next_tid < references) & (f.pos >= -1) & (f.next_pos >= -1)
    fine &= (f.l_name > 0) & (f.l_seq >= 0) & (f.size < 1 << 28) & (f.tags <= f.end)
    ends = f.cigar - 1
    inside = ends < len(raw)
    return fine & np.where(inside, raw[np.minimum(ends, len(raw) - 1)] == 0, True)


def first_record(data: bytes, references: int, ended: bool) -> int | None:
    """The first place at which a record begins and others, or the end, follow; None if more bytes are needed, the end if there is none."""
    raw = np.frombuffer(data, dtype=np.uint8)
    for start in range(0, len(raw) - FIXED + 1, 1 << 16):
        places = np.arange(start, min(start + (1 << 16), len(raw) - FIXED + 1))
        for place in places[plausible(raw, places, references)].tolist():
            at, fine = place, True
            for _ in range(FOLLOWING):
                at += 4 + struct.unpack("<i", data[at : at + 4])[0]
                if at == len(data) and ended:
                    break
                if at + FIXED > len(data):
                    if not ended:
                        return None
                    fine = False
                    break
                if not plausible(raw, np.array([at]), references)[0]:
                    fine = False
                    break
            if fine:
                return place
    return len(data) if ended else None


def whole_records(data: bytes, at: int, limit: int) -> tuple[np.ndarray, int]:
    """Places of the whole records that begin at `at` and before limit, and where the next begins."""
    out, size = [], struct.Struct("<i").unpack_from
    while at < limit and at + 4 <= len(data):
        end = at + 4 + size(data, at)[0]
        if end > len(data):
            break
        out.append(at)
        at = end
    return np.array(out, dtype=np.int64), at


def between(starts: np.ndarray, ends: np.ndarray, data, kind=pa.StringArray) -> pa.Array:
    """The bytes from each start to its end; the spans stand in order."""
    bounds = np.stack([starts, ends], axis=1).astype(np.int32).ravel()
    if not len(starts):
        return pa.array([], pa.string() if kind is pa.StringArray else pa.binary())
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    spread = pa.Array.from_buffers(pa.string() if kind is pa.StringArray else pa.binary(), 2 * len(starts) - 1, buffers)
    return spread.take(pa.array(np.arange(0, 2 * len(starts) - 1, 2)))


def alignments(data: bytes, at: np.ndarray) -> pa.RecordBatch:
    raw = np.frombuffer(data, dtype=np.uint8)
    f = Fields(raw, at)
    packed = (f.l_seq + 1) // 2
    before = np.cumsum(packed) - packed
    bases = PAIRS[raw[np.repeat(f.seq - before, packed) + np.arange(packed.sum())]]
    tags = [string_tags(data[a:b]) for a, b in zip(f.tags.tolist(), f.end.tolist(), strict=True)]
    cigars = [cigar_of(data[a:b]) for a, b in zip(f.cigar.tolist(), f.seq.tolist(), strict=True)]
    columns = [between(f.name, f.cigar - 1, data), between(2 * before, 2 * before + f.l_seq, bases.tobytes()), between(f.qual, f.tags, data, pa.BinaryArray)]
    columns += [pa.array(f.mapq, pa.int16()), pa.array(f.tid, pa.int32()), pa.array(f.pos, pa.int64()), pa.array(cigars, pa.string())]
    columns += [pa.array([t.get(k) for t in tags], pa.string()) for k in TAGS]
    columns += [pa.array(f.flag & 4 == 0), pa.array(f.flag & 16 > 0)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schemas.BAM.split(", ")])


def records(part: ByteRange, least: int = 0):
    """Batches of the alignments that the range owns, of at least a mapping quality."""
    references, header = header_of(part.path)
    data, own, at, found = b"", 0, 0, part.start == 0
    if found:
        at = header
    source, more = chunks(part), True
    while more:
        piece, mine = next(source, (None, False))
        more = piece is not None
        if more:
            cut = min(at, len(data))
            data = data[cut:] + piece
            own, at = own - cut + (len(piece) if mine else 0), at - cut
        if not found:
            if not own:
                return
            place = first_record(data, len(references), not more)
            if place is None:
                continue
            at, found = place, True
        if at < own:
            places, at = whole_records(data, at, own)
            if least and len(places):
                places = places[np.frombuffer(data, dtype=np.uint8)[places + 13] >= least]
            for start in range(0, len(places), BATCH):
                yield alignments(data, places[start : start + BATCH])
        if not mine and at >= own:
            return
    if at < own:
        raise ValueError(f"{part.path} ends inside a record")


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = paths_of(options, (".bam",))
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        self.least = int(options.get("min_mapq", 0))

    def pushFilters(self, filters):
        """Takes mapq >= k and mapq > k, so that rejected records are not decoded."""
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, GreaterThan)) and f.attribute == ("mapq",):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            else:
                yield f

    def partitions(self):
        return ranges_of(self.paths, self.size, cut=("bgzf",))

    def read(self, part: ByteRange | None):
        return iter(()) if part is None else records(part, self.least)  # None: there are no files


class BamSource(DataSource):
    """format("bam"): alignments with the tags CB, UB, GN and GX. Options: path, range_bytes (32 MB), min_mapq; filters on mapq are pushed down."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return schemas.BAM

    def reader(self, schema):
        return BamReader(self.options)

    def writer(self, schema, overwrite):
        from helixframe.sinks.bam import BamWriter

        return BamWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str, min_mapq: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("bam").option("min_mapq", min_mapq).option("range_bytes", range_bytes).load(path)


def bam_references(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, length) of the header of a BAM file, or of the first in a folder."""
    first = paths_of({"path": path}, (".bam",))[0]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(header_of(first)[0])], "tid int, name string, length int")
