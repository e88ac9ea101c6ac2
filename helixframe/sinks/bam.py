"""A BAM writer: each task writes a whole file into a hidden folder, and the driver's commit names them."""

import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from helixframe.sources.bam import BASE_CODES, CIGAR_CODES, BamSource
from helixframe.sources.splits import located

TAG_COLUMNS = ((b"CB", "cell_barcode"), (b"UB", "umi"), (b"GN", "gene_name"), (b"GX", "gene_id"))
BLOCK = 60_000


def bam_bytes(record: dict) -> bytes:
    """One alignment in BAM form."""
    name = record["name"].encode() + b"\0"
    ops, number = [], ""
    for ch in record["cigar"]:
        if ch.isdigit():
            number += ch
        else:
            ops.append(int(number) << 4 | CIGAR_CODES.index(ch))
            number = ""
    seq, qual = record["seq"], bytes(record["qual"])
    codes = [BASE_CODES.index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    tags = b"".join(tag + b"Z" + record[c].encode() + b"\0" for tag, c in TAG_COLUMNS if record[c] is not None)
    flag = (0 if record["is_mapped"] else 4) | (16 if record["is_reverse"] else 0)
    core = struct.pack("<iiBBHHHiiii", record["tid"], record["pos"], len(name), record["mapq"], 4680, len(ops), flag, len(seq), -1, -1, 0)
    data = core + name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return struct.pack("<i", len(data)) + data


def bgzf_block(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header_bytes(references: list[tuple[str, int]]) -> bytes:
    text = b"@HD\tVN:1.6\tSO:unsorted\n@PG\tID:helixframe\tPN:helixframe\n"
    named = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in references)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references)) + named


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class BamWriter(DataSourceArrowWriter):
    """Options: path (a folder), references (name:length, comma-separated), job (a name for the hidden folder).

    A part is written under the hidden folder with a name of its own for each attempt; commit moves the
    parts that the driver was told of, in partition order, and removes what is left. abort removes all.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.hidden = f"{self.path}/_{uuid.uuid4().hex}"
        self.references = [(n, int(length)) for n, _, length in (r.rpartition(":") for r in options.get("references", "").split(",") if r)]

    def write(self, batches) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, n = f"part-{task.partitionId():05d}.bam", 0
        system, hidden = located(f"{self.hidden}/{uuid.uuid4().hex}")
        system.create_dir(hidden, recursive=True)
        with system.open_output_stream(f"{hidden}/{name}") as f:
            waiting = [header_bytes(self.references)]
            size = len(waiting[0])
            for batch in batches:
                for record in batch.to_pylist():
                    waiting.append(bam_bytes(record))
                    size += len(waiting[-1])
                    n += 1
                    if size >= BLOCK:
                        data = b"".join(waiting)
                        whole = len(data) - len(data) % BLOCK
                        for at in range(0, whole, BLOCK):
                            f.write(bgzf_block(data[at : at + BLOCK]))
                        waiting, size = [data[whole:]], len(data) - whole
            if size:
                data = b"".join(waiting)
                for at in range(0, len(data), BLOCK):
                    f.write(bgzf_block(data[at : at + BLOCK]))
            f.write(bgzf_block(b""))
        return Written(f"{hidden}/{name}", n)

    def commit(self, messages) -> None:
        system, path = located(self.path)
        if self.overwrite:
            from pyarrow import fs

            for old in system.get_file_info(fs.FileSelector(path)):
                if old.type == fs.FileType.File:
                    system.delete_file(old.path)
        for m in messages:
            if m is not None:
                system.move(m.name, f"{path}/{m.name.rpartition('/')[2]}")
        self.clear()

    def abort(self, messages) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        system, hidden = located(self.hidden)
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_dir(hidden)


def write_bam(alignments: DataFrame, references: list[tuple[str, int]], path: str) -> None:
    """A folder of BAM files with a default header each, one for each partition; no record passes the driver."""
    alignments.sparkSession.dataSource.register(BamSource)
    named = ",".join(f"{n}:{length}" for n, length in references)
    alignments.write.format("bam").option("references", named).mode("overwrite").save(path)
