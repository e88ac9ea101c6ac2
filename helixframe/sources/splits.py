"""Files in byte ranges: listing, opening, and streams of decompressed bytes that know which of them are the range's own.

Paths may be local or URIs that pyarrow's file systems know (file, hdfs, s3, gs). Plain files are cut
anywhere, files of BGZF blocks at blocks; other gzip and zstd files are one range.
"""

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

RANGE_BYTES = 32 << 20
READ_BYTES = 4 << 20
GZIP, ZSTD, BGZF = b"\x1f\x8b", b"\x28\xb5\x2f\xfd", b"\x1f\x8b\x08\x04"
#: The longest BGZF block.
BLOCK_BYTES = 1 << 16


@dataclass(frozen=True)
class ByteRange(InputPartition):
    """Bytes start to end of a file; place numbers the ranges of all files. first: the number of its first record, where known."""

    path: str
    place: int
    start: int
    end: int
    first: int = 0


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def paths_of(options: dict, suffixes: tuple[str, ...]) -> list[str]:
    """The files of the option path: comma-separated files and folders; of a folder those with one of the suffixes in their names, or all if none has one."""
    found: list[str] = []
    for part in filter(None, (p.strip() for p in options.get("path", "").split(","))):
        system, where = located(part)
        info = system.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(part)
        if info.type == fs.FileType.Directory:
            scheme = part[: part.index("://") + 3] if "://" in part and not part.startswith("file:") else ""
            names = sorted(f.path for f in system.get_file_info(fs.FileSelector(where)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
            named = [p for p in names if any(s in p.rpartition("/")[2] for s in suffixes)]
            found += [scheme + p for p in named or names]
        else:
            found.append(part)
    return found


def kind_of(path: str) -> str:
    """plain, bgzf, gzip or zstd, by the first bytes."""
    system, where = located(path)
    with system.open_input_file(where) as f:
        head = f.read(18)
    if head[:4] == BGZF and block_size(head) is not None:
        return "bgzf"
    return "gzip" if head[:2] == GZIP else "zstd" if head[:4] == ZSTD else "plain"


def ranges_of(paths: list[str], size: int = RANGE_BYTES, cut: tuple[str, ...] = ("plain", "bgzf")) -> list[ByteRange]:
    """Ranges of about size bytes of files of the kinds that can be cut, and one of each other file."""
    spans = []
    for path in paths:
        system, where = located(path)
        whole = system.get_file_info(where).size
        step = size if kind_of(path) in cut else max(whole, 1)
        spans += [(path, start, min(whole, start + step)) for start in range(0, max(whole, 1), step)]
    return [ByteRange(path, i, start, end) for i, (path, start, end) in enumerate(spans)]


def block_size(head: bytes) -> int | None:
    """Bytes of the BGZF block that begins so; None where it is none."""
    if len(head) < 18 or head[:4] != BGZF:
        return None
    extra, at = struct.unpack("<H", head[10:12])[0], 12
    while at + 6 <= min(12 + extra, len(head)):
        name, size = head[at : at + 2], struct.unpack("<H", head[at + 2 : at + 4])[0]
        if name == b"BC" and size == 2:
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + size
    return None


def first_block(data: bytes, whole: bool) -> int | None:
    """The first place in data at which a BGZF block begins and another or the file's end follows. whole: the file ends with data."""
    at = data.find(BGZF)
    while at >= 0:
        size = block_size(data[at : at + 64])
        if size is not None and (data[at + size : at + size + 4] == BGZF or whole and at + size == len(data)):
            return at
        at = data.find(BGZF, at + 1)
    return None


def plain_chunks(f, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    f.seek(start)
    while start < end and (data := f.read(min(READ_BYTES, end - start))):
        start += len(data)
        yield data, True
    while data := f.read(BLOCK_BYTES):
        yield data, False


def bgzf_chunks(f, start: int, end: int, size: int) -> Iterator[tuple[bytes, bool]]:
    at = start
    if start:
        f.seek(start)
        data = f.read(3 * BLOCK_BYTES)
        place = first_block(data, start + len(data) >= size)
        if place is None:
            return
        at = start + place
    f.seek(at)
    held, own = b"", []
    while True:
        if len(held) < BLOCK_BYTES + 64 and (more := f.read(READ_BYTES if at < end else BLOCK_BYTES)):
            held += more
        if not held:
            break
        length = block_size(held[:64])
        if length is None or length > len(held):
            raise ValueError(f"there is no whole BGZF block at {at}")
        data = zlib.decompress(held[12 + struct.unpack("<H", held[10:12])[0] : length - 8], -15)
        mine, held, at = at < end, held[length:], at + length
        if mine:
            own.append(data)
            if len(own) == 64:
                yield b"".join(own), True
                own = []
        else:
            if own:
                yield b"".join(own), True
                own = []
            yield data, False
    if own:
        yield b"".join(own), True


def stream_chunks(raw, kind: str) -> Iterator[tuple[bytes, bool]]:
    import gzip

    if kind == "zstd":
        import zstandard

        f = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    else:
        f = gzip.GzipFile(fileobj=raw)
    while data := f.read(READ_BYTES):
        yield data, True


def chunks(part: ByteRange) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether they are the range's own) from the range's start to the file's end; stop reading when enough has come."""
    system, where = located(part.path)
    kind = kind_of(part.path)
    with system.open_input_file(where) as f:
        if kind == "plain":
            yield from plain_chunks(f, part.start, part.end)
        elif kind == "bgzf":
            yield from bgzf_chunks(f, part.start, part.end, f.size())
        else:
            yield from stream_chunks(f, kind)
