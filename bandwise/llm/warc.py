"""WARC records in ZIP packages: written by tasks, found through the directories, read by ranges."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.llm.common import new_folder, stored

#: A package is closed once its records take this much, so each is small work for a task.
PACKAGE_BYTES = 64 << 20
#: Records whose ranges are this close are read at once, up to so many bytes.
NEAR, AT_ONCE = 1 << 16, 4 << 20
CHUNK = 1 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

# Signatures and layouts of ZIP structures, and names of WARC fields.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def opened(path: str):
    """The file system and path within it that a task reads and writes with."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(value: str | None) -> str:
    """A URI for a record; a null id has one that no text can have."""
    return "<urn:record-without-id>" if value is None else f"<urn:record:{quote(value, safe='')}>"


def id_of(uri: str) -> str | None:
    return unquote(uri[len("<urn:record:") : -1]) if uri.startswith("<urn:record:") else None


def record_bytes(own_id: str | None, uri: str | None, payload: bytes, refers_to: str | None = None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit that names the response instead."""
    block = HTTP % len(payload) + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(own_id)}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: quote(c[0]), uri))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and payload of one record, as stored or gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, wbits=31)
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError("a WARC record ends early")
    block = rest[:length]
    return fields, block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block


class _Package:
    """A ZIP package being written: stored members with the records and, behind them, their index."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = opened(self.path)
        self.stream = system.open_output_stream(path, compression=None)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, own_id: str | None, record: bytes, date: str) -> None:
        packed = zlib.compressobj(4, zlib.DEFLATED, 31)
        data = packed.compress(record) + packed.flush()
        self.member.write(data)
        place = {"filename": RECORDS.rpartition("/")[2], "offset": str(self.size), "length": str(len(data))}
        self.index.append(f"{record_id(own_id)[1:-1]} {re.sub(r'[^0-9]', '', date)} {json.dumps(place)}")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{line}\n" for line in self.index))
        self.zip.close()
        self.stream.close()
        return self.path, self.size, len(self.index)


def write_packages(
    pages: DataFrame,
    folder: str | None = None,
    page_id: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Writes a record for each row and returns the packages: `_path`, `_bytes` (of records), `_records`.

    Of rows with equal payloads of at least `least_bytes` bytes, the smallest id is a response and the others revisit
    it; all smaller payloads are responses. A null payload is an empty one. A null id is larger than any other. Rows
    that repeat the smallest id with its payload are responses, each. A null uri leaves its field out; in others, spaces
    and control characters are percent-encoded. No rows, no packages. Other columns are not looked at.

    Digests are counted per task before they are shuffled, so copies of one payload are a row a task. Payloads are
    shuffled once, by digest, to a join with one row a digest, which adaptive execution splits where a digest is hot.
    A task writes packages under names of its own; only what a finished task returns is in the manifest, so files of
    lost tasks are never read.
    """
    folder = folder or new_folder(pages.sparkSession, "packages")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("_id"), F.col(uri).cast("string").alias("_uri"), body.alias("_body"))
    rows = rows.withColumn("_sha", F.concat(F.sha1("_body"), F.lit(":"), F.octet_length("_body").cast("string")))
    large = rows.filter(F.octet_length("_body") >= least_bytes)
    least = large.groupBy("_sha").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))).alias("_first"))
    joined = rows.join(least, "_sha", "left").select(
        F.col("_id").cast("string").alias("_id"),
        "_uri",
        "_body",
        F.col("_first.id").cast("string").alias("_refers"),
        (F.col("_first").isNotNull() & ~F.col("_first.id").eqNullSafe(F.col("_id"))).alias("_revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for own, uri, body, refers, revisit in zip(*batch.columns):
                package = package or _Package(folder)
                own = own.as_py()
                package.add(own, record_bytes(own, uri.as_py(), body.as_py(), refers.as_py(), revisit.as_py(), date), date)
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["_path", "_bytes", "_records"])

    local = re.match(r"(file:|/)", folder)
    if local:  # object stores have no folders to make
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
    return stored(joined.mapInArrow(run, "_path string, _bytes long, _records long"), "manifest")


@dataclass(frozen=True)
class Member:
    """An entry of a central directory."""

    name: str
    method: int
    size: int
    header: int  # place of its local header


def _tail(file, size: int) -> tuple[int, bytes]:
    """Place and bytes of the end record: the last one whose comment reaches the end of the file."""
    first = max(0, size - FULL16 - 22)
    data = file.read_at(size - first, first)
    at = data.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(data[at + 20 : at + 22], "little") != len(data):
        at = data.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    return first + at, data[at : at + 22]


def _directory(file, size: int) -> tuple[int, int, int, int]:
    """Place, bytes and entries of the central directory, and what stands ahead of the ZIP file within this one."""
    at, end = _tail(file, size)
    count, length, place = struct.unpack("<HLL", end[10:20])
    locator = file.read_at(20, at - 20) if at >= 20 else b""
    if locator[:4] == LOCATOR64:
        # The place in the locator is off by what stands ahead, so look right before the locator too.
        for start in (struct.unpack("<Q", locator[8:16])[0], at - 20 - 56):
            record = file.read_at(56, start) if 0 <= start <= size - 56 else b""
            if record[:4] == END64:
                count, length, place = struct.unpack("<QQQ", record[32:56])
                return start - length, length, count, start - length - place
        raise ValueError("the ZIP64 end record is missing")
    if count == FULL16 or FULL32 in (length, place):
        raise ValueError("the ZIP64 locator is missing")
    return at - length, length, count, at - length - place


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Values of 32 bits that are full stand in the ZIP64 field, in order."""
    while len(extra) >= 4:
        kind, length = struct.unpack("<HH", extra[:4])
        if kind == 1:
            field = extra[4 : 4 + length]
            for i, value in enumerate(values):
                if value == FULL32:
                    values[i], field = int.from_bytes(field[:8], "little"), field[8:]
            return values
        extra = extra[4 + length :]
    return values


def members(file, size: int) -> Iterator[Member]:
    """The entries of a ZIP file's central directory, ZIP64 or not, read in pieces of bounded size."""
    place, length, count, ahead = _directory(file, size)
    data, at, end = b"", place, place + length
    for _ in range(count):
        while len(data) < 46 or len(data) < 46 + sum(struct.unpack("<HHH", data[28:34])):
            more = file.read_at(min(CHUNK, end - at), at) if at < end else b""
            if not more:
                raise ValueError("the central directory ends early")
            data, at = data + more, at + len(more)
        if data[:4] != CENTRAL:
            raise ValueError("no entry of a central directory at this place")
        flags, method = struct.unpack("<HH", data[8:12])
        packed, full = struct.unpack("<LL", data[20:28])
        name, extra, comment = struct.unpack("<HHH", data[28:34])
        header = struct.unpack("<L", data[42:46])[0]
        full, packed, header = _wide(data[46 + name : 46 + name + extra], [full, packed, header])
        yield Member(data[46 : 46 + name].decode("utf-8" if flags & 0x800 else "cp437"), method, packed, header + ahead)
        data = data[46 + name + extra + comment :]


def data_place(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed within its package; only stored members can be read by ranges")
    head = file.read_at(30, member.header)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    name, extra = struct.unpack("<HH", head[26:30])
    return member.header + 30 + name + extra


def _lines(file, place: int, size: int) -> Iterator[bytes]:
    rest, at = b"", place
    while at < place + size:
        data = file.read_at(min(CHUNK, place + size - at), at)
        at += len(data)
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _scanned(file, place: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of records found by reading through a member that no index covers, in bounded memory."""
    at, end = place, place + size

    def piece(where: int) -> bytes:
        return file.read_at(min(CHUNK, end - where), where) if where < end else b""

    while at < end:
        data = piece(at)
        if data[:2] == b"\x1f\x8b":
            packed, read = zlib.decompressobj(31), at
            while not packed.eof:
                data = piece(read)
                if not data:
                    raise ValueError("a gzipped record ends early")
                packed.decompress(data)
                read += len(data)
            stop = read - len(packed.unused_data)
        else:
            head = re.match(rb"(?:\r\n)*WARC/.*?\r\n\r\n", data, re.S)
            if not head:
                if data.strip():
                    raise ValueError("no WARC record at this place")
                return
            blank = len(data) - len(data.lstrip(b"\r\n"))
            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head[0])
            at += blank
            stop = at + head.end() - blank + int(length[1]) + 4
        yield at, stop - at
        at = stop


def package_ranges(file, size: int) -> Iterator[tuple[int, int]]:
    """Places and lengths of all records of a package: from its indexes, and by reading where no index has a member."""
    found = list(members(file, size))
    archives = {m.name.rpartition("/")[2]: m for m in found if re.search(r"\.warc(\.gz)?$", m.name)}
    begins = {name: data_place(file, m) for name, m in archives.items()}
    indexed = set()
    for member in found:
        if not member.name.endswith(".cdxj"):
            continue
        for line in _lines(file, data_place(file, member), member.size):
            _, _, place = line.partition(b"{")
            if not place:
                continue
            entry = json.loads(b"{" + place)
            name = entry["filename"]
            offset, length = int(entry["offset"]), int(entry["length"])
            if name not in archives or offset < 0 or offset + length > archives[name].size:
                raise ValueError(f"the index points outside of {name}")
            indexed.add(name)
            yield begins[name] + offset, length
    for name, member in archives.items():
        if name not in indexed:
            yield from _scanned(file, begins[name], member.size)


def list_packages(spark: SparkSession, path: str) -> DataFrame:
    """The packages below a folder, as `_path`; nothing of them is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("_path"))


def locate_records(packages: DataFrame) -> DataFrame:
    """`_path`, `_offset`, `_length` of every record in the packages named by `_path`; each package is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = opened(path)
                with system.open_input_file(inner) as file:
                    yield from _in_batches(package_ranges(file, file.size()), lambda rows: _ranges_batch(path, rows))

    spread = packages.select("_path").repartition(F.col("_path"))
    return spread.mapInArrow(run, "_path string, _offset long, _length long")


def _in_batches(rows: Iterator, make: Callable, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield make(kept)
            kept = []
    if kept:
        yield make(kept)


def _ranges_batch(path: str, rows: list[tuple[int, int]]) -> pa.RecordBatch:
    offsets, lengths = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["_path", "_offset", "_length"])


def _read_ranges(rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes of each range; ranges of one file that lie close together are read at once."""
    at, file, name = 0, None, None
    while at < len(rows):
        path, first, length = rows[at]
        stop, last = at + 1, first + length
        while stop < len(rows) and rows[stop][0] == path and last <= rows[stop][1] <= last + NEAR and rows[stop][1] + rows[stop][2] - first <= AT_ONCE:
            last = rows[stop][1] + rows[stop][2]
            stop += 1
        if path != name:
            if file:
                file.close()
            system, inner = opened(path)
            file, name = system.open_input_file(inner), path
        data = memoryview(file.read_at(last - first, first))
        for _, offset, length in rows[at:stop]:
            yield bytes(data[offset - first : offset - first + length])
        at = stop
    if file:
        file.close()


def read_records(ranges: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records at (`_path`, `_offset`, `_length`): `_record`, `_id`, `_type`, `_refers`, `_uri`, `_bytes`, `_digest`, `_valid`.

    `_bytes` and `_digest` of a response are those of the payload read; `_valid` says whether the digest is the one in
    its header. A revisit has the digest of its header and no bytes. With `with_payload`, `_payload` holds the bytes.
    """
    extra = ", _payload binary" if with_payload else ""
    schema = f"_record string, _id string, _type string, _refers string, _uri string, _bytes long, _digest string, _valid boolean{extra}"
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload

    def parsed(data: bytes) -> tuple:
        fields, payload = parse_record(data)
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        own, uri = fields["warc-record-id"], fields.get("warc-target-uri")
        if fields["warc-type"] == "revisit":
            return (own, id_of(own), "revisit", fields.get("warc-refers-to"), uri, None, told, True, None)[: len(kinds)]
        digest = payload_digest(payload)
        return (own, id_of(own), fields["warc-type"], None, uri, len(payload), digest, told in ("", digest), payload)[: len(kinds)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=re.findall(r"_\w+", schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            yield from _in_batches((parsed(data) for data in _read_ranges(rows)), batch_of, 256 if with_payload else 4096)

    # Neighbours in a file go to one task, in order, so that most of a package is a few large reads.
    ordered = ranges.select("_path", "_offset", "_length").repartitionByRange("_path", "_offset").sortWithinPartitions("_path", "_offset")
    return ordered.mapInArrow(run, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records in which revisits have the `_bytes` of the response they name, and `_refers_id`, its id.

    A revisit whose response isn't there, or has another digest, has none.
    """
    responses = records.filter(F.col("_type") == "response").groupBy(F.col("_record").alias("_there"), F.col("_digest").alias("_same")).agg(F.min("_bytes").alias("_full"), F.first("_id").alias("_refers_id"))
    on = (F.col("_refers") == F.col("_there")) & (F.col("_digest") == F.col("_same"))
    joined = records.join(responses, on, "left").withColumn("_bytes", F.coalesce("_bytes", "_full"))
    return joined.drop("_there", "_same", "_full")
