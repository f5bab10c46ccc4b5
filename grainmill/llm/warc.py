"""Web archives in ZIP packages: a writer, and a reader that never extracts them.

A package stores (method 0) two members: archive/data.warc.gz, one gzip member a WARC record, and
indexes/index.jsonl, a line a record with its place in the former. The writer always adds the ZIP64 records. The
reader finds the end record, follows the ZIP64 locator where there is one, walks the central directory, takes a
member's place from its local header and reads only the byte ranges it needs.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import chunks, new_dir, open_fs, publish, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_LOCAL, _CENTRAL = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I")
_END, _END64, _LOCATOR = struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


class PackageWriter:
    """Writes stored members one after another to a stream that can't seek."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self._put(_LOCAL.pack(b"PK\3\4", 45, 0x808, 0, 0, 33, 0, FULL32, FULL32, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Append to the member; returns where in it the data stand."""
        member = self.members[-1]
        at, member[2], member[3] = member[3], zlib.crc32(data, member[2]), member[3] + len(data)
        self._put(data)
        return at

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<4sI2Q", b"PK\7\x08", crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            extra = struct.pack("<2H3Q", 1, 24, size, size, at)
            self._put(_CENTRAL.pack(b"PK\1\2", 45, 45, 0x808, 0, 0, 33, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
        size, end64, n = self.at - start, self.at, len(self.members)
        self._put(_END64.pack(b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start) + _LOCATOR.pack(b"PK\6\7", 0, end64, 1))
        self._put(_END.pack(b"PK\5\6", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


class Package:
    """Stored members of a ZIP file by range reads. source has size(), seek() and read()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail_at = max(0, size - (_END.size + FULL16))
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and (end + _END.size > len(tail) or end + _END.size + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\5\6", 0, end)
        if end < 0:
            raise ValueError("not a ZIP file")
        _, _, _, _, n, length, at, _ = _END.unpack_from(tail, end)
        before = tail_at + end - _LOCATOR.size
        locator = self.range(before, _LOCATOR.size) if before >= 0 else b""
        if locator[:4] == b"PK\6\7":
            end64 = _LOCATOR.unpack(locator)[2]
            *_, n, length, at = _END64.unpack(self.range(end64, _END64.size))
        elif FULL32 in (length, at) or n == FULL16:
            raise ValueError("ZIP64 record is missing")
        self.members = dict(self._directory(self.range(at, length), n))

    def range(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _directory(self, raw: bytes, n: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        k = 0
        for _ in range(n):
            sign, _, _, flags, method, _, _, _, packed, size, a, b, c, _, _, _, at = _CENTRAL.unpack_from(raw, k)
            if sign != b"PK\1\2":
                raise ValueError("damaged central directory")
            k += _CENTRAL.size
            name, extra = raw[k : k + a].decode("utf-8" if flags & 0x800 else "cp437"), raw[k + a : k + a + b]
            k += a + b + c
            e = 0
            while e + 4 <= len(extra):
                kind, length = struct.unpack_from("<2H", extra, e)
                if kind == 1:  # 64-bit values stand for the fields that are full, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                    size = next(values) if size == FULL32 else size
                    packed = next(values) if packed == FULL32 else packed
                    at = next(values) if at == FULL32 else at
                e += 4 + length
            yield name, (method, at, packed)

    def place(self, name: str) -> tuple[int, int]:
        """(first byte, size) of a stored member."""
        method, at, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed, so it can't be read by range")
        head = _LOCAL.unpack(self.range(at, _LOCAL.size))
        return at + _LOCAL.size + head[-2] + head[-1], size


def _record(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{payload_digest}"}
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, sha1 and keeper (the page that the payload's revisits refer to) of each page that revisits another.

    Digests are counted before the exchange, so a payload of a third of all rows is a row a task there. What joins them
    back has no payload in it.
    """
    own = pages.select("page_id", F.sha1(html := F.coalesce("html", F.lit(""))).alias("sha1"), F.octet_length(html).alias("size")).filter(F.col("size") >= least_bytes)
    shared = own.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n")
    return own.join(shared, "sha1").filter(F.col("page_id") < F.col("keeper")).select("page_id", "sha1", "keeper").distinct()


def write_archives(pages: DataFrame, *, least_bytes: int = 0) -> tuple[str, list[int]]:
    """A WARC record for every page; returns the folder and the parts written.

    Null html counts as empty. Of pages with equal payloads the one with the largest page_id is the response and the
    others revisit it; payloads below least_bytes are all responses. Rows that repeat a page_id and payload have equal
    records. A null page_id is a response, which nothing refers to unless all its copies lack an id.
    """
    folder = new_dir(pages.sparkSession, "warc")
    fs, path = open_fs(folder)
    fs.create_dir(path)
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    ready = known.join(written(roles(pages, least_bytes), "roles"), ["page_id", "sha1"], "left").select("page_id", "url", "html", "sha1", "keeper")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, package, index = TaskContext.get(), None, []
        fs, path = open_fs(folder)
        part = task.partitionId()
        temporary = f"{path}/.part-{part:06d}.{task.taskAttemptId()}"
        for batch in chunks(batches, "html"):
            if package is None:
                out = fs.open_output_stream(temporary)
                package = PackageWriter(out)
                package.begin(DATA)
            for row in batch.to_pylist():
                raw = _record(row["page_id"], row["url"], row["html"].encode(), base64.b32encode(bytes.fromhex(row["sha1"])).decode(), row["keeper"])
                index.append(json.dumps({"page_id": row["page_id"], "offset": package.write(raw), "length": len(raw)}))
        if package is not None:
            package.end()
            package.begin(INDEX)
            package.write("\n".join(index).encode())
            package.end()
            package.close()
            out.close()
            publish(fs, temporary, f"{path}/part-{part:06d}.wacz")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

    return folder, sorted(r.part for r in ready.mapInArrow(write, "part int").collect())  # a row per file


def records(package: Package, step: int = 4_000_000) -> Iterator[tuple[dict, dict[str, str], bytes]]:
    """(index entry, headers, block) of every record, in reads of about `step` bytes."""
    at, size = package.place(INDEX)
    entries = [json.loads(x) for x in package.range(at, size).splitlines()]
    base, _ = package.place(DATA)
    k = 0
    while k < len(entries):
        first, n = entries[k]["offset"], k
        while n < len(entries) and (n == k or entries[n]["offset"] + entries[n]["length"] - first <= step):
            n += 1
        raw = package.range(base + first, entries[n - 1]["offset"] + entries[n - 1]["length"] - first)
        for e in entries[k:n]:
            yield e, *parse_record(raw[e["offset"] - first : e["offset"] - first + e["length"]])
        k = n


def read_archives(spark: SparkSession, folder: str, parts: list[int]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and target_uri of every record, from the archives."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(names))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            rows: list[tuple] = []
            with fs.open_input_file(f"{path}/part-{parts[k]:06d}.wacz") as source:
                for entry, head, block in records(Package(source)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload), digest(payload)) != (size, stated):
                        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    refers = head.get("WARC-Refers-To")
                    rows.append((entry["page_id"], size, stated, head["WARC-Type"], int(refers[10:-1]) if refers else None, head["WARC-Target-URI"]))
                    if len(rows) == 5000:
                        yield table(rows)
                        rows = []
            yield table(rows)

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def warc(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write every page into archives and read them back. An empty table gives an empty result."""
    return read_archives(pages.sparkSession, *write_archives(pages, least_bytes=least_bytes))
