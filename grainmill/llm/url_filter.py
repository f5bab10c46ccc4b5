"""URL verdicts from a sorted array of digests.

The list's entries are a host and a path prefix each. One file holds the sorted 64-bit xxhash keys of host + path and
the strings themselves. Executors memory-map it (or read it, if the shared folder isn't a local path), probe every
suffix of a URL's host with every prefix length that the list has by vectorised binary search, and confirm each hit
against the stored string, so colliding digests can't decide anything.

A rule fits its host and all subdomains where the path starts with the rule's; the longest rule decides, of equally
long ones that of the longer host. Without a rule, a URL is blocked if its host or a parent domain is listed, and
allowed otherwise. Null URLs and URLs without :// have an empty host and path and are allowed. Hosts and paths may be
of any length: suffixes longer than the longest listed host aren't probed, so work and memory follow a URL's length; repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from grainmill.llm.common import chunks, new_dir, open_fs

BLOCK, ALLOW, LISTED = 0, 1, 2  # a rule's verdicts; a blocked domain
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, found, rest = (url or "").partition("://")
    host, path = _PARTS.match(rest if found else "").groups()
    return host.translate(_UPPER), path


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def build(entries: list[tuple[str, str, int]], key=digest) -> bytes:
    """The file of (host, path, kind): n, blob size and path lengths, then keys, string ends, host lengths, kinds, strings."""
    rows = sorted({(key(h + p), (h + p).encode(), len(h.encode()), kind) for h, p, kind in entries})
    lengths = sorted({len(p) for _, p, _ in entries})
    blob = b"".join(r[1] for r in rows)
    ends = np.cumsum([len(r[1]) for r in rows], dtype=np.uint64)
    parts = (struct.pack("<QQQ", len(rows), len(blob), len(lengths)), np.array(lengths, "<u8"), np.array([r[0] for r in rows], "<u8"), ends.astype("<u8"), np.array([r[2] for r in rows], "<u4"), np.array([r[3] for r in rows], "u1"), blob)
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class DigestIndex:
    """The file, mapped or in memory."""

    def __init__(self, buffer, key=digest):
        self.key = key
        n, size, m = struct.unpack_from("<QQQ", buffer)
        at = 24
        self.lengths = np.frombuffer(buffer, "<u8", m, at).tolist()
        self.keys = np.frombuffer(buffer, "<u8", n, at := at + 8 * m)
        self.ends = np.frombuffer(buffer, "<u8", n, at := at + 8 * n)
        self.hosts = np.frombuffer(buffer, "<u4", n, at := at + 8 * n)
        self.kinds = np.frombuffer(buffer, "u1", n, at := at + 4 * n)
        self.blob = np.frombuffer(buffer, "u1", size, at + n)
        self.longest = int(self.hosts.max(initial=0))  # no longer suffix of a host can be listed

    @classmethod
    def open(cls, uri: str) -> DigestIndex:
        fs, path = open_fs(uri)
        if fs.type_name == "local":
            return cls(pa.memory_map(path).read_buffer())
        with fs.open_input_file(path) as f:
            return cls(f.read_buffer())

    def string(self, k: int) -> bytes:
        return self.blob[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes()

    def find(self, probes: list[str]) -> Iterator[tuple[int, int]]:
        """(probe, entry) of each probe whose full string is stored."""
        digests = np.array([self.key(p) for p in probes], np.uint64)
        at = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)) if len(self.keys) else ():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if self.string(k) == probes[i].encode():
                    yield int(i), k
                k += 1

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each URL."""
        split = [split_url(u) for u in urls]
        probes, owner = [], []
        for i, (host, path) in enumerate(split):
            at = len(host)
            while at > 0:
                at = host.rfind(".", 0, at)
                if len(host) - at - 1 > self.longest:
                    break
                suffix = host[at + 1 :]
                own = [suffix + path[:n] for n in self.lengths if len(path) >= n] if suffix else []
                probes += own
                owner += [i] * len(own)
        best: dict[int, tuple[int, int, int]] = {}
        listed = set()
        for j, k in self.find(probes):
            if self.kinds[k] == LISTED:
                listed.add(owner[j])
            else:
                best[owner[j]] = max(best.get(owner[j], (0, 0, -1)), (len(probes[j]), int(self.hosts[k]), k))
        out = []
        for i, (host, path) in enumerate(split):
            if i in best:
                k = best[i][2]
                out.append((host, path, self.string(k).decode(), ("block", "allow")[self.kinds[k]]))
            else:
                out.append((host, path, None, "block" if i in listed else "allow"))
        return out


_open: dict[str, DigestIndex] = {}


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: Iterable[str]) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; rules: (verdict, host, path), blocked: domains."""
    entries = [(h, p, ALLOW if v == "allow" else BLOCK) for v, h, p in rules] + [(h, "", LISTED) for h in blocked]
    uri = new_dir(pages.sparkSession, "urls")
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0])
    with fs.open_output_stream(path) as f:
        f.write(build(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if uri not in _open:
            _open.clear()
            _open[uri] = DigestIndex.open(uri)
        for batch in chunks(batches, "url"):
            got = _open[uri].judge(batch.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array([g[i] for g in got], pa.string()) for i in range(4))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
