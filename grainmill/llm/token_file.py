"""Token-ID files in patched frame-of-reference blocks.

A file holds the ids of documents in ascending doc_id order. Each block of up to BLOCK ids stores its minimum, the
differences from it packed at the width that a percentile of them needs, and the outliers beyond that width as an
exception list of positions and high bits. After the blocks come the index of their starts and a table of documents.

    "GMPFOR1\\0" block* block_start:u64[blocks] doc_id:i64[docs] doc_null:u8[docs] doc_end:u64[docs]
    footer: n_blocks:u64 n_docs:u64 n_ids:u64 index_at:u64 "GMPFOR1\\0"
    block: n:u32 minimum:u32 width:u8 n_exceptions:u32 packed:u8[ceil(n*width/8)] at:u32[] high:u32[]

Null and empty texts have the end id alone. Rows that repeat a doc_id stand in the order of their texts; a null doc_id comes
first. A text of any length is encoded whole, as a chunk of its own. An empty table gives an empty result. Columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from grainmill.llm.common import chunks, new_dir, open_fs, publish

MAGIC = b"GMPFOR1\0"
BLOCK = 8192
_HEAD, _FOOT = struct.Struct("<IIBI"), struct.Struct("<QQQQ8s")


def pack(ids: np.ndarray, percentile: float = 0.95) -> bytes:
    """One block."""
    ids = np.ascontiguousarray(ids, np.uint32)
    low = int(ids.min())
    rest = ids - np.uint32(low)
    width = max(1, int(np.partition(rest, k := int(percentile * (len(rest) - 1)))[k]).bit_length())
    at = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    high = (rest[at] >> np.uint32(width)) if len(at) else np.zeros(0, np.uint32)
    return _HEAD.pack(len(ids), low, width, len(at)) + np.packbits(bits, bitorder="little").tobytes() + at.astype("<u4").tobytes() + high.astype("<u4").tobytes()


def unpack(block: bytes) -> np.ndarray:
    n, low, width, more = _HEAD.unpack_from(block)
    size = -(-n * width // 8)
    packed = np.frombuffer(block[_HEAD.size : _HEAD.size + size] + bytes(8), np.uint8)
    bit = np.arange(n, dtype=np.int64) * width
    at_byte = np.ndarray((size + 1,), "<u8", packed, strides=(1,))  # eight bytes from each byte on
    ids = ((at_byte[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)
    at = np.frombuffer(block, "<u4", more, _HEAD.size + size)
    ids[at] |= np.frombuffer(block, "<u4", more, _HEAD.size + size + 4 * more) << np.uint32(width)
    return ids + np.uint32(low)


class Writer:
    """Writes blocks as ids come, so memory holds a block and 17 bytes a document."""

    def __init__(self, out, percentile: float = 0.95):
        self.out, self.percentile, self.at, self.n_ids = out, percentile, len(MAGIC), 0
        self.starts: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append documents: their ids one after another, and how many each has."""
        self.docs += zip(doc_ids, (self.n_ids + np.cumsum(sizes)).tolist(), strict=True)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if all_ else len(ids) // BLOCK * BLOCK
        for k in range(0, stop, BLOCK):
            block = pack(ids[k : min(k + BLOCK, stop)], self.percentile)
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        keys = np.array([d or 0 for d, _ in self.docs], "<i8")
        null = np.array([d is None for d, _ in self.docs], np.uint8)
        ends = np.array([e for _, e in self.docs], "<u8")
        for part in (np.array(self.starts, "<u8"), keys, null, ends):
            self.out.write(part.tobytes())
        self.out.write(_FOOT.pack(len(self.starts), len(self.docs), self.n_ids, self.at, MAGIC))


class Reader:
    """Random access to the documents of one file: only the blocks that a range covers are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_blocks, n_docs, self.n_ids, at, magic = _FOOT.unpack(self._range(size - _FOOT.size, _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = self._range(at, size - _FOOT.size - at)
        self.starts = np.append(np.frombuffer(index, "<u8", n_blocks), np.uint64(at)).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks)
        self.null = np.frombuffer(index, np.uint8, n_docs, 8 * (n_blocks + n_docs)).astype(bool)
        self.ends = np.frombuffer(index, "<u8", n_docs, 8 * (n_blocks + n_docs) + n_docs).astype(np.int64)

    def _range(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from position start up to stop."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        base = int(self.starts[first])
        raw = self._range(base, int(self.starts[last + 1]) - base)
        cuts = self.starts[first : last + 2] - base
        got = np.concatenate([unpack(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return got[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, position, ids) of each document in order, about `step` ids read at once."""
        starts = np.append(0, self.ends[:-1])
        k = 0
        while k < len(self.ends):
            stop = max(k + 1, int(np.searchsorted(self.ends, starts[k] + step, "right")))
            base = int(starts[k])
            ids = self.ids(base, int(self.ends[stop - 1]))
            for j in range(k, stop):
                yield None if self.null[j] else int(self.doc_ids[j]), int(starts[j]), ids[starts[j] - base : self.ends[j] - base]
            k = stop


def write_token_files(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]], *, end_id: int | None = 0, percentile: float = 0.95) -> tuple[str, list[tuple[int, int, int]]]:
    """Encode every whole text and write it; returns the folder and (part, documents, ids) of each file.

    encoder is called once in each Python worker. Null text counts as empty; a null doc_id sorts first; rows that
    share a doc_id stand in the order of their texts. The range exchange deals distinct doc_ids evenly.
    """
    folder = new_dir(docs.sparkSession, "tokens")
    fs, path = open_fs(folder)
    fs.create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = open_fs(folder)
        part = task.partitionId()
        temporary, final = f"{path}/.part-{part:06d}.{task.taskAttemptId()}", f"{path}/part-{part:06d}.pfor"
        encode = encoder()
        with fs.open_output_stream(temporary) as out:
            writer = Writer(out, percentile)
            for batch in chunks(batches):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                ids, sizes = encode(texts)
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                writer.add(batch.column("doc_id").to_pylist(), ids, sizes)
            writer.close()
        publish(fs, temporary, final)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(write, "part int, n_docs long, n_ids long").collect()  # a row per file
    return folder, sorted((r.part, r.n_docs, r.n_ids) for r in files)


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    files = [f for f in files if f[1]]
    base = np.append(0, np.cumsum([f[2] for f in files])).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_file(f"{path}/part-{files[k][0]:06d}.pfor") as source:
                    for doc_id, at, ids in Reader(source).documents():
                        rows.append((doc_id, base[k] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], list(names))


class WordCache:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    The pre-tokenizer splits a text into words that the merges never cross, so equal words have equal ids. Texts of
    printable Latin-1 are split here and each distinct word is encoded once; any other text, and one that holds a special
    token's string, goes to the library whole, so its ids are the library's own.
    """

    SAFE = bytes([10, *range(32, 127), *range(0xC0, 0x100)])
    WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \nA-Za-zÀ-ÖØ-öø-ÿ0-9]+|[ \n]+(?![^ \n])|[ \n]+"""

    def __init__(self, path: str, most: int = 1_500_000):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split, self.most = re.compile(self.WORD).findall, most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: byte-level pieces have a character a byte
        for piece, at in vocabulary.items():
            self.sizes[at] = len(piece)
        self._clear()

    def _clear(self) -> None:
        self.words, self.n = _Numbers(), 0
        self.flat, self.first, self.length = (np.zeros(0, kind) for kind in (np.uint32, np.int64, np.int64))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, text: str) -> list[str] | None:
        if any(x in text for x in self.special):
            return None
        try:
            odd = text.encode("latin-1").translate(None, self.SAFE)
        except UnicodeEncodeError:
            return None
        return None if odd else self.split(text)

    def _joined(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of words of a space and letters, encoded as texts that split into just these words; and how many each word has."""
        ids, lengths = self.whole(["".join(words[k : k + 200]) for k in range(0, len(words), 200)]), []
        for k, own in enumerate(ids):
            ends = np.cumsum([len(w.encode()) for w in words[200 * k : 200 * k + 200]])
            lengths.append(np.diff(np.searchsorted(np.cumsum(self.sizes[own]), ends) + 1, prepend=0))
        return ids, np.concatenate(lengths) if lengths else np.zeros(0, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        plain = np.array([w[0] == " " and w[1:].isalpha() for w in fresh], bool)
        ids, lengths = self._joined([w for w, p in zip(fresh, plain, strict=True) if p])
        other = self.whole([w for w, p in zip(fresh, plain, strict=True) if not p])
        length, first = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        length[plain], length[~plain] = lengths, [len(x) for x in other]
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        first[order] = self.n + np.cumsum(length[order]) - length[order]
        new = np.concatenate([*ids, *other])
        if self.n + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.n], new, np.zeros(self.n + len(new), np.uint32)))
        else:
            self.flat[self.n : self.n + len(new)] = new
        self.n += len(new)
        self.first, self.length = np.concatenate((self.first, first)), np.concatenate((self.length, length))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if len(self.words) > self.most:
            self._clear()
        number, split = self.words.__getitem__, map(self._words, texts)  # a text's words are looked up while they are in the CPU's cache
        found = [None if ws is None else np.fromiter(map(number, ws), np.int64, len(ws)) for ws in split]
        counts = np.array([0 if k is None else len(k) for k in found], np.int64)
        at = np.concatenate([k for k in found if k is not None] or [np.zeros(0, np.int64)])
        if fresh := self.words.taken():
            self._learn(fresh)
        length = self.length[at]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.first[at] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        sizes = np.diff(np.append(0, ends)[np.cumsum(counts)], prepend=0)
        odd = [k for k, words in enumerate(found) if words is None]
        if not odd:
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k, own in zip(odd, self.whole([texts[k] for k in odd]), strict=True):
            parts[k], sizes[k] = own, len(own)
        return np.concatenate(parts), sizes


class _Numbers(dict):
    """Words by the number that they get when first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


_encoders: dict[str, WordCache] = {}


def byte_bpe(path: str) -> Callable[[], WordCache]:
    """An encoder for write_token_files; each Python worker loads the vocabulary once."""

    def load() -> WordCache:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _encoders:
            _encoders[path] = WordCache(path)
        return _encoders[path]

    return load


def token_ids(docs: DataFrame, tokenizer: str, *, end_id: int = 0, percentile: float = 0.95) -> DataFrame:
    """Write the ids of every whole text and read them back. An empty table gives an empty result."""
    return read_token_files(docs.sparkSession, *write_token_files(docs, byte_bpe(tokenizer), end_id=end_id, percentile=percentile))
