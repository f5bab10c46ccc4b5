"""SentencePiece encoding over a shared-prefix trie, and decoding.

Normalised text falls into marked words (marks and what follows them) that no piece crosses, so each distinct word is
encoded once. New words are sorted, which is a depth-first walk of their trie: the forward states of the prefix that a
word shares with the one before it are kept and only its own characters are computed.

For a unigram model the state of a prefix is the best score and its last piece (Viterbi). For a BPE model, sums of
scores don't give the merges' result, so the state is the last piece of the prefix's own encoding: it is the one piece
for which the pair with the state it extends encodes to itself, since every stretch of a BPE encoding is the encoding
of its text. Characters without a piece become byte pieces, or the unknown id where a model has none.

Null text counts as empty and has no pieces. A text that itself contains the mark (U+2581) decodes to a space there,
so round_trip is false for it. Very long words are linear in their length. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grainmill.llm.common import chunks

MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM = 1


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at : at + size]
            at += size


class PieceModel:
    """The pieces of a model file and the two directions."""

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float, int]] | None = None, unigram: bool = False, most: int = 1_000_000):
        self.processor = None
        if path is not None:
            import sentencepiece

            self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
            with open(path, "rb") as f:
                pieces, unigram = self._parse(f.read())
        self.pieces, self.unigram, self.most = pieces, unigram, most
        usable = (NORMAL, USER)
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in usable}
        self.scores = {p: s for p, s, kind in pieces if kind in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.split = re.compile(r".+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+", re.S).findall
        self.pairs: dict[tuple[str, str], bool] = {}
        tails: dict[str, set[int]] = {}  # by the last three characters: lengths of the pieces that end so, longest first
        for p in self.ids:
            if len(p) > 2:
                tails.setdefault(p[-3:], set()).add(len(p))
        self.tails = {k: (*sorted(v, reverse=True), 2, 1) for k, v in tails.items()}
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() if kind in usable else b"" for p, _, kind in pieces]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.word_ids, self.word_first, self.word_size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _parse(raw: bytes) -> tuple[list[tuple[str, float, int]], bool]:
        pieces, unigram = [], True
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                unigram = dict(_fields(value)).get(3, UNIGRAM) == UNIGRAM
        return pieces, unigram

    def normalize(self, texts: list[str]) -> list[str]:
        if self.processor is not None:
            return [self.processor.normalize(t) if t else "" for t in texts]
        return [MARK + t.replace(" ", MARK) if t else "" for t in texts]

    def merged(self, text: str) -> list[str]:
        """The BPE encoding of a short text, merge by merge: the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _joins(self, before: str, piece: str) -> bool:
        key = before, piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each distinct word, in the order of the trie."""
        last: list[str] = [""]
        score = [0.0]
        previous, ids, scores, tails, pairs = "", self.ids, self.scores, self.tails, self.pairs
        for word in sorted(words):
            shared, stop = 0, min(len(previous), len(word))
            while shared < stop and previous[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if self.unigram:
                    best, piece = score[end - 1] + self.unknown_score, word[end - 1]
                    for start in range(max(0, end - self.longest), end):
                        s = scores.get(word[start:end])
                        if s is not None and score[start] + s > best:
                            best, piece = score[start] + s, word[start:end]
                    score.append(best)
                else:
                    for n in tails.get(word[max(0, end - 3) : end], (2, 1)):
                        if n <= end and ((piece := word[end - n : end]) in ids or n == 1):
                            joins = pairs.get((last[end - n], piece))
                            if joins or joins is None and self._joins(last[end - n], piece):
                                break
                    score.append(0.0)
                last.append(piece)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            out.reverse()
            previous = word
            yield word, out

    def _number(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if len(self.known) > self.most:
            self._clear()
        known, fresh = self.known, []

        def number(word: str) -> int:
            found = known.get(word)
            if found is None:
                found = known[word] = len(known)
                fresh.append(word)
            return found

        at = []
        for text in self.normalize(texts):
            words = self.split(text)
            try:
                at.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            except KeyError:
                at.append(np.fromiter(map(number, words), np.int64, len(words)))
        if fresh:
            base, found = len(known) - len(fresh), {}
            for word, pieces in self.walk(fresh):
                found[word] = [i for p in pieces for i in self._number(p)]
            new = [found[w] for w in fresh]
            assert len(self.word_size) == base
            size = np.array([len(x) for x in new], np.int64)
            first = len(self.word_ids) + np.cumsum(size) - size
            self.word_ids = np.concatenate((self.word_ids, np.fromiter((i for x in new for i in x), np.int32, int(size.sum()))))
            self.word_first, self.word_size = np.concatenate((self.word_first, first)), np.concatenate((self.word_size, size))
        counts = np.array([len(x) for x in at], np.int64)
        words = np.concatenate(at or [np.zeros(0, np.int64)])
        size = self.word_size[words]
        ends = np.cumsum(size)
        ids = self.word_ids[_spread(self.word_first[words], size, ends)]
        return ids, np.diff(np.append(0, ends)[np.cumsum(counts)], prepend=0)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each list of ids: pieces side by side, marks as spaces, less the space that encoding puts in front."""
        size = self.size[ids]
        ends = np.cumsum(size)
        raw = self.flat[_spread(self.first[ids], size, ends)].tobytes()
        cuts = np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist()
        texts = (raw[a:b].decode("utf-8", "replace").replace(MARK, " ") for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        return [t.removeprefix(" ") for t in texts]


def _spread(first: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indices of ranges one after another."""
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), n_chars and round_trip of what decoding the ids gives, and piece_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, sizes = own.encode(texts)
            back = own.decode(ids, sizes)
            ends = np.append(0, np.cumsum(sizes))
            raw = memoryview(ids.astype("<u4").tobytes())
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_pieces": pa.array(sizes, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()),
                "n_chars": pa.array([len(t) for t in back], pa.int64()),
                "round_trip": pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            }
            if with_ids:
                columns["piece_ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_pieces long, ids_crc32 long, n_chars long, round_trip boolean" + ", piece_ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows that hold piece_ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            lists = [x or [] for x in batch.column("piece_ids").to_pylist()]
            texts = own.decode(np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, "doc_id long, text string")
