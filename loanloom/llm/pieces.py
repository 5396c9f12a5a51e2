"""SentencePiece encoding and decoding of merge-type models by backtracking.

An encoding is the one that greedy merging gives if and only if every two neighbours in it are what merging makes of
their own joint text.  So the encoder walks a text from left to right with the longest vocabulary matches
(Aho-Corasick), accepts a piece only beside a compatible neighbour, otherwise tries the next shorter match, and
otherwise takes the last piece back; a bit for each position remembers where no encoding goes on, so that each
position fails once.  Compatibility is found by re-merging the two pieces' text and remembered.

Texts fall apart before each run of blanks when no piece of the vocabulary has a blank after another character.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import slices

BLANK = "▁"
SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def read_model(path: str) -> bytes:
    """A tokenizer file as bytes, read once by the driver; tasks get the bytes, not a local path."""
    with open(path, "rb") as file:
        return file.read()


class _Bounded(dict):
    """A memo that starts afresh when it is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def remember(self, key, value):
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Pieces:
    """Vocabulary of a merge-type model with byte fallback, encoder and decoder."""

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(size)]
        self.ids = {library.id_to_piece(i): i for i in range(size) if not special[i]}
        self.score = {piece: library.get_score(i) for piece, i in self.ids.items()}
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = library.unk_id()
        #: What each id adds to a decoded text, and the byte value of byte pieces.
        self.raw = [b"" if library.is_control(i) else library.id_to_piece(i).replace(BLANK, " ").encode() for i in range(size)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        for i, b in self.byte_of.items():
            self.raw[i] = bytes([b])
        self.starts_blank = {i for piece, i in self.ids.items() if piece.startswith(BLANK)}
        self.splits = not any(BLANK in piece.lstrip(BLANK) for piece in self.ids)
        by_score = sorted(self.ids, key=lambda piece: -self.score[piece])
        #: Merge order; characters come before all merges.  Equal scores share a place and are re-merged in full.
        self.rank: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.tied = {p for p, q in zip(by_score, by_score[1:]) if self.score[p] == self.score[q] for p in (p, q) if len(p) > 1}
        self.matches = ahocorasick.Automaton()
        for place, piece in enumerate(by_score):
            self.rank[piece] = place
        for piece in self.ids:
            parts, last = self.merge(piece)
            if len(parts) == 1:  # others never come out of merging
                self.matches.add_word(piece, len(piece))
                if last:
                    self.parts[piece] = last
        self.matches.make_automaton()
        self.compatible: _Bounded = _Bounded(500_000)
        self.known: _Bounded = _Bounded(700_000)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Greedy merging, the best union first and the leftmost among equals; also the two parts of the last merge."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []
        last = None

        def offer(left: int, right: int) -> None:
            joined = parts[left] + parts[right]
            if joined in self.score:
                heapq.heappush(queue, (-self.score[joined], left, right, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, joined = heapq.heappop(queue)
            if parts[left] is None or parts[right] is None or after[left] != right or parts[left] + parts[right] != joined:
                continue
            last = (parts[left], parts[right])
            parts[left], parts[right] = joined, None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p is not None], last

    def stays(self, left: str, right: str) -> bool:
        """Whether merging their joint text gives these two pieces again.

        Merges are undone from the last to the first on the side merged later; before each of them, the two pieces
        that then meet must not have had a union that merging would have taken first.
        """
        if left in self.tied or right in self.tied:
            return self.merge(left + right)[0] == [left, right]
        rank, parts, limit = self.rank, self.parts, len(self.rank) + 1
        while True:
            union = rank.get(left + right)
            if union is not None and union < limit:
                return False
            of_left = rank[left] if left in parts else -1
            of_right = rank[right] if right in parts else -1
            if of_left == of_right == -1:
                return True
            if of_left > of_right:
                limit, left = of_left, parts[left][1]
            else:
                limit, right = of_right + 1, parts[right][0]

    def walk(self, text: str) -> list[str]:
        """The pieces of ``text``; characters outside the vocabulary stand for themselves."""
        size, ids, compatible = len(text), self.ids, self.compatible
        longest = [1] * size
        for end, length in self.matches.iter(text):  # of one start, the longest comes last
            longest[end + 1 - length] = length
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[str] = []
        at, width, last = 0, longest[0] if size else 0, ""
        while at < size:
            piece = text[at : at + width]
            if open_at[at + width]:
                fits = not last or compatible.get((last, piece))
                if fits is None:
                    fits = compatible.remember((last, piece), self.stays(last, piece))
                if fits:
                    out.append(piece)
                    last = piece
                    at += width
                    if at < size:
                        width = longest[at]
                    continue
            while True:  # the next shorter match, else one piece back and its next shorter match
                width -= 1
                while width > 1 and text[at : at + width] not in ids:
                    width -= 1
                if width > 0:
                    break
                open_at[at] = 0
                width = len(out.pop())
                at -= width
                last = out[-1] if out else ""
        return out

    def packed(self, key: str) -> bytes:
        """Ids of one part of ``split`` as 32-bit numbers."""
        found = self.known.get(key)
        if found is None:
            walked, ids = self.walk(BLANK + key), self.ids
            try:
                found = array("i", [ids[piece] for piece in walked]).tobytes()
            except KeyError:  # characters outside the vocabulary go byte by byte
                each = [[ids[piece]] if piece in ids else [self.byte_ids[b] for b in piece.encode()] for piece in walked]
                found = array("i", [i for some in each for i in some]).tobytes()
            if len(key) <= 64:
                self.known.remember(key, found)
        return found

    def split(self, text: str | None) -> list[str]:
        """Parts of a text that are encoded on their own, each without the blank it starts with; empty: none."""
        if not text:
            return []
        text = text.replace(BLANK, " ")
        if not self.splits:
            return [text.replace(" ", BLANK)]
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [part[1:] for part in SEGMENT.findall(BLANK + text.replace(" ", BLANK))]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.packed, self.split(text))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids.tolist())
        first = next((i for i in ids.tolist() if self.raw[i]), -1)
        return text[1:] if first in self.starts_blank else text

    def _decode_broken(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become one replacement character each."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + width].decode())
                        at += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                flush()
                out.append(self.raw[i].decode())
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """One vocabulary a worker."""
    return Pieces(model)


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """The columns of ``docs`` and ``ids`` (array<int>), the encoding of ``text`` without begin or end ids.

    Null and empty texts have no ids.  Repeated rows and other columns pass through.
    """
    columns = [c for c in docs.columns if c != "ids"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema] + ["ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for part in slices(batches):
            parts = [vocabulary.encode(text) for text in part["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *parts]))
            ids = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*columns, "ids"])

    return docs.select(columns).mapInArrow(run, schema)


def encode_report(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs`` (doc_id, text).

    Null and empty texts have no ids and the digests of the empty string.  Null ids, repeated rows and other
    columns do not matter; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for part in slices(batches):
            counts, of_ids, of_texts = [], [], []
            for text in part["text"].to_pylist():
                ids = vocabulary.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                of_texts.append(hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
