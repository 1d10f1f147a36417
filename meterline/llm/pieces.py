"""A SentencePiece vocabulary file read as a unigram model: pieces with scores, byte pieces and the white-space marker.

Only the fields that encoding needs are read from the file's protocol buffer. A segmentation's score is the sum of its pieces'
scores. A character that no piece of its own covers may be an unknown, whose score is the lowest score less 10; it is
written as its UTF-8 bytes where the vocabulary has byte pieces. Of equal scores the one whose last piece starts first wins, at
every position (that is the published rule of the tokenizer's lattice search).

White space: every space becomes the marker, and a text gets one more in front. As no piece goes on past a marker that
follows something else, a text falls into chunks (markers and what follows up to the next marker) that are segmented alone,
with exact sums in double precision. A marker character in the text itself is written as bytes, so that decoding restores every text.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: fixed values: piece types of the file format
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
DEFAULT = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 200_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of a message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


class Vocabulary:
    def __init__(self, content: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        for number, value in _fields(content):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(piece.get(2, 0.0)))
                self.kinds.append(piece.get(3, NORMAL))
        self.byte_ids = [-1] * 256
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else -1
        self.matchable = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.matchable):
            raise ValueError("a piece goes on past a white-space marker; texts can't be cut there")
        self.unknown_score = min((self.scores[i] for i in self.matchable.values()), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.matchable), default=1)
        self.has_bytes = min(self.byte_ids) >= 0
        used = set("".join(self.matchable))
        alone = "".join(sorted(re.escape(c) for c in {chr(i) for i in range(128)} - used - {" "}))
        # an ASCII character that occurs in no piece is a chunk of its own
        self.chunk = re.compile(f" +[^ {alone}]*|[{alone}]|[^ {alone}]+" if alone else " +[^ ]*|[^ ]+")

    def spell(self, unknown: str) -> list[int]:
        return [self.byte_ids[b] for b in unknown.encode()] if self.has_bytes else [self.unknown]


@lru_cache(maxsize=2)
def vocabulary(path: str = DEFAULT) -> Vocabulary:
    with open(path, "rb") as file:
        return Vocabulary(file.read())


class Memo(dict):
    """Results by chunk, computed on demand. Holds two generations of bounded size; a full one becomes the old one, and
    what is asked for again moves to the new, so that common chunks stay."""

    def __init__(self, compute, most: int = CACHE):
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            value = self.compute(chunk)
            if len(chunk) > 64:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value
