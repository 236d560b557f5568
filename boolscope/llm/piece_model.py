"""A SentencePiece BPE model read from its file: character map, normalisation with alignment, merges."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np

#: Fixed values of the model's format: numbers of fields, kinds of pieces, the white space mark, the replacement sign.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK, REPLACEMENT = "▁", b"\xef\xbf\xbd"
MARK_BYTES = MARK.encode()
#: Signs of a word up to which its merges are found by looking at all of it each time.
SHORT = 48


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """Longest-prefix replacement by a double-array trie of byte strings and a block of null-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts, self.first = [], b"", None
        if not blob:
            return
        size = int.from_bytes(blob[:4], "little")
        self.units, self.texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
        starts = bytes(b for b in range(256) if self._step(self._base(0), b) is not None)
        self.first = re.compile(b"[" + re.escape(starts) + b"]") if starts else None

    def _base(self, place: int) -> int:
        unit = self.units[place]
        return place ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        """The place of the child for a byte, if there is one; a unit's label is its low byte and its top bit."""
        place = base ^ byte
        return place if place < len(self.units) and self.units[place] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that data has at a place, and the place after it."""
        base, found = self._base(0), None
        for end in range(at, len(data)):
            place = self._step(base, data[end])
            if place is None:
                break
            base = self._base(place)
            if self.units[place] >> 8 & 1:
                found = self.units[base] & 0x7FFFFFFF, end + 1
        if not found:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


def whole(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, None) of the well-formed stretches of UTF-8, and (place, place + 1, replacement sign) of each other byte."""
    at = 0
    while at < len(data):
        try:
            data[at:].decode()
            yield at, len(data), None
            return
        except UnicodeDecodeError as e:
            if e.start:
                yield at, at + e.start, None
            yield at + e.start, at + e.start + 1, REPLACEMENT
            at += e.start + 1


class PieceModel:
    """What encoding needs of a model file. Other kinds of models than BPE, and pieces that users defined or that are
    unused, raise: their merges follow other rules."""

    def __init__(self, data: bytes):
        self.ids: dict[str, int] = {}
        self.costs: dict[str, float] = {}  # scores, negated
        self.bytes_, self.unknown = {}, 0
        trainer, spec = {}, {}
        number = 0
        for field, value in fields(data):
            if field == PIECES:
                p = dict(fields(value))
                piece, kind = p[1].decode(), p.get(3, NORMAL)
                if kind == NORMAL:
                    self.ids[piece] = number
                    self.costs[piece] = -float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0])
                elif kind == BYTE:
                    self.bytes_[int(piece[3:5], 16)] = number
                elif kind == UNKNOWN:
                    self.unknown = number
                elif kind != CONTROL:
                    raise ValueError(f"piece {piece!r} is user-defined or unused")
                number += 1
            elif field == TRAINER:
                trainer = dict(fields(value))
            elif field == NORMALIZER:
                spec = dict(fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only BPE models with white space before words are read")
        if not trainer.get(35, 0):
            self.bytes_ = {}
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        space = MARK if self.escape else " "
        # no merge joins a word to the white space after it, unless a piece holds white space after another sign, nor
        # anything to a sign that is in no piece of several signs
        met = {c for p in self.ids if len(p) > 1 for c in p} - {space}
        kept = re.escape("".join(sorted(met)))
        apart = met and not any(space in p.lstrip(space) for p in self.ids)
        self.words = re.compile(f"{space}*[{kept}]+|{space}+|(?s:.)" if apart else "(?s:.+)")
        #: Bytes that each id stands for, where it stands for itself.
        self.sizes = np.zeros(number, np.int32)
        for p, i in self.ids.items():
            self.sizes[i] = len(p.encode())

    def _parts(self, data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
        """(start, end, replacement or None) of stretches that tile the bytes: keys of the map by longest prefix, the rest."""
        for start, end, other in whole(data):
            at = done = start
            while other is None and self.map.first and (hit := self.map.first.search(data, at, end)):
                at = hit.start()
                found = self.map.longest(data, at)
                if not found:  # a key begins so, but goes on otherwise: the whole character stays
                    at += 1
                    while at < end and data[at] & 0xC0 == 0x80:
                        at += 1
                    continue
                if at > done:
                    yield done, at, None
                yield at, found[1], found[0]
                at = done = found[1]
            if end > done:
                yield done, end, other

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and the place in data of each of them and of their end."""
        texts, places, lead, leading, after_space = [], [], 0, self.squeeze, self.squeeze
        for start, end, other in self._parts(data):
            part = data[start:end] if other is None else other
            if leading:  # white space before the text, in single spaces
                spaces = end - start - len(part.lstrip(b" ")) if other is None else (end - start) * (part == b" ")
                lead, leading = lead + spaces, spaces == end - start
            if other is not None:  # white space that begins a replacement goes after white space
                part = part.lstrip(b" ") if after_space else part
                text, place = np.frombuffer(part, np.uint8), np.full(len(part), start)
            else:
                text, place = np.frombuffer(part, np.uint8), np.arange(start, end)
                if self.squeeze:  # so does each space of the text itself
                    space = text == 32
                    stay = ~space | ~np.concatenate([[after_space], space[:-1]])
                    text, place = text[stay], place[stay]
            after_space = self.squeeze and (part.endswith(b" ") if part else after_space)
            texts.append(text)
            places.append(place)
        if leading or not data:
            return b"", np.array([0])
        text, place = np.concatenate([np.zeros(0, np.uint8), *texts]), np.concatenate([np.zeros(0, np.int64), *places])
        if self.prefix:
            text, place = np.concatenate([[np.uint8(32)], text]), np.concatenate([[lead], place])
        out, mark, place = text.tobytes(), b" ", np.append(place, len(data))
        if self.escape:
            sizes = np.append(np.where(text == 32, len(MARK_BYTES), 1), 1)
            out, mark, place = out.replace(b" ", MARK_BYTES), MARK_BYTES, np.repeat(place, sizes)
        if self.squeeze:  # and at the end, where the mark's own sign counts as well
            stay = len(out)
            while out.endswith(mark, 0, stay):
                stay -= len(mark)
            out, place = out[:stay], place[: stay + 1]
        return out, place

    def merged(self, word: str) -> list[str]:
        """The word's pieces: of neighbours that make a piece, those of the best score merge first, then the leftmost."""
        if len(word) > SHORT:
            return self._merged_long(word)
        parts, get, none = list(word), self.costs.get, math.inf
        costs = [get(a + b, none) for a, b in pairwise(parts)]
        while costs and (best := min(costs)) != none:
            i = costs.index(best)
            parts[i] = both = parts[i] + parts.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = get(parts[i - 1] + both, none)
            if i < len(costs):
                costs[i] = get(both + parts[i + 1], none)
        return parts

    def _merged_long(self, word: str) -> list[str]:
        """The same by a heap of what can merge, for words without end."""
        parts: list[str | None] = list(word)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (cost := self.costs.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (cost, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def encode(self, word: str) -> tuple[list[int], list[int] | None]:
        """The ids of a normalised word, and the bytes of it that each stands for, or None where sizes tells. Of a character
        without a piece the last byte's id stands for all of it, as in the library."""
        parts = self.merged(word)
        ids = list(map(self.ids.get, parts))
        if None not in ids:
            return ids, None
        out: list[tuple[int, int]] = []
        for piece, i in zip(parts, ids):
            raw = piece.encode()
            if i is not None or not self.bytes_:
                out.append((self.unknown if i is None else i, len(raw)))
            else:
                out += [*((self.bytes_[b], 0) for b in raw[:-1]), (self.bytes_[raw[-1]], len(raw))]
        return [i for i, _ in out], [n for _, n in out]
