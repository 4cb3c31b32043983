"""Pre-tokens of the byte-level BPE pattern, found for many texts at once with numpy.

The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
Its matches tile the text, so the starts of the pre-tokens say everything. Each
distinct pre-token is encoded once per chunk; Arrow's dictionary finds the distinct ones.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: The endings that the pattern takes after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points of Unicode's White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
#: Distinct pre-tokens in one generation of those that a worker remembers.
REMEMBERED = 250_000


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[list(WHITE_SPACE)] = SPACE
    return table


def byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary spells each byte: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as a mask over code points; `first` marks where texts start."""
    n = len(points)
    kind = classes()[points]
    out = np.empty(n, bool)
    if not n:
        return out
    out[0] = True
    np.not_equal(kind[1:], kind[:-1], out=out[1:])
    out |= first
    space = kind == SPACE
    # the last white space before other text stands alone, or leads it if it is U+0020
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    out[last] = True
    out[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & out)
    if len(quote):
        after = np.concatenate([points, np.zeros(3, points.dtype)])
        cut = np.concatenate([first, np.ones(3, bool)])
        for ending in CONTRACTIONS:
            k = len(ending)
            hit = np.ones(len(quote), bool)
            for i, c in enumerate(ending, 1):
                hit &= (after[quote + i] == ord(c)) & ~cut[quote + i]
            at = quote[hit]
            out[at + 1] = False
            end = at + k + 1
            out[end[end < n]] = True
    return out


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i] + count[i] - 1 for all i, in one array."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(begin - (ends - count), count)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each starts, with the end; a null is an empty text."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, special: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pre-tokens' starts, with the end, and for each text its first pre-token, with the end."""
    edges = offsets
    raw = data.tobytes()
    if special and special in raw:
        more, at = [], raw.find(special)
        while at >= 0:
            text_end = offsets[np.searchsorted(offsets, at, side="right")]
            if at + len(special) <= text_end:
                more += [at, at + len(special)]
                at = raw.find(special, at + len(special))
            else:
                at = raw.find(special, at + 1)
        edges = np.unique(np.concatenate([offsets, np.array(more, np.int64)]))
        inside = np.array(more[::2], np.int64)
    else:
        inside = np.zeros(0, np.int64)
    edges = edges[edges < len(data)]
    if len(data) and data.max() < 128:
        points, place = data, None
    else:
        lead = (data & 0xC0) != 0x80
        place = np.flatnonzero(lead)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    first[edges if place is None else np.searchsorted(place, edges)] = True
    begin = np.flatnonzero(starts(points, first))
    if place is not None:
        begin = place[begin]
    if len(inside):  # a special token is one pre-token
        within = np.searchsorted(inside, begin, side="right") - 1
        keep = (within < 0) | (begin == inside[within]) | (begin >= inside[within] + len(special))
        begin = begin[keep]
    return np.append(begin, len(data)), np.searchsorted(begin, offsets)


class WordEncoder:
    """Encodes texts by their distinct pre-tokens; `encode` gives the ids of each of a list of pre-tokens.

    Pre-tokens are remembered in two generations: when the younger one is full, it
    becomes the older, and what is met again moves back. So frequent ones stay.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], special: bytes | None = None, remembered: int = REMEMBERED) -> None:
        self.encode, self.special, self.remembered = encode, special, remembered
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def lookup(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each of some different pre-tokens, as little-endian 32-bit integers."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, distinct))
        late = [i for i, ids in enumerate(out) if ids is None]
        if not late:
            return out
        words = [distinct[i] for i in late]
        found = list(map(self.old.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        made = iter([array("I", ids).tobytes() for ids in self.encode(new)] if new else [])
        found = [ids or next(made) for ids in found]
        for i, ids in zip(late, found, strict=True):
            out[i] = ids
        self.young.update(zip(words, found, strict=True))
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids start, with the end."""
        data, offsets = text_bytes(column)
        begin, of_text = words(data, offsets, self.special)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        known = self.lookup(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.cumsum(size) - size
        word = np.asarray(parts.indices) if known else np.zeros(0, np.int64)
        count = size[word]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids[ragged(at[word], count)], total[of_text]
