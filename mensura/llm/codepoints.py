"""Batches of texts as one array of code points, with class tables and slice hashes; shared by the text operators."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Code points that are taken at once; bounds the arrays' memory, not the texts.
CHUNK = 1_000_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Odd multiplier of the slice hash, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Unicode's White_Space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    kinds = np.fromiter((" LN".find(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.int8, 0x110000)
    out = np.full(0x110000, OTHER, np.uint8)
    out[kinds == 1], out[kinds == 2] = LETTER, NUMBER
    out[list(WHITE)] = SPACE
    return out


@functools.cache
def weights() -> np.ndarray:
    """A fixed pseudo-random 64-bit weight for each code point (splitmix of its number)."""
    with np.errstate(over="ignore"):
        x = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64 for i up to n."""
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for out, factor in ((up, BASE), (down, pow(BASE, -1, 1 << 64))):
            out[0], have = 1, 1
            while have <= n:
                step = np.uint64(pow(factor, have, 1 << 64))
                more = min(have, n + 1 - have)
                out[have : have + more] = out[:more] * step
                have += more
    return up, down


def prefix_hash(points: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash slices: see slice_hash."""
    size = 1 << max(20, int(len(points)).bit_length())
    up, _ = _powers(size)
    out = np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(weights()[points] * up[: len(points)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice, the same wherever the slice stands."""
    _, down = _powers(1 << max(20, int(len(prefix) - 1).bit_length()))
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * down[start]


def text_hash(text: str) -> int:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return int(slice_hash(prefix_hash(points), np.array([0]), np.array([len(points)]))[0])


class Chunk:
    """Some texts on end: points (code points), start and end of each piece in points, row of each piece.

    A piece is a whole text, or, of a text longer than CHUNK, a part that begins with white space after something
    else, where no word and no pre-token can go across.
    """

    __slots__ = ("end", "points", "row", "start")

    def __init__(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> None:
        self.points, self.start, self.end, self.row = points, start, end, row


def _points(data: memoryview) -> np.ndarray:
    return np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)


def _cuts(points: np.ndarray) -> list[int]:
    """Where a very long text is cut into pieces: at white space after something else, about every CHUNK."""
    white = classes()[points] == SPACE
    at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    cuts, last = [0], 0
    while len(points) - last > CHUNK:
        k = np.searchsorted(at, last + CHUNK, "right") - 1
        nxt = int(at[k]) if k >= 0 and at[k] > last else (int(at[k + 1]) if k + 1 < len(at) else len(points))
        if nxt >= len(points):
            break
        cuts.append(nxt)
        last = nxt
    return [*cuts, len(points)]


def chunks(texts: pa.Array, whole: bool = False) -> Iterator[Chunk]:
    """The texts of an Arrow string array, null as empty, in chunks of about CHUNK code points.

    With whole, a text is never cut into pieces.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2]) if texts.buffers()[2] is not None else memoryview(b"")
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        raw = data[offsets[first] : offsets[last]]
        points = _points(raw)
        octets = np.frombuffer(raw, np.uint8)
        if len(points) == len(octets):
            edges = offsets[first : last + 1] - offsets[first]
        else:
            lead = np.concatenate(([0], np.cumsum((octets & 0xC0) != 0x80)))
            edges = lead[offsets[first : last + 1] - offsets[first]]
        rows = np.arange(first, last)
        if last == first + 1 and len(points) > 2 * CHUNK and not whole:
            cuts = _cuts(points)
            for a, b in zip(cuts, cuts[1:]):
                yield Chunk(points[a:b], np.array([0]), np.array([b - a]), rows)
        else:
            yield Chunk(points, edges[:-1].astype(np.int64), edges[1:].astype(np.int64), rows)
        first = last
