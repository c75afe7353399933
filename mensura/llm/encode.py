"""Encoding of a corpus with a public byte-level tokenizer, in array operations.

Pre-tokens are found without a regular expression: code points become symbols of a small automaton, the automaton's
transition functions are combined by an associative scan, and the states tell where pre-tokens begin. Each pre-token
is merged once and kept.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.codepoints import SPACE, Chunk, chunks, classes, prefix_hash, slice_hash
from mensura.sources.tables import spread

# Symbols. LAST_BLANK is a blank, LAST_WHITE any other white space, before something that isn't white space.
_L, _N, _O, _ONE, _TWO, _W, _LAST_WHITE, _LAST_BLANK = range(8)
# States after a symbol.
_IN_L, _IN_N, _IN_O, _IN_W, _PREFIX, _NEED1, _NEED2, _DONE = range(8)
_SYMBOLS, _STATES, _BLOCK = 16, 8, 128
#: Endings that are pre-tokens of their own after an apostrophe.
_ENDINGS_1, _ENDINGS_2 = "stmd", ("re", "ve", "ll")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and if a pre-token begins at the symbol. Symbols from 8 on begin a text."""
    if symbol >= 8:
        return _step(_DONE, symbol - 8)
    if symbol == _L and state in (_NEED1, _NEED2):
        return (_DONE, False) if state == _NEED1 else (_NEED1, False)
    run = {_L: _IN_L, _N: _IN_N, _O: _IN_O, _ONE: _IN_O, _TWO: _IN_O, _W: _IN_W}.get(symbol)
    if run is not None and (state == run or (state == _PREFIX and symbol != _W)):
        return run, False
    if symbol in (_ONE, _TWO):
        return (_NEED1 if symbol == _ONE else _NEED2), True
    return {_LAST_WHITE: _DONE, _LAST_BLANK: _PREFIX}.get(symbol, run), True


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """begins[state, symbol]; product[f, g] (first f, then g); result[f, state]; function of each symbol.

    The functions are all those that products of the symbols' transition functions give.
    """
    steps = [[_step(s, x) for s in range(_STATES)] for x in range(_SYMBOLS)]
    begins = np.array([[steps[x][s][1] for x in range(_SYMBOLS)] for s in range(_STATES)])
    known: dict[tuple[int, ...], int] = {tuple(range(_STATES)): 0}
    basic = [known.setdefault(tuple(t for t, _ in steps[x]), len(known)) for x in range(_SYMBOLS)]
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[t] for t in f), tuple(f[t] for t in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    functions = list(known)
    product = np.array([[known[tuple(g[t] for t in f)] for g in functions] for f in functions])
    kind = np.uint8 if len(functions) < 256 else np.uint16
    return begins.astype(bool), product.astype(kind), np.array(functions, np.uint8), np.array(basic, kind)


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """State before each symbol: an associative scan of transition functions, in blocks and then over the blocks."""
    _, product, result, basic = _automaton()
    n = len(symbols)
    blocks = -(-n // _BLOCK)
    functions = np.zeros(blocks * _BLOCK, basic.dtype)
    functions[:n] = basic[symbols]
    columns = np.ascontiguousarray(functions.reshape(blocks, _BLOCK).T)
    width, flat = product.shape[1], product.ravel()
    for j in range(1, _BLOCK):  # inclusive products within each block, all blocks at once
        columns[j] = flat[columns[j - 1].astype(np.int32) * width + columns[j]]
    total, step = columns[-1].copy(), 1
    while step < blocks:  # inclusive products over the blocks
        total[step:] = flat[total[:-step].astype(np.int32) * width + total[step:]]
        step *= 2
    entry = np.full(blocks, _DONE, np.uint8)
    entry[1:] = result[total[:-1], _DONE]
    before = np.empty((_BLOCK, blocks), np.uint8)
    before[0] = entry
    before[1:] = result.ravel()[columns[:-1].astype(np.int32) * _STATES + entry]
    return np.ascontiguousarray(before.T).ravel()[:n]


def pretoken_starts(chunk: Chunk) -> np.ndarray:
    """Positions in chunk.points at which pre-tokens begin."""
    points, n = chunk.points, len(chunk.points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = classes()[points]
    filled = chunk.end > chunk.start
    first, last = chunk.start[filled], chunk.end[filled] - 1
    white = kinds == SPACE
    ahead = np.empty(n, bool)  # something that isn't white space follows in the same text
    ahead[:-1] = ~white[1:]
    ahead[-1] = False
    ahead[last] = False
    symbols = np.array([_L, _N, _W, _O], np.uint8)[kinds]
    before = np.flatnonzero(white & ahead)
    symbols[before] = np.where(points[before] == 32, _LAST_BLANK, _LAST_WHITE)
    marks = np.flatnonzero(points == 39)
    if len(marks):
        ends = chunk.end[np.searchsorted(chunk.end, marks, "right")]
        padded = np.concatenate((points[np.minimum(marks + 1, n - 1)], points[np.minimum(marks + 2, n - 1)])).reshape(2, -1)
        one = np.isin(padded[0], [ord(c) for c in _ENDINGS_1]) & (marks + 1 < ends)
        two = np.zeros(len(marks), bool)
        for a, b in _ENDINGS_2:
            two |= (padded[0] == ord(a)) & (padded[1] == ord(b))
        two &= marks + 2 < ends
        symbols[marks[one]] = _ONE
        symbols[marks[two]] = _TWO
    symbols[first] += 8
    begins = _automaton()[0]
    return np.flatnonzero(begins.ravel()[_states_before(symbols).astype(np.int16) * _SYMBOLS + symbols])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks, which are ids as well, of a vocabulary file with a base-64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
    if len(piece) < 48:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            low, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if low == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    n = len(piece)
    after, ahead, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        live[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            ahead[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (k := ahead[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes chunks of texts; keeps the ids of every pre-token it has merged.

    Kept pre-tokens are found by their 64-bit hash, first in a direct table, then in a dictionary, and then compared with
    the text's slice character by character; those that only share a hash are kept by their text. When more than `most`
    pre-tokens are kept, they are dropped and merged anew when they come again.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        self.ranks, self.most = read_ranks(path), most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int64)
        self.known: dict[int, int] = {}
        self.clashes: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 20, np.int32), 0
        self.points, self.kept = np.empty(1 << 20, np.uint32), 0
        self.count, self.at, self.size, self.from_, self.length = 0, *(np.empty(1 << 16, np.int64) for _ in range(4))

    def _add(self, piece: str) -> int:
        ids, points, k = merge(piece.encode(), self.ranks), np.frombuffer(piece.encode("utf-32-le"), np.uint32), self.count
        if k == len(self.at):
            self.at, self.size, self.from_, self.length = (np.concatenate((x, x)) for x in (self.at, self.size, self.from_, self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, self.ids))
        while self.kept + len(points) > len(self.points):
            self.points = np.concatenate((self.points, self.points))
        self.ids[self.used : self.used + len(ids)] = ids
        self.points[self.kept : self.kept + len(points)] = points
        self.at[k], self.size[k], self.from_[k], self.length[k] = self.used, len(ids), self.kept, len(points)
        self.used, self.kept, self.count = self.used + len(ids), self.kept + len(points), k + 1
        return k

    def _lookup(self, chunk: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.count > self.most:
            self._clear()
        hashes = self._hash(chunk, start, end)
        slot = (hashes >> np.uint64(46)).astype(np.int64)
        found = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != hashes)
        if len(missed):
            unique, where, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            text = chunk.points.tobytes().decode("utf-32-le") if len(unique) else ""
            got = np.empty(len(unique), np.int64)
            for i, (key, w) in enumerate(zip(unique.tolist(), missed[where].tolist())):
                k = self.known.get(key)
                if k is None:
                    k = self.known[key] = self._add(text[start[w] : end[w]])
                got[i] = k
            found[missed] = got[back]
            fresh = (unique >> np.uint64(46)).astype(np.int64)
            self.keys[fresh], self.values[fresh] = unique, got
        for w in self._unlike(chunk, start, end, found).tolist():
            piece = chunk.points[start[w] : end[w]].tobytes().decode("utf-32-le")
            if piece not in self.clashes:
                self.clashes[piece] = self._add(piece)
            found[w] = self.clashes[piece]
        return found

    @staticmethod
    def _hash(chunk: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return slice_hash(prefix_hash(chunk.points), start, end)

    def _unlike(self, chunk: Chunk, start: np.ndarray, end: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Numbers of the slices (on end from the first to the last) that aren't the kept pre-token found for them."""
        length = end - start
        other = self.length[found] != length
        kept = self.points.take(np.arange(start[0], end[-1]) + np.repeat(self.from_[found] - start, length), mode="clip")
        unlike = np.flatnonzero(kept != chunk.points[start[0] : end[-1]]) + start[0]
        other[np.searchsorted(start, unlike, "right") - 1] = True
        return np.flatnonzero(other)

    def __call__(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids on end; number of ids of each piece; and of each pre-token its start in the chunk and its number of ids."""
        start = pretoken_starts(chunk)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(chunk.start), np.int64), start, start
        end = np.append(start[1:], len(chunk.points))
        found = self._lookup(chunk, start, end)
        size = self.size[found]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.at[found] - upto[:-1], size) + np.arange(upto[-1])]
        edges = upto[np.searchsorted(start, np.append(chunk.start, chunk.end[-1]))]
        return ids, np.diff(edges), start, size


def encode_arrow(texts: pa.Array, encoder: Encoder, offsets: bool = False) -> list[pa.Array]:
    """Ids of each text as a list array; with offsets also, by id, the character at which its pre-token begins."""
    ids, starts, counts = [], [], np.zeros(len(texts), np.int64)
    row, base = -1, 0
    for chunk in chunks(texts):
        got, n, start, size = encoder(chunk)
        ids.append(got)
        np.add.at(counts, chunk.row, n)
        if offsets:
            continued = len(chunk.row) == 1 and chunk.row[0] == row
            base = base if continued else 0
            starts.append(np.repeat(start - chunk.start[np.searchsorted(chunk.start, start, "right") - 1] + base, size).astype(np.int32))
            row, base = int(chunk.row[-1]), base + len(chunk.points)
    edges = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))
    return [pa.ListArray.from_arrays(edges, join(x)) for x in ([ids, starts] if offsets else [ids])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's encoder of a vocabulary file; it keeps its pre-tokens from one batch to the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, key: str, text: str, path: str, ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """(key, ids): token ids of each row's text, without special tokens, by the vocabulary file at path.

    Null and empty texts have an empty list. Whole texts are encoded, however long; rows are neither dropped nor put
    together (repeated rows and null keys stay), extra columns are left out. With offsets, a column of that name
    has, for each id, the character of the text at which its pre-token begins, so that any slice of ids can be led
    back to its text. The file must be at path on every executor. Narrow: a table that is one split is spread
    first, otherwise nothing is shuffled.
    """
    rows = spread(df.select(F.col(key).alias(key), F.col(text).alias("_text")))
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{ids}` array<int>" + (f", `{offsets}` array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *encode_arrow(batch.column(1), encoder(path), offsets is not None)], names=[key, ids, *([offsets] if offsets else [])])

    return rows.mapInArrow(run, schema)


def count_tokens(df: DataFrame, columns: list[str], text: str, path: str, name: str = "tokens") -> DataFrame:
    """columns and the number of token ids of each row's text (null and empty texts: 0)."""
    rows = spread(df.select(*columns, F.col(text).alias("_text")))
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns], f"`{name}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                np.add.at(counts, chunk.row, encoder(path)(chunk)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*columns, name])

    return rows.mapInArrow(run, schema)


def decode(ids: list[int], path: str) -> str:
    """The text of ids (a round trip's way back)."""
    return b"".join(_tokens(path)[i] for i in ids).decode("utf-8", "replace")


@functools.cache
def _tokens(path: str) -> dict[int, bytes]:
    return {v: k for k, v in read_ranks(path).items()}
