"""Text quality statistics per document, and a hidden Markov model that labels lines as prose, list, table or junk."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.codepoints import LETTER, NUMBER, OTHER, SPACE, Chunk, chunks, classes, prefix_hash, slice_hash, text_hash
from mensura.session import cut
from mensura.sources.tables import spread

STATES = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: Texts without line breaks hold whole paragraphs and tables in one line: a line longer than this counts as several, cut at
#: blanks, each of them a step of the model; none is cut off.
PART = 120
#: Documents on which the lines that aren't clear are labelled to refit the model: those of lowest key hash. All counts
#: of pairs and clear lines, and everything else, run over all documents.
FIT_DOCUMENTS = 3000
#: Word classes of the pair scores: every frequent word is one, all other words are spread over so many by hash.
BUCKETS = 256
#: Parts to either side over which a part's pair score is also averaged.
AROUND = 3
#: Rounds of labelling and refitting.
ROUNDS = 4
#: Lines of a text from which on its labels are found in blocks of so many.
BLOCK = 512
BREAKS = (10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)
ENDS = ".!?…。！？"
SEPARATORS = "\t|;,"


@functools.cache
def _lower() -> np.ndarray:
    """Lower-case letter of each code point below U+3000 (others are as they are), accents kept."""
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        s = chr(c).lower()
        if len(s) == 1:
            low[c] = ord(s)
    return low


@functools.cache
def _word_class() -> np.ndarray:
    """Class of each code point, with combining marks as letters and line breaks as white space."""
    out = classes().copy()
    out[0x300:0x370] = LETTER
    out[[*BREAKS]] = SPACE
    return out


@functools.cache
def _among(chars: str) -> np.ndarray:
    """Whether each code point is one of the characters."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    return out


def _member(points: np.ndarray, chars: str) -> np.ndarray:
    return _among(chars)[points]


@dataclass(frozen=True)
class Words:
    """Frequent words by hash: number of each word from 1 on, in the order of the hashes; 0 is any other word."""

    hashes: np.ndarray

    @classmethod
    def of(cls, words: Sequence[str]) -> Words:
        return cls(np.array(sorted({text_hash(w.lower()) for w in words if w}), np.uint64))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)


class Lines:
    """The lines (and parts of long lines) of a chunk, with counts of each.

    piece: index of the text's piece; weight: characters that aren't blank; the rest are counts of a part.
    """

    def __init__(self, chunk: Chunk, words: Words, pairs_only: bool = False) -> None:
        """pairs_only: only what the counts of pairs take."""
        raw = chunk.points
        n = len(raw)
        points = _lower()[raw]
        kinds = _word_class()[points]
        blank = kinds == SPACE
        broken = np.zeros(n + 1, bool)  # a line begins here
        if n:
            broken[1:] = _member(raw, "".join(map(chr, BREAKS)))
            broken[chunk.start[chunk.end > chunk.start]] = True
        begins = np.empty(n, bool)
        if n:
            begins[0] = not blank[0]
            begins[1:] = ~blank[1:] & (blank[:-1] | broken[1:n])
        token = np.flatnonzero(begins)
        line = np.flatnonzero(broken[:n])
        of = np.searchsorted(line, token, "right") - 1 if n else token
        part = (token - line[of]) // PART if n else token
        fresh = np.ones(len(token), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(fresh)
        self.start = token[first]
        self.count = count = len(first)
        self.line = of[first]
        self.piece = np.searchsorted(chunk.start, self.start, "right") - 1
        # an empty text has the same start as the next one; the last such piece is the text
        seg_of_token = np.cumsum(fresh) - 1
        edges = np.append(self.start, n)
        total = lambda mask: np.add.reduceat(mask.astype(np.int32), self.start) if count else np.zeros(0, np.int32)
        letter, digit = kinds == LETTER, kinds == NUMBER
        if not pairs_only:
            self.letters, self.digits, self.others = total(letter), total(digit), total(kinds == OTHER)
            self.weight = self.letters + self.digits + self.others
            self.capitals = total(raw != points)
        self.tokens = np.bincount(seg_of_token, minlength=count)
        # words: runs of letters
        edge = np.zeros(n + 1, np.int8)
        edge[:n] = letter
        begin = np.flatnonzero((edge[:n] == 1) & (np.append([0], edge[: n - 1]) == 0) | (letter & broken[:n])) if n else token
        ends = np.flatnonzero((edge[:n] == 1) & ((edge[1:] == 0) | broken[1:])) + 1 if n else token
        where = np.searchsorted(self.start, begin, "right") - 1
        prefix = prefix_hash(points)
        hashes = slice_hash(prefix, begin, ends)
        number = words.number(hashes)
        size = ends - begin
        dot = np.append(raw, 0)[np.minimum(ends, n)] == 46 if n else np.zeros(0, bool)
        initial = (size == 1) & (raw[begin] != points[begin]) & dot
        per = lambda mask: np.bincount(where, mask, count) if count else np.zeros(0)
        self.words = np.bincount(where, minlength=count)
        self.common = per(number > 0)
        self.word_letters = per(size)
        self.initials = per(initial)
        if not pairs_only:
            long = np.diff(np.append(token, n))
            if len(token):  # a token's length without the blanks after it
                solid = np.concatenate(([0], np.cumsum(~blank)))
                long = solid[np.append(token[1:], n)] - solid[token]
            self.long = np.bincount(seg_of_token, np.where(long > 24, long, 0), count) if count else np.zeros(0)
            self.tiny = np.bincount(seg_of_token, long == 1, count) if count else np.zeros(0)
        # pairs of neighbouring words in one part, as numbers of frequent words
        follows = np.flatnonzero(where[1:] == where[:-1])
        sort = np.where(number > 0, number, len(words.hashes) + 1 + (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS)
        self.pair_where, self.pair = where[follows], np.stack((sort[follows], sort[follows + 1]))
        # words that stood in the last few words before
        again, near = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        for back in range(1, 9):
            again[back:] |= (hashes[back:] == hashes[:-back]) & (where[back:] - where[:-back] <= 1)
            if back == 2:
                near |= again
        self.near = per(near)
        self.again = per(again & (number == 0))
        self.again_all = per(again)
        # neighbouring letters
        low = np.where((points >= 97) & (points <= 122), points - 96, 0).astype(np.int16)
        both = np.flatnonzero(letter[1:] & letter[:-1] & ~broken[1:n]) if n else token  # not from one text to the next
        self.letter_pair = low[both] * 27 + low[both + 1]
        self.letter_where = np.searchsorted(self.start, both, "right") - 1
        if pairs_only:
            return
        self.separators = total(_member(raw, SEPARATORS)) if count else np.zeros(0)
        wide = np.zeros(n, bool)
        if n > 1:
            wide[1:] = (raw[1:] == 32) & (raw[:-1] == 32)
        self.wide = total(wide)
        last = np.zeros(count, np.int64)
        solid_at = np.flatnonzero(~blank)
        if count:
            last = solid_at[np.searchsorted(solid_at, edges[1:]) - 1]
        self.ends = _member(raw[last], ENDS) if count else np.zeros(0, bool)
        head = raw[self.start] if count else raw[:0]
        self.head = np.select([_member(head, "•*-–—·▪◦>|#["), classes()[head] == NUMBER, classes()[head] == OTHER, _lower()[head] != head], [1, 2, 3, 4], 0) if count else np.zeros(0, int)
        self.line_first = np.zeros(count, bool)
        self.line_first[np.flatnonzero(np.append([True], of[first][1:] != of[first][:-1])[:count])] = True
        next_line = np.append(of[first][1:] != of[first][:-1], True)[:count] if count else np.zeros(0, bool)
        self.line_end = next_line
        self.width = np.diff(edges) if count else np.zeros(0)


@dataclass(frozen=True)
class Model:
    """Emission log-probabilities [feature][bin, state], transition and start log-probabilities, and pair scores."""

    words: Words
    pairs: np.ndarray
    letters: np.ndarray
    emission: tuple[np.ndarray, ...]
    transition: np.ndarray
    start: np.ndarray


#: Upper edges of the bins of each line statistic.
BINS = {
    "letter_share": (0.2, 0.4, 0.55, 0.65, 0.75, 0.85, 0.93, 0.97),
    "digit_share": (0.001, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6),
    "symbol_share": (0.001, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35),
    "common_share": (0.001, 0.06, 0.12, 0.18, 0.24, 0.3, 0.38, 0.5, 0.65),
    "word_length": (1.5, 2.5, 3.3, 4.0, 4.6, 5.2, 6.0, 7.0, 9.0),
    "pair_score": (-1.0, -0.5, -0.25, 0.0, 0.1, 0.2, 0.3, 0.45, 0.6, 0.9),
    "pair_score_around": (-0.6, -0.3, -0.15, 0.0, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0),
    "again_all_share": (0.02, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8),
    "near_share": (0.001, 0.05, 0.12, 0.3),
    "capital_share": (0.001, 0.01, 0.03, 0.08, 0.2, 0.6),
    "initials": (0.5, 1.5, 3.5),
    "letter_score": (-1.5, -0.9, -0.5, -0.25, -0.1, 0.0, 0.1, 0.2, 0.35),
    "again_share": (0.001, 0.08, 0.15, 0.25, 0.4, 0.6),
    "long_share": (0.001, 0.2, 0.5, 0.8),
    "tiny_share": (0.03, 0.08, 0.15, 0.3, 0.6),
    "separators": (0.001, 0.012, 0.025, 0.05, 0.09, 0.14),
    "wide_share": (0.001, 0.03, 0.1, 0.2),
    "weight": (4, 10, 20, 35, 60, 90),
    "head": (0.5, 1.5, 2.5, 3.5),
    "ends": (0.5,),
}


def _around(lines: Lines, group: np.ndarray, values: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Sums of values over each part and the AROUND parts to either side that have the same group."""
    if not lines.count:
        return [np.zeros(0) for _ in values]
    change = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    at = np.arange(lines.count)
    of = np.searchsorted(change, at, "right") - 1
    low, high = np.maximum(at - AROUND, change[of]), np.minimum(at + AROUND + 1, change[of + 1])
    sums = [np.concatenate(([0], np.cumsum(v))) for v in values]
    return [s[high] - s[low] for s in sums]


def _scores(lines: Lines, pairs: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean pair score of each part, the same over the parts around it, and mean score of its neighbouring letters."""
    n = np.bincount(lines.pair_where, minlength=lines.count)
    score = np.bincount(lines.pair_where, pairs[lines.pair[0], lines.pair[1]], lines.count) if lines.count else np.zeros(0)
    order = score / np.maximum(n, 1)
    total, number = _around(lines, lines.piece, (score, n))
    around = total / np.maximum(number, 1)
    m = np.maximum(np.bincount(lines.letter_where, minlength=lines.count), 1)
    shape = np.bincount(lines.letter_where, letters[lines.letter_pair], lines.count) / m if lines.count else np.zeros(0)
    return order, around, shape


def _statistics(lines: Lines, pairs: np.ndarray, letters: np.ndarray) -> dict[str, np.ndarray]:
    weight, words = np.maximum(lines.weight, 1), np.maximum(lines.words, 1)
    order, around, shape = _scores(lines, pairs, letters)
    return {
        "letter_share": lines.letters / weight, "digit_share": lines.digits / weight, "symbol_share": lines.others / weight,
        "common_share": lines.common / words, "word_length": lines.word_letters / words, "pair_score": order,
        "pair_score_around": around, "again_all_share": lines.again_all / words, "near_share": lines.near / words, "capital_share": lines.capitals / weight,
        "initials": _around(lines, lines.line, (lines.initials,))[0], "letter_score": shape,
        "again_share": lines.again / words, "long_share": lines.long / weight, "tiny_share": lines.tiny / np.maximum(lines.tokens, 1),
        "separators": lines.separators / weight, "wide_share": lines.wide / np.maximum(lines.width, 1), "weight": lines.weight, "head": lines.head, "ends": lines.ends,
    }


def _bins(statistics: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(np.array(edges), statistics[k], "left") for k, edges in BINS.items()]


def _seeds(lines: Lines, s: dict[str, np.ndarray]) -> np.ndarray:
    """First labels of clear lines, by what the kinds of text are; -1 where it isn't clear."""
    out = np.full(lines.count, -1)
    many = lines.words >= 7
    flowing = many & (s["common_share"] >= 0.24) & (s["letter_share"] > 0.8) & (s["again_share"] < 0.2) & (s["tiny_share"] < 0.3) & (s["separators"] < 0.05)
    ordered = (s["pair_score"] > 0.3) & (s["pair_score_around"] > 0.3) & (s["near_share"] < 0.12)
    out[flowing & ordered & (s["letter_score"] > -0.3)] = PROSE
    numeric = (s["digit_share"] > 0.35) & (lines.tokens >= 2)
    out[numeric & (s["symbol_share"] < 0.5)] = TABLE
    out[(lines.separators >= 3) & (s["digit_share"] > 0.25)] = TABLE
    out[(s["common_share"] < 0.12) & (s["digit_share"] < 0.3) & (lines.words >= 1) & (lines.weight < 45) & ~lines.ends & lines.line_end & lines.line_first & (s["letter_share"] > 0.5)] = LIST
    out[np.isin(lines.head, (1, 2)) & (s["common_share"] < 0.2) & (s["letter_share"] > 0.5) & (s["digit_share"] > 0.03)] = LIST
    out[(s["initials"] >= 2) & (s["common_share"] < 0.45)] = LIST
    out[(s["symbol_share"] > 0.5) & (lines.weight >= 8)] = JUNK
    out[(s["long_share"] > 0.6) & (s["common_share"] < 0.1)] = JUNK
    out[(lines.words >= 8) & (lines.again_all / np.maximum(lines.words, 1) > 0.75)] = JUNK
    out[(s["tiny_share"] > 0.75) & (s["letter_share"] > 0.6) & (lines.tokens >= 12)] = JUNK
    out[many & (s["letter_score"] < -0.7) & (s["common_share"] < 0.1)] = JUNK
    out[many & (s["common_share"] > 0.2) & (s["pair_score_around"] < 0.0) & (s["letter_share"] > 0.8)] = JUNK
    out[many & (s["near_share"] > 0.4)] = JUNK
    return out


def _ratio(counts: np.ndarray, soft: float) -> np.ndarray:
    """Log of how much more often a pair occurs than its parts would give by chance, smoothed towards rare."""
    total = counts.sum() + 1e-9
    left, right = counts.sum(1, keepdims=True) / total, counts.sum(0, keepdims=True) / total
    return np.clip(np.log((counts / total + soft / total) / (left * right + soft / total)), -4, 4)


def _pieces(lines: Lines, pieces: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(lines.piece, minlength=pieces))))


def viterbi(score: np.ndarray, edges: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Most probable states of each sequence; score[line, state], edges of the sequences.

    All sequences go step by step together. Sequences of more than BLOCK lines go in blocks: the best way through each block
    from every state to every other (a max-plus product) is found for all blocks together, the blocks are put in a chain,
    and then each one, its state before and its last state being known, is a sequence like the others.
    """
    length = np.diff(edges)
    first, into, last = edges[:-1], np.broadcast_to(start, (len(length), score.shape[1])), np.full(len(length), -1)
    long = np.flatnonzero(length > BLOCK)
    if len(long):
        counts = -(-length[long] // BLOCK)
        begin = np.repeat(first[long] - BLOCK * (np.cumsum(counts) - counts), counts) + BLOCK * np.arange(counts.sum())
        size = np.minimum(BLOCK, np.repeat(edges[long + 1], counts) - begin)
        entry, exit_ = _chain(_through(score, begin, size, transition), counts, start)
        rows = np.where((entry < 0)[:, None], start, transition[np.maximum(entry, 0)])
        short = np.flatnonzero(length <= BLOCK)
        first, length = np.concatenate((first[short], begin)), np.concatenate((length[short], size))
        into, last = np.concatenate((into[short], rows)), np.concatenate((last[short], exit_))
    return _together(score, first, length, into, last, transition)


def _through(score: np.ndarray, begin: np.ndarray, size: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """[block, state on entry, last state]: score of the best way through each block. Entry is the state before the block's first line;
    state k (one more than there are) stands for a sequence's beginning, whose start is added later."""
    k = score.shape[1]
    best = np.concatenate((np.broadcast_to(transition, (len(begin), k, k)), np.where(np.eye(k), 0.0, -np.inf)[None].repeat(len(begin), 0)), 1) + score[begin][:, None]
    # rows k to 2k - 1: the block begins a sequence in that state
    for t in range(1, int(size.max())):
        live = np.flatnonzero(size > t)
        best[live] = (best[live][:, :, :, None] + transition[None, None]).max(2) + score[begin[live] + t][:, None]
    return best


def _chain(through: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before each block (-1: none, it begins a sequence) and its last state, on the best way through all blocks of each sequence."""
    k = through.shape[2]
    entry, exit_ = np.full(len(through), -1), np.zeros(len(through), np.int64)
    at = 0
    for n in counts.tolist():
        own = through[at : at + n]
        best, back = (start[:, None] + own[0, k:]).max(0), np.zeros((n, k), np.int64)
        for b in range(1, n):
            ways = best[:, None] + own[b, :k]
            back[b], best = ways.argmax(0), ways.max(0)
        now = int(best.argmax())
        for b in range(n - 1, -1, -1):
            exit_[at + b] = now
            if b:
                entry[at + b] = now = int(back[b, now])
        at += n
    return entry, exit_


def _together(score: np.ndarray, first: np.ndarray, length: np.ndarray, into: np.ndarray, last: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Most probable states of sequences of known first line, length, log-probabilities of the first state, and last state (-1: any)."""
    n, k = score.shape
    order = np.argsort(-length, kind="stable")
    length, first, into, last = length[order], first[order], into[order], last[order]
    steps = int(length[0]) if len(length) else 0
    back = np.zeros((n, k), np.int8)
    live = np.searchsorted(-length, -np.arange(1, steps + 1), "right")  # sequences with at least so many lines
    best = score[first[: live[0]]] + into[: live[0]] if steps else score
    finals = np.zeros((len(length), k))
    for t in range(1, steps):
        m = live[t]
        finals[m : len(best)] = best[m:]
        at = first[:m] + t
        ways = best[:m, :, None] + transition[None]
        back[at] = ways.argmax(1)
        best = ways.max(1) + score[at]
    if steps:
        finals[: len(best)] = best
    states = np.zeros(n, np.int8)
    if steps:
        now = np.where(last >= 0, last, finals.argmax(1))[: live[0]]
        for t in range(steps - 1, -1, -1):
            m = live[t]
            at = first[:m] + t
            fresh = length[:m] == t + 1
            ahead = np.where(fresh, now[:m], 0)
            if t + 1 < steps:
                going = np.flatnonzero(~fresh)
                ahead[going] = back[at[going] + 1, states[at[going] + 1]]
            states[at] = ahead
    return states


def _emit(model: Model, bins: list[np.ndarray]) -> np.ndarray:
    score = np.zeros((len(bins[0]), len(STATES)))
    for table, b in zip(model.emission, bins):
        score += table[b]
    return score


def _pair_counts(lines: Lines, words: Words) -> np.ndarray:
    """Counts of each pair of neighbouring words, then of letters, in lines that look like text of some kind."""
    size = len(words.hashes) + 1 + BUCKETS
    share = lines.common / np.maximum(lines.words, 1)
    fair = (share > 0.2) & (lines.words >= 7) & (lines.again_all / np.maximum(lines.words, 1) < 0.6)
    use = fair[lines.pair_where]
    return np.concatenate((np.bincount(lines.pair[0][use] * size + lines.pair[1][use], minlength=size * size), np.bincount(lines.letter_pair[fair[lines.letter_where]], minlength=27 * 27)))


def _pair_scores(counts: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    size = len(words.hashes) + 1 + BUCKETS
    return _ratio(counts[: size * size].reshape(size, size).astype(float), 1.0), _ratio(counts[size * size :].reshape(27, 27).astype(float), 5.0).ravel()


def _label_counts(bins: list[np.ndarray], label: np.ndarray, edges: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Counts of labels by bin of each statistic, of moves between labels, of first labels, and of lines without a label.

    Only lines of the mask count, and moves from or to them; -1 is no label.
    """
    known = np.flatnonzero((label >= 0) & of)
    emission = [np.bincount(b[known] * 4 + label[known], minlength=(len(e) + 1) * 4) for e, b in zip(BINS.values(), bins)]
    head = np.zeros(len(label), bool)
    head[edges[:-1][np.diff(edges) > 0]] = True
    inner = np.flatnonzero(~head[1:] & (label[1:] >= 0) & (label[:-1] >= 0) & (of[1:] | of[:-1]))
    moves = np.bincount(label[inner].astype(np.int64) * 4 + label[inner + 1], minlength=16)
    return np.concatenate((*emission, moves, np.bincount(label[head & of & (label >= 0)], minlength=4), [(label < 0).sum()]))


def _model(words: Words, pairs: np.ndarray, letters: np.ndarray, counts: np.ndarray) -> Model:
    cuts = np.cumsum([*[(len(e) + 1) * 4 for e in BINS.values()], 16, 4])
    *emission, moves, starts, _ = np.split(counts, cuts)
    emission = [t.reshape(-1, 4) + 1 for t in emission]
    moves, starts = moves.reshape(4, 4) + 1, starts + 1
    return Model(words, pairs, letters, tuple(0.6 * np.log(t / t.sum(0)) for t in emission), np.log(moves / moves.sum(1, keepdims=True)), np.log(starts / starts.sum()))


def _seed_counts(chunk: Chunk, words: Words, pairs: np.ndarray, letters: np.ndarray) -> np.ndarray:
    lines = Lines(chunk, words)
    s = _statistics(lines, pairs, letters)
    return _label_counts(_bins(s), _seeds(lines, s), _pieces(lines, len(chunk.start)), np.ones(lines.count, bool))


def _round(chunk: Chunk, model: Model) -> np.ndarray:
    """Counts of the labels that the model gives the lines of a chunk that aren't clear."""
    lines = Lines(chunk, model.words)
    s = _statistics(lines, model.pairs, model.letters)
    bins, seed, edges = _bins(s), _seeds(lines, s), _pieces(lines, len(chunk.start))
    label = np.where(seed >= 0, seed, viterbi(_emit(model, bins), edges, model.transition, model.start))
    counts = _label_counts(bins, label, edges, seed < 0)
    counts[-1] = (seed < 0).sum()
    return counts


def fit(total: Callable[[Callable[[Chunk], np.ndarray], int, bool], np.ndarray], words: Words, rounds: int = ROUNDS) -> Model:
    """A model from unlabelled texts: clear lines are labelled by their kind's marks, the model is counted from them,
    labels all lines, and is counted again, a few rounds; clear lines keep their label's weight.

    total: sums a count, of a given size, over the chunks of all texts, or (true) of a sample of them. The sample only
    gives the counts of lines that aren't clear, in proportion to their number in all texts.
    """
    n_counts = sum(len(e) + 1 for e in BINS.values()) * 4 + 21
    pairs, letters = _pair_scores(total(lambda c: _pair_counts(Lines(c, words, pairs_only=True), words), (len(words.hashes) + 1 + BUCKETS) ** 2 + 27 * 27, False), words)
    clear = total(lambda c: _seed_counts(c, words, pairs, letters), n_counts, False)
    model = _model(words, pairs, letters, clear)
    for _ in range(rounds):
        now = model
        unclear = total(lambda c: _round(c, now), n_counts, True)
        model = _model(words, pairs, letters, clear + clear[-1] / max(unclear[-1], 1) * unclear)
    return model


def fit_texts(texts: Sequence[str | None], words: Words, rounds: int = ROUNDS) -> Model:
    """The model of texts that are at hand."""
    held = list(chunks(pa.array(list(texts), pa.large_string()), whole=True))
    return fit(lambda count, size, _: sum((count(c) for c in held), np.zeros(size, np.int64)), words, rounds)


FIELDS = (
    "n_chars", "n_lines", "n_words", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share",
    "prose_share", "list_share", "table_share", "junk_share", "kind",
)


def describe(texts: pa.Array, model: Model) -> list[pa.Array]:
    """The columns FIELDS of each text."""
    n = len(texts)
    sums = {k: np.zeros(n) for k in ("chars", "lines", "words", "letters", "others", "weight", "ended", "common")}
    shares = np.zeros((n, len(STATES)))
    for chunk in chunks(texts, whole=True):  # a text's chain is never cut
        lines = Lines(chunk, model.words)
        np.add.at(sums["chars"], chunk.row, chunk.end - chunk.start)
        if not lines.count:
            continue
        statistics = _statistics(lines, model.pairs, model.letters)
        states = viterbi(_emit(model, _bins(statistics)), _pieces(lines, len(chunk.start)), model.transition, model.start)
        row = chunk.row[lines.piece]
        for k, v in (("lines", lines.line_end), ("words", lines.words), ("letters", lines.word_letters), ("others", lines.others), ("weight", lines.weight), ("ended", lines.ends & lines.line_end), ("common", lines.common)):
            sums[k] += np.bincount(row, v, n)
        shares += np.bincount(row * 4 + states, lines.weight, n * 4).reshape(n, 4)
    part = lambda a, b: pa.array(np.where(sums[b] > 0, sums[a] / np.maximum(sums[b], 1), 0.0), mask=sums[b] == 0)
    empty = sums["weight"] == 0
    kinds = np.array(STATES, object)[shares.argmax(1)]
    return [
        *[pa.array(sums[k].astype(np.int64)) for k in ("chars", "lines", "words")],
        part("letters", "words"), part("others", "weight"), part("ended", "lines"), part("common", "words"),
        *[pa.array(shares[:, i] / np.maximum(sums["weight"], 1), mask=empty) for i in range(4)],
        pa.array(np.where(empty, None, kinds), pa.string()),
    ]


def _summed(texts: DataFrame, count: Callable[[Chunk], np.ndarray], size: int) -> np.ndarray:
    """Sum of count, an array of fixed size, over the chunks of all texts: a partial sum per task, then one by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0), whole=True):
                total += count(chunk)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    sums = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size rows
    out = np.zeros(size, np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


def fit_on(df: DataFrame, key: str, text: str, words: Words, documents: int = FIT_DOCUMENTS) -> Model:
    """The model of all rows: word and letter pairs and clear lines are counted over every text. Only the lines that
    aren't clear are labelled, in the refitting rounds, on the `documents` rows of lowest key hash, a bounded sample. Counts
    of fixed size come to the driver, texts don't."""
    given = df.where(F.col(text).isNotNull())
    texts = spread(given.select(text))
    sample = cut(given.select(F.col(text).alias("t"), F.xxhash64(key).alias("h")).orderBy("h", "t").limit(documents).select("t"))
    sample = sample.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return fit(lambda count, size, some: _summed(sample if some else texts, count, size), words)


def quality(df: DataFrame, key: str, text: str, words: Words, model: Model | None = None) -> DataFrame:
    """A row per row of df: key and FIELDS.

    n_chars and n_lines (lines with something on them), n_words (runs of letters), mean_word_length, symbol_ratio (of
    characters that aren't blank, those that are neither letter nor digit), punctuated_line_share (lines that end in
    .!?…), common_word_share (words in the list, letter case aside); then the share of non-blank characters in lines
    that the hidden Markov model labels prose, list, table or junk, and the kind with the largest share (the first
    in this order on ties). Null, empty and blank texts have zero counts and null shares and kind. Whole texts are
    used, each in one piece, so a task's memory is that of the longest text.
    Narrow: only a table of fewer splits than cores is spread first.
    """
    model = model or fit_on(df, key, text, words)
    rows = spread(df.select(F.col(key).alias(key), F.col(text).alias("_text")))
    kinds = ["bigint"] * 3 + ["double"] * 8 + ["string"]
    schema = ", ".join([f"`{key}` {rows.schema[key].dataType.simpleString()}", *[f"{f} {k}" for f, k in zip(FIELDS, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *describe(batch.column(1), model)], names=[key, *FIELDS])

    return rows.mapInArrow(run, schema)
