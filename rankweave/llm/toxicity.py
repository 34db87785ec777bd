"""Toxicity scores from a subsequence-kernel support vector machine with Nystroem landmarks."""

from __future__ import annotations

import pickle
import tempfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.rows import named, packed, unpacked
from rankweave.llm.scratch import give_back, lean, received, send
from rankweave.llm.words import NOT_SPACE, SMALL_PIECE, Words, _words, mix, split_words

#: Labelled documents that the model is fitted on at most (those with the least hashed ids).
SAMPLE_DOCS = 5000
#: Bytes of their texts that the fit takes at most, in one task; a text of more than a sixteenth of it stays out of the fit (not of the scores).
SAMPLE_BYTES = 16 << 20
#: Chi square (one degree of freedom) from which a piece of a word becomes a landmark; there is no cap on their number.
LEVEL = 20.0
#: Usual clean units at least; else one for every three toxic pieces.
LEAST_USUAL = 6
#: Longer units are scored by their best stretch of this many bytes.
UNIT_BYTES = 32
LANDMARK_BYTES = 12
#: Subsequences of ORDER bytes count DECAY for every byte that they stretch over, however many that are.
ORDER, DECAY = 3, 0.8
#: The kernel to the fourth power.
SQUARINGS = 2
#: Letters that are put into the units of virtual examples.
PUT_IN = (1, 2)
#: A sentence ends at one of .!? or a line's end, or after this many words.
SENTENCE_WORDS = 25
#: Slots for what known units add, 40 bytes each; a power of two.
CACHE_UNITS = 1 << 20
#: Units that meet the landmarks together.
BLOCK_UNITS = 2048
#: Subsequences that are looked up together.
BLOCK_TRIPLES = 100_000
#: Pairs of places that are compared together.
BLOCK_CELLS = 200_000
#: Subsequences that so many landmarks share are looked up as columns of a matrix.
WIDE = 8
#: Sentences whose units are added up together.
BLOCK_SENTENCES = 2048
#: What a unit adds up to this is taken for noise when a document's units are added up.
UNIT_FLOOR = 0.2
FEATURES = 6
#: A clean document called toxic counts as so many toxic ones missed.
CLEAN_WEIGHT = 2.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_LOOKS_LIKE = np.arange(256, dtype=np.uint8)
for _sign, _as in zip(b"0134579@$", b"oieastgas", strict=True):
    _LOOKS_LIKE[_sign] = _as
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\n")] = True
#: All numbers of two bytes as four bytes, which is much faster than converting them.
_HALF = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32)
#: The first so many of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def subsequence_kernel(s: np.ndarray, t: np.ndarray | None = None, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of byte strings, padded with zeros.

    All of ``s`` (U x L) with all of ``t`` (M x N): U x M; without ``t`` each of ``s`` with itself: U.
    A common subsequence of ``order`` bytes counts ``decay`` to the power of its whole stretch in both strings.
    """
    if t is None:
        step = max(1, BLOCK_CELLS // max(1, s.shape[1] ** 2))
        return np.concatenate([_kernel_of(x, x, order, decay) for x in np.split(s, range(step, len(s), step))])
    return np.array([_kernel_of(s, np.broadcast_to(x, (len(s), len(x))), order, decay) for x in t]).reshape(len(t), len(s)).T


def _kernel_of(s: np.ndarray, t: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Kernel of each string of ``s`` with that of ``t`` in the same row.

    ``ends`` holds for two places the weight of common subsequences so far that end there; one byte
    more sums what stands before both places, which is a product with a triangle of powers on either side.
    """
    equal = ((s[:, :, None] == t[:, None, :]) & (s > 0)[:, :, None]).astype(np.float64)
    ends = equal
    for _ in range(order - 1):
        ends = equal * (_before(s.shape[1], decay).T @ (ends @ _before(t.shape[1], decay)))
    return decay * decay * ends.sum((1, 2))


def _before(length: int, decay: float) -> np.ndarray:
    """Of places j < k: decay ** (k - j)."""
    gap = np.arange(length)[None, :] - np.arange(length)[:, None]
    return np.where(gap > 0, float(decay) ** np.maximum(gap, 0), 0.0)


def padded(units: list[bytes], size: int) -> np.ndarray:
    out = np.zeros((len(units), size), np.uint8)
    for i, u in enumerate(units):
        out[i, : len(u)] = np.frombuffer(u, np.uint8)
    return out


def stretches(length: int, order: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a string, and their weights."""
    places = np.array(list(combinations(range(length), order)), np.int64).reshape(-1, order).T
    return places, decay ** (places[-1] - places[0] + 1.0)


class Index:
    """Landmarks by their subsequences of ``order`` bytes, so that a unit meets only landmarks that share one with it."""

    def __init__(self, marks: list[bytes], order: int = ORDER, decay: float = DECAY):
        self.order, self.decay, self.size = order, decay, len(marks)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        used = sorted(set(b"".join(marks)))
        self.symbol = np.zeros(256, np.int32)  # 0: in no landmark
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.base = len(used) + 1
        entries: dict[tuple[int, int], float] = {}
        for i, m in enumerate(marks):
            at, weights = self._places(len(m))
            for code, w in zip(self._codes(self.symbol[np.frombuffer(m, np.uint8)][None, :], at)[0].tolist(), weights.tolist(), strict=True):
                entries[code, i] = entries.get((code, i), 0.0) + w
        held = sorted(entries)
        owner = np.array([i for _, i in held], np.int64)
        weight = np.array([entries[x] for x in held], np.float64)
        begin = np.searchsorted(np.array([c for c, _ in held], np.int64), np.arange(self.base**order + 1))
        count = np.diff(begin)
        # subsequences of many landmarks are columns of a matrix, the others have lists
        wide = np.flatnonzero(count >= WIDE)
        self.column = np.full(len(count), -1, np.int32)
        self.column[wide] = np.arange(len(wide))
        self.shared = np.zeros((len(wide), self.size))
        for k, c in enumerate(wide.tolist()):
            self.shared[k, owner[begin[c] : begin[c + 1]]] = weight[begin[c] : begin[c + 1]]
        self.few = np.where(count < WIDE, count, 0).astype(np.uint8)
        self.begin, self.owner, self.weight = begin[:-1].astype(np.int32), owner, weight

    def _places(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length not in self.known:
            self.known[length] = stretches(length, self.order, self.decay)
        return self.known[length]

    def _codes(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        codes = np.take(symbols, at[0], 1)
        for x in at[1:]:
            codes *= self.base
            codes += np.take(symbols, x, 1)
        return codes

    def kernel(self, s: np.ndarray) -> np.ndarray:
        """``subsequence_kernel`` of byte strings, padded with zeros, with all landmarks."""
        out = np.zeros((len(s), self.size), np.float32)
        at, weights = self._places(s.shape[1])
        places, wide = len(weights), len(self.shared)
        step = max(1, BLOCK_TRIPLES // max(1, places))
        for a in range(0, len(s) if places and self.size else 0, step):
            codes = self._codes(self.symbol[s[a : a + step]], at).ravel()
            rows = len(codes) // places
            column = self.column[codes]
            hit = np.flatnonzero(column >= 0)
            row = hit // places
            total = np.bincount(row * wide + column[hit], weights[hit - row * places], minlength=rows * wide).reshape(rows, wide) @ self.shared
            left = self.few[codes]
            hit = np.flatnonzero(left)
            left, entry, row = left[hit], self.begin[codes[hit]], hit // places
            cell, weight = row * self.size, weights[hit - row * places]
            while len(left):  # the first landmark of each list, then the second
                total += np.bincount(cell + self.owner[entry], weight * self.weight[entry], minlength=total.size).reshape(total.shape)
                more = np.flatnonzero(left > 1)
                left, entry, cell, weight = left[more] - 1, entry[more] + 1, cell[more], weight[more]
            out[a : a + step] = total
        return out


def similarity(units: list[bytes], index: Index, marks_own: np.ndarray) -> np.ndarray:
    """Normalised kernel, squared SQUARINGS times, of units with landmarks; a long unit counts by its best stretch."""
    out = np.zeros((len(units), index.size), np.float32)
    parts = [(i, u[a : a + UNIT_BYTES]) for i, u in enumerate(units) for a in range(0, max(1, len(u) - UNIT_BYTES // 2), UNIT_BYTES // 2)]
    parts.sort(key=lambda x: len(x[1]))
    sizes = np.array([len(u) for _, u in parts], np.int64)
    for a in np.unique(np.concatenate([np.arange(0, len(parts), BLOCK_UNITS), np.searchsorted(sizes, np.unique(sizes))])).tolist():
        end = min(a + BLOCK_UNITS, len(parts), int(np.searchsorted(sizes, sizes[a], "right")))  # units of one length
        part = parts[a:end]
        s = np.frombuffer(b"".join(u for _, u in part), np.uint8).reshape(len(part), -1) if sizes[a] else np.zeros((len(part), 1), np.uint8)
        value = index.kernel(s)
        value *= (1 / np.sqrt(np.maximum(subsequence_kernel(s), 1e-12))).astype(np.float32)[:, None]
        value *= (1 / np.sqrt(marks_own)).astype(np.float32)
        np.minimum(np.float32(1), value, out=value)
        for _ in range(SQUARINGS):
            value *= value
        rows = np.array([i for i, _ in part])
        if sizes[a] <= UNIT_BYTES // 2 or len(np.unique(rows)) == len(rows):  # parts of a longer unit are longer
            out[rows] = np.maximum(out[rows], value)
        else:
            np.maximum.at(out, rows, value)
    return out


def edged(unit: bytes) -> bytes:
    """A unit between marks of its edges."""
    return b"\x02" + unit + b"\x03"


def varied(unit: bytes, letters: int) -> bytes:
    """A unit with letters put in, which and where a hash of it tells; never inside a character."""
    h = zlib.crc32(unit)
    for _ in range(letters):
        places = [i for i in range(len(unit) + 1) if i == len(unit) or unit[i] & 0xC0 != 0x80]
        h = (h * 1103515245 + 12345) % (1 << 31)
        i = places[(h >> 8) % len(places)]
        unit = unit[:i] + bytes([97 + (h >> 16) % 26]) + unit[i:]
    return unit


@dataclass
class Units:
    """Units of the rows of a piece: words reduced to letters, and spelled-out words (rows of single letters) joined."""

    letters: Words
    rows: np.ndarray
    sentences: np.ndarray
    count: int

    def text(self, i: int) -> bytes:
        """The unit between marks of its edges."""
        w = self.letters
        return edged(w.data[w.starts[i] : w.ends[i]].tobytes())


def units(words: Words, count: int) -> Units:
    """Letters are a-z and bytes beyond ASCII; digits and signs that look like a letter count as it before a letter, others are left out."""
    data = words.data
    n = len(data)
    before_letter = np.zeros(n, dtype=bool)
    before_letter[:-1] = _LETTER[data[1:]]
    kept = _LETTER[data] | ((_LOOKS_LIKE != np.arange(256))[data] & before_letter)
    at = np.flatnonzero(kept)
    compact = _LOOKS_LIKE[data[at]]
    offsets = np.searchsorted(at, np.append(words.starts, n))
    own = _words(compact, offsets, np.ones(256, dtype=bool))
    ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
    word = own.rows  # the word of each unit
    rows = words.rows[word]
    sentence = ends[words.starts[word]]
    # number sentences from 0 inside the piece: a new one at a new row, a new sentence, or after SENTENCE_WORDS
    change = np.ones(len(word), dtype=bool)
    change[1:] = (rows[1:] != rows[:-1]) | (sentence[1:] != sentence[:-1])
    begin = np.maximum.accumulate(np.where(change, np.arange(len(word)), 0))
    change |= (np.arange(len(word)) - begin) % SENTENCE_WORDS == 0
    out = Units(own, rows, np.cumsum(change) - 1, count)
    return _spelled(out)


def compact(u: Units) -> Units:
    """The same in less memory, for keeping many."""
    w = u.letters
    small = Words(w.data, w.starts.astype(np.int32), w.ends.astype(np.int32), np.zeros(0, np.int32), w.hashes, np.zeros(0, np.int32))
    return Units(small, u.rows.astype(np.int32), u.sentences.astype(np.int32), u.count)


def without_letters(u: Units) -> Units:
    """Rows and sentences alone, where it is known what each unit adds."""
    none = np.zeros(0, np.int32)
    return Units(Words(np.zeros(0, np.uint8), none, none, none, np.zeros(0, np.uint64), none), u.rows, u.sentences, u.count)


def _spelled(u: Units) -> Units:
    """Join runs of four or more single letters of one row."""
    single = (u.letters.ends - u.letters.starts) == 1
    if len(single) < 4 or not (single[3:] & single[2:-1] & single[1:-2] & single[:-3]).any():
        return u
    edge = np.flatnonzero(np.concatenate([[True], (single[1:] != single[:-1]) | (u.rows[1:] != u.rows[:-1])]))
    stop = np.append(edge[1:], len(single))
    w = u.letters
    runs = [(a, b) for a, b in zip(edge, stop, strict=True) if single[a] and b - a >= 4]
    gone = np.zeros(len(single), dtype=bool)
    for a, b in runs:
        gone[a + 1 : b] = True
        w.ends[a] = w.ends[b - 1]
    keep = ~gone
    starts, ends = w.starts[keep], w.ends[keep]
    again = _words(w.data, np.append(starts, len(w.data)), np.ones(256, dtype=bool))
    return Units(again, u.rows[keep], u.sentences[keep], u.count)


class Known:
    """What units of at most UNIT_BYTES add, in a table of fixed size: a slot for the hash of each, in which a new unit takes the place of another one.

    Units are told apart by their bytes, which stand in the table with zeros after them.
    """

    def __init__(self, slots: int = 0):
        self.keys = np.zeros((slots or CACHE_UNITS, UNIT_BYTES // 8), np.uint64)
        self.values = np.full(len(self.keys), np.nan)

    def slots(self, w: Words) -> np.ndarray:
        return (w.hashes & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def get(self, w: Words) -> np.ndarray:
        """NaN for units that are not known."""
        at = self.slots(w)
        out = self.values[at]
        here, keys = self.keys[at], first_bytes(w)
        out[(here != keys).any(1) | (w.ends - w.starts > UNIT_BYTES)] = np.nan
        return out

    def put(self, w: Words, values: np.ndarray) -> None:
        at, one = np.unique(self.slots(w), return_index=True)
        fits = (w.ends - w.starts)[one] <= UNIT_BYTES
        at, one = at[fits], one[fits]
        self.keys[at], self.values[at] = first_bytes(w)[one], values[one]


def first_bytes(w: Words) -> np.ndarray:
    """The first UNIT_BYTES of each word as numbers of eight bytes, with zeros after a shorter word."""
    raw = np.concatenate([w.data, np.zeros(UNIT_BYTES + 8, np.uint8)])
    eight = np.ndarray(len(w.data) + UNIT_BYTES, "<u8", raw.data, strides=(1,)).copy()  # eight bytes from every place
    size = w.ends - w.starts
    out = np.empty((len(size), UNIT_BYTES // 8), np.uint64)
    for k in range(out.shape[1]):
        out[:, k] = eight[w.starts + 8 * k if k else w.starts] & _FIRST[np.clip(size - 8 * k, 0, 8)]
    return out


@dataclass
class Model:
    """Weights of landmarks, the machine's offset, and the calibration of documents."""

    marks: list[bytes]
    weights: np.ndarray
    offset: float
    calibration: np.ndarray
    scale: tuple[np.ndarray, np.ndarray]

    def __post_init__(self):
        self.index = Index(self.marks)
        self.own = np.array([max(1e-12, float(subsequence_kernel(padded([x], len(x)))[0])) for x in self.marks], np.float64)
        self.known: Known | None = None

    def __getstate__(self):
        return {**self.__dict__, "known": None}

    def unit_scores(self, u: Units) -> np.ndarray:
        """What each unit adds to its sentence; distinct units are computed once, and those that the worker has met lately are known."""
        self.known = self.known or Known()
        out = self.known.get(u.letters)
        missing = np.flatnonzero(np.isnan(out))
        if len(missing):
            new = only(u, missing).letters
            names, back = new.distinct()
            values = np.zeros(len(names))
            for a in range(0, len(names) if self.marks else 0, 4 * BLOCK_UNITS):
                values[a : a + 4 * BLOCK_UNITS] = similarity([edged(x) for x in names[a : a + 4 * BLOCK_UNITS]], self.index, self.own) @ self.weights
            out[missing] = values[back]
            self.known.put(new, out[missing])
        return out

    def features(self, u: Units, each: np.ndarray | None = None) -> np.ndarray:
        """Of each row: log of 1 + sentences beyond the margin, best sentence (clipped), log of 1 + units, log of 1 + what units add beyond UNIT_FLOOR, log of the share of that in the units, second-best sentence (clipped).

        ``each`` has what the units add, where that is known.
        """
        out = np.zeros((u.count, FEATURES))
        out[:, [1, 5]] = self.offset
        out[:, 4] = np.log(0.01)
        if len(u.rows):
            begins = np.flatnonzero(np.concatenate([[True], u.sentences[1:] != u.sentences[:-1]]))
            each = self.unit_scores(u) if each is None else each
            value = np.add.reduceat(each, begins) + self.offset
            rows = u.rows[begins]
            np.maximum.at(out[:, 1], rows, value)
            out[:, 0] = np.log1p(np.bincount(rows[value > 0], minlength=u.count))
            out[:, 2] = np.log1p(np.bincount(u.rows, minlength=u.count))
            beyond = np.bincount(u.rows, np.maximum(0, each - UNIT_FLOOR), minlength=u.count)
            out[:, 3] = np.log1p(beyond)
            out[:, 4] = np.log((beyond + 0.01) / (np.bincount(u.rows, minlength=u.count) + 1))
            by_value = np.lexsort((-value, rows))
            second = np.flatnonzero(np.concatenate([[False], rows[by_value][1:] == rows[by_value][:-1]]))
            np.maximum.at(out[:, 5], rows[by_value[second]], value[by_value[second]])
        out[:, 5] = np.clip(out[:, 5], -2, 2)
        out[:, 1] = np.clip(out[:, 1], -2, 2)
        return out

    def scores(self, u: Units) -> np.ndarray:
        x = with_products((self.features(u) - self.scale[0]) / self.scale[1])
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration[:-1] + self.calibration[-1], -30, 30)))


@dataclass
class Sentences:
    """Of a piece: where its sentences begin, which of them stand for the sample's distinct ones, and the labels of these (1 if most rows that hold one are toxic)."""

    begins: np.ndarray
    chosen: np.ndarray
    labels: np.ndarray


def distinct_sentences(pieces: list[Units], y: np.ndarray, fresh: list[np.ndarray]) -> list[Sentences]:
    """Sentences of the sample of which at least half the units are fresh, of equal ones (the same units in any order) the first, so that copies count once."""
    begins, keys, votes, new, done = [], [], [], [], 0
    for u, own in zip(pieces, fresh, strict=True):
        at = np.flatnonzero(np.concatenate([[True], u.sentences[1:] != u.sentences[:-1]])) if len(u.rows) else np.zeros(0, np.int64)
        begins.append(at)
        keys.append(np.add.reduceat(mix(u.letters.hashes), at) if len(at) else np.zeros(0, np.uint64))
        votes.append(y[done + u.rows[at]])
        new.append(2 * np.add.reduceat(own.astype(np.int64), at) >= np.diff(np.append(at, len(own))) if len(at) else np.zeros(0, dtype=bool))
        done += u.count
    every, vote = np.concatenate(keys), np.concatenate(votes)
    _, first, back, n = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
    toxic = np.bincount(back, vote, minlength=len(n)) * 2 > n
    stands = np.zeros(len(every), dtype=bool)
    stands[first] = True
    stands &= np.concatenate(new)
    out, done = [], 0
    for at in begins:
        chosen = np.flatnonzero(stands[done : done + len(at)])
        out.append(Sentences(at, chosen, toxic[back[done + chosen]].astype(np.float64)))
        done += len(at)
    return out


def fresh_units(pieces: list[Units]) -> list[np.ndarray]:
    """Which units stand between neighbours that no earlier one of the same text stood between, so that copies and near copies count once."""
    keys = []
    for u in pieces:
        h = u.letters.hashes
        near = np.zeros((2, len(h)), np.uint64)
        same = u.rows[1:] == u.rows[:-1]
        near[0, 1:], near[1, :-1] = np.where(same, h[:-1], 0), np.where(same, h[1:], 0)
        keys.append(mix(mix(near[0] + np.uint64(1)) + h) ^ mix(near[1] + np.uint64(2)))
    first = np.zeros(sum(map(len, keys)), dtype=bool)
    first[np.unique(np.concatenate(keys), return_index=True)[1]] = True
    return np.split(first, np.cumsum([len(k) for k in keys])[:-1])


def of_sentences(s: Sentences, size: int) -> np.ndarray:
    """Which units are in the chosen sentences."""
    ends = np.append(s.begins[1:], size)
    return np.repeat(np.isin(np.arange(len(s.begins)), s.chosen), ends - s.begins) if len(s.begins) else np.zeros(0, dtype=bool)


def only(u: Units, keep: np.ndarray) -> Units:
    """Some of the units."""
    w = u.letters
    return Units(Words(w.data, w.starts[keep], w.ends[keep], w.rows, w.hashes[keep], w.first), u.rows[keep], u.sentences[keep], u.count)


def choose_landmarks(pieces: list[Units], y: np.ndarray, level: float = LEVEL) -> list[bytes]:
    """Starts and ends of units that toxic documents use more than chance allows (chi square of ``level`` or more), and frequent units of clean ones.

    Of pieces that share five bytes in a row only the best is taken.  Names are
    kept for units of toxic documents alone; clean ones are counted by hash.
    """
    held: dict[bytes, int] = {}
    toxic: Counter = Counter()
    for unit, n in _by_label(pieces, y, 1):
        toxic[unit] += n
    for unit, n in toxic.items():
        for g in affixes(unit):
            held[g] = held.get(g, 0) + n
    del toxic
    counts = {g: [n, 0] for g, n in held.items() if n >= 3}
    del held
    for unit, n in _by_label(pieces, y, 0):
        for g in affixes(unit):
            if g in counts:
                counts[g][1] += n
    share = y.mean()
    ranked = sorted((-((a - (a + b) * share) ** 2) / ((a + b) * share), -len(g), g) for g, (a, b) in counts.items() if a > (a + b) * share)
    signs: list[bytes] = []
    taken: set[bytes] = set()
    for less, _, g in ranked:
        if -less < level * (1 - share):
            break
        grams = {g[i : i + 5] for i in range(len(g) - 4)}
        bare = g.strip(b"\x02\x03")
        if not grams & taken and not any(bare in x or x.strip(b"\x02\x03") in bare for x in signs):
            signs.append(g)
            taken |= {bare[i : i + 5] for i in range(len(bare) - 4)} | grams
    usual = max(LEAST_USUAL, len(signs) // 3)
    return signs + [b"\x02" + u + b"\x03" for u in _usual(pieces, y, 16 * usual) if u not in taken][:usual]


def _pairs(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unit of each row once: rows, hashes, and where the unit stands."""
    order = np.lexsort((u.letters.hashes, u.rows))
    rows, hashes = u.rows[order], u.letters.hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new], order[new]


def _by_label(pieces: list[Units], y: np.ndarray, label: int) -> Iterator[tuple[bytes, int]]:
    """The distinct units of documents with a label, and in how many of them each is."""
    hashes, places, numbers, done = [], [], [], 0
    for u in pieces:
        rows, own, at = _pairs(u)
        mine = y[done + rows] == label
        own, where, n = np.unique(own[mine], return_index=True, return_counts=True)
        hashes.append(own)
        places.append(at[mine][where])
        numbers.append(n)
        done += u.count
    begins = np.cumsum([0, *map(len, hashes)])
    _, first, back = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_index=True, return_inverse=True)
    total = np.bincount(back, np.concatenate([*numbers, np.zeros(0, np.int64)]), minlength=len(first)).astype(np.int64)
    piece = np.searchsorted(begins, first, "right") - 1
    for k, i, n in zip(piece.tolist(), (first - begins[piece]).tolist(), total.tolist(), strict=True):
        yield pieces[k].text(places[k][i])[1:-1], n


def _usual(pieces: list[Units], y: np.ndarray, most: int) -> list[bytes]:
    """Units of fitting length that the most clean documents hold."""
    held, done = [], 0
    for u in pieces:
        rows, hashes, at = _pairs(u)
        sizes = u.letters.ends[at] - u.letters.starts[at]
        held.append(hashes[(y[done + rows] == 0) & (sizes >= 4) & (sizes <= LANDMARK_BYTES - 2)])
        done += u.count
    values, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
    top = np.lexsort((values, -n))[:most]
    wanted = dict(zip(values[top].tolist(), n[top].tolist(), strict=True))
    names: dict[bytes, int] = {}
    for u in pieces:
        here, where = np.unique(u.letters.hashes, return_index=True)
        names.update((u.text(where[i])[1:-1], wanted[int(here[i])]) for i in np.flatnonzero(np.isin(here, values[top])))
    return sorted(names, key=lambda x: (-names[x], x))


def affixes(unit: bytes) -> set[bytes]:
    """Starts and ends of 4 to 9 bytes, with a mark of the word's edge."""
    whole = b"\x02" + unit + b"\x03"
    longest = LANDMARK_BYTES - 1
    out = {whole[:n] for n in range(5, longest) if n < len(whole)} | {whole[-n:] for n in range(5, longest) if n < len(whole)}
    if 6 <= len(whole) <= LANDMARK_BYTES:
        out.add(whole)
    return out


def fit_machine(parts: list[np.ndarray], labels: list[np.ndarray], penalty: float = 1.0, rounds: int = 25, start: np.ndarray | None = None, times: list[np.ndarray] | None = None) -> np.ndarray:
    """Primal support vector machine with squared hinge loss, by Newton steps over parts of the rows; the last weight is the offset.

    A row counts as often as ``times`` tells, once if that is not given.
    Between rounds only rows that come to lie inside the margin, or leave it, change the sums.
    """
    times = [np.ones(len(y)) for y in labels] if times is None else times
    size = parts[0].shape[1] + 1
    w = np.zeros(size) if start is None else start
    curve, pull = penalty * np.eye(size), np.zeros(size)
    curve[-1, -1] = 1e-6
    active = [np.zeros(len(y), dtype=bool) for y in labels]
    for _ in range(rounds):
        for part, y, n, was in zip(parts, labels, times, active, strict=True):
            now = y * (part @ w[:-1] + w[-1]) < 1
            for changed, sign in ((now & ~was, 1), (was & ~now, -1)):
                if changed.any():
                    own = np.hstack([part[changed], np.ones((int(changed.sum()), 1))])
                    each = sign * own * n[changed, None]
                    curve += own.T @ each
                    pull += each.T @ y[changed]
            was[:] = now
        new = np.linalg.solve(curve, pull)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def with_products(x: np.ndarray) -> np.ndarray:
    """Features and the products of any two of them."""
    return np.hstack([x, *(x[:, i, None] * x[:, i:] for i in range(x.shape[1]))])


def fit_calibration(x: np.ndarray, y: np.ndarray, clean_weight: float = CLEAN_WEIGHT, rounds: int = 50) -> np.ndarray:
    """Logistic regression, in which rows with y = 0 count ``clean_weight``; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    each = np.where(y > 0, 1.0, clean_weight)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (each * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None] | pa.Array, toxic: list[int], level: float = LEVEL) -> Model:
    """Fit on whole texts with labels.

    Distinct sentences are the examples of the machine and have the label that
    most documents with them have; sentences of toxic documents without an insult are noise that the
    clean ones outvote.  What a first machine finds is an example again with one and two letters put into
    it.  Documents, those with letters put into what is found too, are then calibrated by logistic regression.
    """
    texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
    pieces = [compact(units(words, count)) for _, count, words in split_words(texts, NOT_SPACE, hashed=False)]
    del texts
    y = np.array(toxic, np.float64)
    flat = (np.zeros(FEATURES), np.ones(FEATURES))
    none = np.zeros(FEATURES + FEATURES * (FEATURES + 1) // 2)
    rate = np.log((y.sum() + 1) / (len(y) - y.sum() + 2))  # without examples nothing is called toxic
    if not len(y) or y.min() == y.max():
        return Model([], np.zeros(0), 0.0, np.append(none, rate), flat)
    fresh = fresh_units(pieces)
    marks = choose_landmarks([only(u, f) for u, f in zip(pieces, fresh, strict=True)], y, level)
    if not marks:
        return Model([], np.zeros(0), 0.0, np.append(none, rate), flat)
    model = Model(marks, np.zeros(len(marks)), 0.0, np.append(none, 0.0), flat)
    gram = similarity(marks, model.index, model.own)
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))[None, :]  # Nystroem map of kernel values
    # the kernel of every distinct unit with all landmarks is computed once
    names: dict[bytes, int] = {}
    which = []
    for u in pieces:
        here, back = u.letters.distinct()
        which.append(np.array([names.setdefault(x, len(names)) for x in here], np.int32)[back] if here else np.zeros(0, np.int32))
    every = list(names)
    sentences = distinct_sentences(pieces, y, fresh)
    pieces = [without_letters(u) for u in pieces]
    del names, fresh
    give_back()
    kernel = mapped_file((len(every), len(marks)))
    for a in range(0, len(every), 4 * BLOCK_UNITS):
        kernel[a : a + 4 * BLOCK_UNITS] = similarity([edged(x) for x in every[a : a + 4 * BLOCK_UNITS]], model.index, model.own)
    rows, labels, held = [], [], []
    for u, s, ids in zip(pieces, sentences, which, strict=True):
        ids = ids[of_sentences(s, len(u.rows))]
        begins = np.cumsum(np.append(0, np.diff(np.append(s.begins, len(u.rows)))[s.chosen]))
        for a in range(0, len(s.chosen), BLOCK_SENTENCES):
            at = begins[a : a + BLOCK_SENTENCES + 1]
            held.append((ids[at[0] : at[-1]], at - at[0]))
            rows.append(mapped(lambda which, own=held[-1][0]: halves(kernel, own[which]), at - at[0], root))
            labels.append(2 * s.labels[a : a + BLOCK_SENTENCES] - 1)
    give_back()
    w = fit_machine(rows, labels)
    more, times = virtual_examples(every, kernel, model, held, rows, labels, root, w)
    w = fit_machine(rows + [x for x, _ in more], labels + [x for _, x in more], start=w, times=times + [np.ones(len(x)) for _, x in more])
    model.weights, model.offset = root @ w[:-1], float(w[-1])
    del rows, more, held
    give_back()
    scores = [unit_values(kernel, model.weights)]
    del kernel
    found = np.flatnonzero(scores[0] > UNIT_FLOOR)
    for letters in PUT_IN:  # documents with letters in what is found calibrate as well
        scores.append(scores[0].copy())
        scores[-1][found] = similarity([edged(varied(every[i], letters)) for i in found], model.index, model.own) @ model.weights
    x = np.concatenate([model.features(u, known[ids]) for known in scores for u, ids in zip(pieces, which, strict=True)])
    model.scale = (x.mean(0), np.maximum(x.std(0), 1e-6))
    model.calibration = fit_calibration(with_products((x - model.scale[0]) / model.scale[1]), np.tile(y, len(scores)))
    return model


def mapped_file(shape: tuple[int, int]) -> np.ndarray:
    """A matrix of zeros in a nameless temporary file, which the system may page out and which goes with the matrix."""
    with tempfile.TemporaryFile() as f:
        return np.asarray(np.memmap(f, np.float16, "w+", shape=shape))


def halves(kernel: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Some rows of a matrix of two-byte numbers."""
    return _HALF[kernel[at].view(np.uint16)]


def mapped(rows_of: Callable[[np.ndarray], np.ndarray], begins: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The Nystroem map of sentences: ``rows_of`` gives the units' rows, of which a sentence's begin at ``begins`` (which has the end, too)."""
    sizes = np.diff(begins)
    longest = np.argsort(-sizes, kind="stable")
    total = np.zeros((len(sizes), len(root)), np.float32)
    for k in range(int(sizes.max(initial=0))):  # the first unit of each sentence, then the second
        n = int((sizes > k).sum())
        total[:n] += rows_of(begins[longest[:n]] + k)
    out = np.empty_like(total)
    out[longest] = total.astype(np.float64) @ root
    return out


def unit_values(kernel: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What units add, by their kernel with the landmarks."""
    return np.concatenate([halves(kernel, slice(a, a + BLOCK_UNITS)) @ weights for a in range(0, len(kernel), BLOCK_UNITS)] or [np.zeros(0)])


def virtual_examples(every: list[bytes], kernel: np.ndarray, model: Model, held: list[tuple[np.ndarray, np.ndarray]], rows: list[np.ndarray], labels: list[np.ndarray], root: np.ndarray, w: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Sentences that a first machine finds, and clean ones inside its margin, once more for each of PUT_IN, with letters put into the units that speak for toxicity.

    Returns the sentences that this changes, with their labels, and how often each row counts: those that it leaves as they are count again and are not copied.
    """
    found = np.flatnonzero(unit_values(kernel, root @ w[:-1]) > UNIT_FLOOR)
    new = {n: similarity([edged(varied(every[i], n)) for i in found], model.index, model.own) for n in PUT_IN}
    place = np.full(len(every), -1, np.int64)
    place[found] = np.arange(len(found))
    out, times = [], []

    def changed(own: np.ndarray, n: int) -> np.ndarray:
        values, at = halves(kernel, own), place[own]
        values[at >= 0] = new[n][at[at >= 0]]
        return values

    for (ids, begins), x, y in zip(held, rows, labels, strict=True):
        near = x @ w[:-1] + w[-1] > np.where(y > 0, 0, -1)
        sizes = np.diff(begins)
        touched = np.bincount(np.repeat(np.arange(len(sizes)), sizes), place[ids] >= 0, len(sizes)) > 0
        some = (near & touched).any()  # of a part in which nothing changes no row counts again
        times.append(1.0 + len(PUT_IN) * (some & near & ~touched))
        near &= touched
        own = ids[np.repeat(near, sizes)]
        for n in PUT_IN if some else ():
            out.append((mapped(lambda at, own=own, n=n: changed(own[at], n), np.cumsum(np.append(0, sizes[near])), root), y[near]))
    return out, times


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample_docs`` labelled documents and ``sample_bytes`` of text that are not held out, in one task, which returns the model alone.

    The sample is drawn by a hash of the id.  An id with several labels is toxic
    if one of them says so; null ids and labels, and null texts, are no
    examples.  Without examples of both kinds the model knows their rate alone.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    )
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes // 16).join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs)
    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).coalesce(1).mapInArrow(lean(_fitter(sample_bytes)), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [])


def _fitter(sample_bytes: int):
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier tasks of this worker left
        texts, toxic, size = [], [], 0
        for batch in batches:
            ends = size + np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
            part = batch.slice(0, int(np.searchsorted(ends, sample_bytes, "right")))
            texts.append(part["text"])
            toxic += part["toxic"].to_pylist()
            size = ends[-1] if len(ends) else size
        model = cloudpickle.dumps(fit(pa.chunked_array(texts, pa.string()).combine_chunks(), toxic))
        del texts
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    return fitted


def _scorer(sent, inside: str | None):
    """``inside``: the field of the rows that is the text; else the text stands beside them."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(sent)
        for batch in batches:
            texts = batch["text"] if inside is None else batch["row"].field(inside)
            parts = [model.scores(units(words, count)) for _, count, words in split_words(texts, NOT_SPACE, hashed=False, piece=SMALL_PIECE)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(np.concatenate([*parts, np.zeros(0)]), pa.float64())], names=["row", "score"])

    return score


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to the columns ``carry`` of ``docs`` (all by default).

    Only the text enters the score.  Words are reduced to letters (signs and
    digits that look like letters count as such, words spelled in single letters
    are joined), and the kernel tolerates letters put in or left out.  Null and
    empty texts get the score of a text without words; texts of any length are
    scored whole; equal texts have equal scores; no rows give no rows.  Columns
    named score or predicted, in any case, are replaced.
    """
    sent = send(docs.sparkSession, model)
    work = docs.select(packed(docs, ("score", "predicted"), carry).alias("row"), named(text_col).alias("text"))
    inside = text_col if work.schema["row"].dataType.names.count(text_col) == 1 and work.schema["row"].dataType[text_col].dataType == T.StringType() else None
    work = work if inside is None else work.select("row")  # a text that is carried goes to the workers once
    out = work.mapInArrow(lean(_scorer(sent, inside)), T.StructType([work.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.select(*unpacked(out), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
