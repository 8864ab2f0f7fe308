"""Distinct sampled segmentations by Gumbel top-k without replacement, and decoding.

A text is normalised by its SentencePiece model and cut into words (a run of ▁ and what follows up to the next
one; no piece reaches over that border). Each word is a lattice of pieces, characters outside
the vocabulary being their bytes. A piece's weight is its smoothed log frequency in the model's own
segmentation of all texts. Backward sums make every step of a path a proper distribution, so that all
segmentations of a text form a tree whose leaves' probabilities sum to one.

Perturbed A-star: the root's Gumbel variable is the maximum over all leaves. The best leaf of a set is drawn step
by step; what each step leaves aside is a set of its own, whose maximum is a Gumbel variable at the log of the set's
mass, cut off at the maximum above it. The queue pops the set with the highest maximum: the
next best segmentation, without replacement. With kappa the best perturbed value beyond the k samples, a
sample's inclusion probability is 1 - exp(-exp(log_prob - kappa)).

All random numbers are hashes of (seed, row key, path, word, step), so a row gets the same samples anywhere; the row key
counts as 64 bits. The texts of a batch take their steps together, and a worker keeps the lattices of the words that it
has met, up to KEPT_STATES characters.

Defined results: a text of any length is sampled whole, alone in its batch if it is longer than one; null and empty texts have one segmentation, the empty one, with inclusion 1; texts
with fewer than k segmentations return all they have; rows without a key count as key null and rows that repeat
a key and text get equal samples; an empty table gives an empty result; other columns do no harm.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, mix
from .word_ids import text_batches

SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


#: Stands before a word that no ▁ leads. Normalised texts hold no such space.
UNLED = " "


def bare_words(model, text: str) -> list[str]:
    """The words without the ▁ that leads each of them; those that none leads after UNLED."""
    own = model.normalize(text)
    if own.startswith(SPACE) and SPACE * 2 not in own:
        return own[1:].split(SPACE)
    return [w[1:] if w[0] == SPACE else UNLED + w for w in _WORD.findall(own)]


def whole_word(bare: str) -> str:
    return bare[1:] if bare[:1] == UNLED else SPACE + bare


def words_of(model, text: str) -> list[str]:
    return list(map(whole_word, bare_words(model, text)))


# ------------------------------------------------------------------ weights


def count_pieces(path: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _LATTICES.clear()  # other weights will follow
        model, words = processor(path), Counter()
        total = np.zeros(model.get_piece_size(), np.int64)

        def settle() -> None:
            own = list(words)
            for first in range(0, len(own), 50_000):
                part = own[first : first + 50_000]
                ids = model.encode([w.replace(SPACE, " ") if SPACE in w else w for w in part], num_threads=1)
                number = np.repeat([words[w] for w in part], [len(x) for x in ids])
                total[:] += np.bincount(np.fromiter(chain.from_iterable(ids), np.int32, len(number)), number, len(total)).astype(np.int64)
            words.clear()

        for batch in rows:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(bare_words(model, text))
            if len(words) > 600_000:
                settle()
        settle()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return run


def piece_weights(docs: DataFrame, path: str, text: str = "text") -> np.ndarray:
    """Log of the smoothed frequency of each piece in all texts."""
    table = in_arrow(docs.select(text), count_pieces(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(processor(path).get_piece_size(), 0.5)
    counts[table["id"].to_numpy()] += table["n"].to_numpy()
    return np.log(counts / counts.sum())


# ------------------------------------------------------------------ lattices

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash_steps(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h ^ (code.astype(np.uint64) + np.uint64(1))) * _BASE ^ (h >> np.uint64(29))


class Vocabulary:
    """Pieces and their beginnings by hashes of their characters; weights; the bytes' pieces."""

    def __init__(self, path: str, weights: np.ndarray):
        self.model, self.weights = processor(path), weights
        size = self.model.get_piece_size()
        usable = [k for k in range(size) if not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_unused(k) or self.model.is_byte(k))]
        self.bytes = {int(self.model.id_to_piece(k)[3:5], 16): k for k in range(size) if self.model.is_byte(k)}
        self.spelled: dict[str, list[int]] = {}
        pieces = [self.model.id_to_piece(k) for k in usable]
        self.longest = max(map(len, pieces))
        points = np.zeros((len(pieces), self.longest), np.int64)
        for j, piece in enumerate(pieces):
            points[j, : len(piece)] = list(map(ord, piece))
        h, size_of, spelled = np.zeros(len(pieces), np.uint64), np.array([len(x) for x in pieces]), []
        for k in range(self.longest):
            live = np.flatnonzero(size_of > k)
            h[live] = _hash_steps(h[live], points[live, k])
            spelled.append((mix(h[live]), np.where(size_of[live] == k + 1, np.array(usable)[live], -1)))
        hashes, ids = (np.concatenate(x) for x in zip(*spelled))
        order = np.lexsort((-ids, hashes))  # of a piece that is a beginning too, the piece
        hashes, ids = hashes[order], ids[order]
        own = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        self.keys, self.ids = hashes[own], ids[own].astype(np.int32)
        bits = int(np.ceil(np.log2(len(self.keys) * 2.5)))
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        for j, at in enumerate((self.keys >> self.shift).astype(int).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) & self.last
            self.slots[at] = j

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, -1 for beginnings of pieces that are none, -2 for all else."""
        at = (hashes >> self.shift).astype(np.int64)
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != hashes))
        at = at[left]
        while len(left):
            at = (at + 1) & self.last
            got = self.slots[at]
            found[left] = got
            on = (got >= 0) & (self.keys[got] != hashes[left])
            left, at = left[on], at[on]
        return np.where(found >= 0, self.ids[found], -2)

    def byte_ids(self, char: str) -> list[int]:
        if char not in self.spelled:
            self.spelled[char] = [self.bytes.get(b, self.model.unk_id()) for b in char.encode("utf-8", "surrogatepass")]
        return self.spelled[char]


#: Characters of texts that are sampled at once; a longer text alone.
TOGETHER = 1 << 19
#: States of a worker's lattices, beyond which it starts anew.
KEPT_STATES = 4_000_000
#: Characters of new words whose lattices are made at once.
ADDED = 1 << 16


class Lattices:
    """The lattices of words as flat tables that grow with the words met.

    A word's states are its characters in order, from `base` to `end`. The edges of state s, longer pieces first, are
    those from first[s] to first[s + 1]: piece (-1: the character's bytes), length in characters, log probability, and
    upto, the probability of the edges up to this one. What lies beyond `words`, `states` and `edges` is not set."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}
        self.words = self.states = self.edges = 0  # used of the tables, which have room for more
        self.base, self.end = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.first = np.zeros(1, np.int32)
        self.piece, self.length = np.zeros(1, np.int32), np.zeros(1, np.min_scalar_type(vocabulary.longest))
        self.log_prob, self.upto = np.zeros(1, np.float32), np.zeros(1, np.float32)
        self.unknown: dict[int, list[int]] = {}  # ids of the bytes, by edge

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each bare word; new ones get their lattices."""
        out = list(map(self.known.get, words))
        if None in out:
            missing = [k for k, x in enumerate(out) if x is None]
            new = list(dict.fromkeys([words[k] for k in missing]))
            self.known.update(zip(new, range(self.words, self.words + len(new))))
            new = list(map(whole_word, new))
            for a, b in text_batches(new, ADDED):
                self._add(new[a:b])
            for k in missing:
                out[k] = self.known[words[k]]
        return np.array(out, np.int64)

    def _add(self, words: list[str]) -> None:
        vocabulary, states, edges = self.vocabulary, self.states, self.edges
        length = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(length)
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, width = len(code), min(vocabulary.longest, int(length.max(initial=1)))
        stop = np.repeat(end, length)
        live, h, hits, count = np.arange(n), np.zeros(n, np.uint64), [], np.zeros(n, np.int64)
        for k in range(width):
            if k:
                inside = np.flatnonzero(live + k < stop[live])
                live, h = live[inside], h[inside]
            h = _hash_steps(h, code[live + k])
            found = vocabulary.find(mix(h))
            hit = np.flatnonzero(found >= 0)
            own, ids = live[hit], found[hit]
            on = np.flatnonzero(found > -2)  # no piece begins like the others
            live, h = live[on], h[on]
            if k == 0:  # characters that are no piece
                odd = np.flatnonzero(np.bincount(own, minlength=n) == 0)
                own, ids = np.concatenate([own, odd]), np.concatenate([ids, np.full(len(odd), -1, np.int32)])
            count[own] += 1
            hits.append((own, ids))
        first = np.concatenate([[0], np.cumsum(count)])
        total_edges, at = int(first[-1]), first[:-1].copy()
        piece, size = np.empty(total_edges, np.int32), np.empty(total_edges, np.int64)
        for k in reversed(range(len(hits))):  # longer pieces first: they are likelier, so that few steps look further
            own, ids = hits[k]
            piece[at[own]], size[at[own]] = ids, k + 1
            at[own] += 1
        weight = vocabulary.weights[piece]
        for s in odd.tolist():
            weight[first[s + 1] - 1] = vocabulary.weights[vocabulary.byte_ids(text[s])].sum()
        # Backward sums, one distance from the words' ends after the other.
        distance = stop - np.arange(n)
        order = np.argsort(distance.astype(np.int16) if len(distance) and distance.max() < 1 << 15 else distance, kind="stable")
        number = count[order]
        ends = np.cumsum(number)
        edge = np.repeat(first[order] - (ends - number), number) + np.arange(total_edges)
        cut = np.searchsorted(distance[order], np.arange(1, int(length.max(initial=0)) + 2))
        total, target = np.zeros(n + 1), np.repeat(np.arange(n), count) + size
        for r, (low, high) in enumerate(zip(cut[:-1], cut[1:]), 1):
            if low == high:
                continue
            begin = ends[low:high] - number[low:high]
            own = edge[begin[0] : ends[high - 1]]
            value = weight[own] + np.where(size[own] == r, 0.0, total[target[own]])
            top = np.maximum.reduceat(value, begin - begin[0])
            whole = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, number[low:high])), begin - begin[0]))
            total[order[low:high]] = whole
            weight[own] = value - np.repeat(whole, number[low:high])
        log_prob = weight.astype(np.float32)
        probability, upto, held = np.exp(log_prob, dtype=np.float64), np.empty(total_edges, np.float32), np.zeros(n)
        for k in range(int(count.max(initial=0))):  # each state on its own, so that no other word changes its rounding
            own = np.flatnonzero(count > k)
            held[own] += probability[first[own] + k]
            upto[first[own] + k] = held[own]
        upto[first[1:] - 1] = np.inf
        for s in odd.tolist():
            self.unknown[edges + int(first[s + 1]) - 1] = vocabulary.byte_ids(text[s])
        self._append(self.words, base=end - length + states, end=end + states)
        self._append(states + 1, first=first[1:] + edges)
        self._append(edges, piece=piece, length=size, log_prob=log_prob, upto=upto)
        self.words, self.states, self.edges = self.words + len(words), states + n, edges + total_edges

    def _append(self, at: int, **columns: np.ndarray) -> None:
        for name, values in columns.items():
            table = getattr(self, name)
            if at + len(values) > len(table):
                longer = np.empty(len(table) + at + len(values), table.dtype)  # memory is taken as it fills
                longer[:at] = table[:at]
                table = longer
                setattr(self, name, table)
            table[at : at + len(values)] = values

    def left_by(self, edge: int) -> int:
        """The state that an edge leaves."""
        return int(np.searchsorted(self.first[: self.states + 1], np.int32(edge), "right")) - 1

    def step(self, state: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """Edges drawn."""
        edge = self.first[state]
        live = np.flatnonzero(self.upto[edge] <= uniform)
        own, uniform = edge[live], uniform[live]
        while len(live):
            own += 1
            edge[live] = own
            on = np.flatnonzero(self.upto[own] <= uniform)
            live, own, uniform = live[on], own[on], uniform[on]
        return edge


def salted(key: np.ndarray, *salts) -> np.ndarray:
    """64-bit hashes of keys and salts."""
    h = np.asarray(key, np.uint64)
    for salt in salts:
        h = mix(h * np.uint64(5) + np.asarray(salt).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return h


def uniforms(key: np.ndarray, *salts) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((salted(key, *salts) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _steps(base: np.ndarray, count: int) -> np.ndarray:
    """Numbers in [0, 1) of 24 bits from 32-bit hashes, one for each step of a word."""
    h = base + np.uint32(count * 0x9E3779B1 & 0xFFFFFFFF)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return (h >> np.uint32(8)).astype(np.float32) * np.float32(2.0**-24)


def draw(lattices: Lattices, word_of: np.ndarray, base: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segmentations of word instances: word, 32-bit hash for its random numbers, state to start from. Instance and edge of
    each step, by instance."""
    live, count, parts, end = np.arange(len(word_of), dtype=np.int32), 0, [], lattices.end[word_of]
    on = np.flatnonzero(state < end)
    if len(on) < len(live):
        live, state, end, base = live[on], state[on], end[on], base[on]
    while len(live):
        uniform = _steps(base, count)
        edge = lattices.step(state, uniform)
        parts.append((live, edge))
        state = state + lattices.length[edge]
        on = np.flatnonzero(state < end)
        live, state, end, base = live[on], state[on], end[on], base[on]
        count += 1
    number = np.zeros(len(word_of), np.int32)
    for own, _ in parts:
        number[own] += 1
    at, out = (np.cumsum(number) - number).astype(np.int32), np.zeros(int(number.sum()), np.int32)
    for own, edge in parts:
        place = at[own]
        out[place] = edge
        at[own] = place + np.int32(1)
    return np.repeat(np.arange(len(word_of), dtype=np.int32), number), out


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(x, 0.0)))


def _cut_gumbel(place: np.ndarray, limit: np.ndarray | float, uniform: np.ndarray) -> np.ndarray:
    """Gumbel variables at `place`, given that they are under `limit`."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(place), -np.inf, place - np.logaddexp(place - limit, np.log(-np.log(uniform))))


#: Steps whose prefix has a log probability under this wait together as one set until it is popped.
FAR = -25.0


class Search:
    """One text's samples so far, and a queue of the sets that they leave aside.

    A sample: word number and edge of each step, log probability, perturbed value. A set in the queue: -value, order of
    entry, sample, step, and lengths used up there besides the sample's own (None: all sets from that step on)."""

    def __init__(self, key: np.uint64):
        self.key, self.found, self.queue, self.entered = np.array([key], np.uint64), [], [], 0

    def push(self, values, parent: int, steps, used: list) -> None:
        for value, step, own in zip(values, steps, used):
            if value > -np.inf:
                self.entered += 1
                heapq.heappush(self.queue, (-value, self.entered, parent, step, own))

    def pop(self, lattices: Lattices) -> tuple[float, int, int, frozenset] | None:
        """Value, sample, step and used lengths of the best set; a far one is first told apart into its steps."""
        while self.queue:
            value, order, parent, at, used = heapq.heappop(self.queue)
            if used is not None:
                return -value, parent, at, used
            log_prob = lattices.log_prob[self.found[parent][1]].astype(np.float64)
            far = np.sum(log_prob[:at]) + np.concatenate([[0.0], np.cumsum(log_prob[at:-1])]) + _log1mexp(log_prob[at:])
            sums = np.exp(far - far.max()).cumsum()
            values = _cut_gumbel(far, -value, uniforms(self.key, (1 << 44) + order, np.arange(len(far))))
            values[int(np.searchsorted(sums, uniforms(self.key, (1 << 45) + order)[0] * sums[-1], "right"))] = -value
            self.push(values.tolist(), parent, range(at, at + len(far)), [frozenset()] * len(far))
        return None

    def best(self) -> float:
        """The perturbed value of the best segmentation that is not among the samples."""
        return -self.queue[0][0] if self.queue else -np.inf


def settle(lattices: Lattices, searches: list[Search], paths: list[tuple], k: int, width: int = 128) -> None:
    """Takes a path for each search and puts the sets that it leaves aside into its queue.

    paths: word numbers, edges, value, step from which sets are left aside, lengths used up there (empty: the path's own
    only). All searches are dealt with at once, `width` steps each; the few that need more come again."""
    size = np.array([len(p[1]) for p in paths], np.int64)
    end = np.cumsum(size)
    log_prob = lattices.log_prob[np.concatenate([np.zeros(0, np.int32), *[p[1] for p in paths]])].astype(np.float64)
    begin = end - size

    def summed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of ranges, each on its own, so that no other text changes their rounding."""
        out, some = np.zeros(len(first)), np.flatnonzero(last > first)
        if len(some):
            out[some] = np.add.reduceat(np.append(log_prob, 0.0), np.column_stack([first[some], last[some]]).ravel())[::2]
        return out

    whole = summed(begin, end)
    number = np.array([len(s.found) for s in searches], np.int64)
    for search, path, total in zip(searches, paths, whole.tolist()):
        search.found.append((path[0], path[1], total, path[2]))
    key = np.concatenate([s.key for s in searches])
    limit, start = np.array([p[2] for p in paths]), np.array([p[3] for p in paths], np.int64)
    left, prefix = np.flatnonzero(start < size), summed(begin, begin + start)
    while len(left):
        own_start, own_size = start[left], size[left]
        width = min(width, int((own_size - own_start).max()))
        place = own_start[:, None] + np.arange(width + 1)
        inside = place[:, :-1] < own_size[:, None]
        lp = np.where(inside, log_prob[np.minimum(begin[left][:, None] + place[:, :-1], len(log_prob) - 1)], 0.0)
        before = prefix[left][:, None] + np.concatenate([np.zeros((len(lp), 1)), np.cumsum(lp, 1)[:, :-1]], 1)
        count = np.minimum((before > FAR).sum(1) + 1, own_size - own_start)  # the steps that matter are few
        whole_window = (count <= width)
        some = np.flatnonzero(whole_window)
        rows, lp, before, count, place = left[some], lp[some], before[some], count[some], place[some]
        aside = np.full((len(rows), width + 1), -np.inf)
        near = np.arange(width) < count[:, None]
        aside[:, :-1][near] = before[near] + _log1mexp(lp[near])
        for x, j in enumerate(rows.tolist()):
            if paths[j][4]:  # what the lengths used up leave of the first step
                edge = int(paths[j][1][paths[j][3]])
                mass, lengths = edges_of(lattices, edge)
                rest = float(mass.sum() - sum(m for m, n in zip(mass.tolist(), lengths) if n in paths[j][4] or n == lattices.length[edge]))
                aside[x, 0] = before[x, 0] + np.log(rest) if rest > 1e-12 else -np.inf
        x = np.flatnonzero(start[rows] + count < size[rows])
        reached = before[x, count[x] - 1] + lp[x, count[x] - 1]
        aside[x, count[x]] = reached + _log1mexp(np.minimum(whole[rows[x]] - reached, 0.0))
        far = np.full(len(rows), -1)
        far[x] = count[x]
        values = _cut_gumbel(aside, limit[rows][:, None], uniforms(key[rows][:, None], (1 << 41) + number[rows][:, None], place))
        top = np.argpartition(-values, min(k, width), 1)[:, : k + 1] if width >= k else np.tile(np.arange(width + 1), (len(rows), 1))
        best, steps = np.take_along_axis(values, top, 1).tolist(), np.take_along_axis(place, top, 1).tolist()
        for j, value, step, column, apart in zip(rows.tolist(), best, steps, top.tolist(), far.tolist()):
            used = [None if c == apart else (paths[j][4] | {int(lattices.length[paths[j][1][start[j]]])}) if c == 0 else frozenset() for c in column]
            searches[j].push(value, int(number[j]), step, used)
        left, width = left[~whole_window], width * 4


def edges_of(lattices: Lattices, edge: int) -> tuple[np.ndarray, list[int]]:
    """Probabilities and lengths of all edges of the state that an edge leaves."""
    state = lattices.left_by(edge)
    low, high = lattices.first[state], lattices.first[state + 1]
    return np.exp(lattices.log_prob[low:high].astype(np.float64)), lattices.length[low:high].tolist()


def ids_of(lattices: Lattices, paths: list[np.ndarray]) -> list[np.ndarray]:
    """The ids of each path of edges."""
    edges = np.concatenate([np.zeros(0, np.int32), *paths])
    ids, number = lattices.piece[edges], np.ones(len(edges), np.int64)
    odd = np.flatnonzero(ids < 0)
    spelled = [lattices.unknown[e] for e in edges[odd].tolist()]
    number[odd] = [len(x) for x in spelled]
    out, ends = np.repeat(ids, number), np.concatenate([[0], np.cumsum(number)])[np.cumsum([0, *map(len, paths)])]
    out[out < 0] = list(chain.from_iterable(spelled))
    return [out[a:b] for a, b in zip(ends[:-1], ends[1:])]


def row_key(seed: int, key) -> int:
    """64 bits that stand for a row in all random numbers."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def sample_texts(lattices: Lattices, keys: list, texts: list[str], k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, best first: ids, log probability, perturbed value, log inclusion probability."""
    split = [bare_words(lattices.vocabulary.model, t) if t else [] for t in texts]
    if lattices.states > KEPT_STATES:
        lattices.__init__(lattices.vocabulary)
    word_of = lattices.numbers(list(chain.from_iterable(split)))
    sizes = np.array([len(x) for x in split], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    key = np.array([row_key(seed, x) for x in keys], np.uint64)
    hashed = salted(key, 0)

    def drawn(rows: np.ndarray, words: np.ndarray, states: np.ndarray, salt: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Free paths of texts from a word and state (-1: the word's first) on, all at once: word numbers and edges."""
        first = starts[rows] + words
        n = ends[rows] - first
        at = np.cumsum(n) - n
        number = (np.arange(int(n.sum())) - np.repeat(at - words, n)).astype(np.int32)  # of each word in its text
        own = word_of[number + np.repeat(starts[rows], n)]
        state = lattices.base[own]
        state[at[states >= 0]] = states[states >= 0]
        instance, edge = draw(lattices, own, salted(np.repeat(salted(hashed[rows], salt), n), number).astype(np.uint32), state)
        low = np.searchsorted(instance, np.append(at, len(own)))
        number = number[instance]
        return [(number[a:b], edge[a:b]) for a, b in zip(low[:-1], low[1:])]

    searches = [Search(x) for x in key]
    rows = np.arange(len(texts))
    none = np.zeros(len(texts), np.int64)
    value = -np.log(-np.log(uniforms(key, 1 << 40)))
    paths = [(w, e, v, 0, frozenset()) for (w, e), v in zip(drawn(rows, none, none - 1, none), value.tolist())] if len(texts) else []
    for rank in range(k):
        if not len(rows):
            break
        settle(lattices, [searches[j] for j in rows], paths, k)
        if rank == k - 1:
            break
        popped = [(j, searches[j].pop(lattices)) for j in rows.tolist()]
        popped = [(j, x) for j, x in popped if x is not None]
        rows = np.array([j for j, _ in popped], np.int64)
        number = np.array([len(searches[j].found) for j in rows], np.int64)
        chosen, asked = [], []
        for (j, (_, parent, at, used)), u in zip(popped, uniforms(key[rows], (1 << 42) + number).tolist()):
            words, edges, _, _ = searches[j].found[parent]
            edge = int(edges[at])
            mass, lengths = edges_of(lattices, edge)
            used = used | {int(lattices.length[edge])}
            sums = np.where([n in used for n in lengths], 0.0, mass).cumsum()
            state = lattices.left_by(edge)
            picked = min(int(np.searchsorted(sums, u * sums[-1], "right")), len(sums) - 1)
            chosen.append((int(lattices.first[state]) + picked, used))
            asked.append((int(words[at]), state + lengths[picked]))
        paths = []
        if popped:
            word, state = (np.array(x, np.int64) for x in zip(*asked))
            for (j, (best, parent, at, _)), (edge, used), w, (words, edges) in zip(popped, chosen, word.tolist(), drawn(rows, word, state, (1 << 43) + number)):
                old_words, old_edges, _, _ = searches[j].found[parent]
                paths.append((np.concatenate([old_words[:at], np.array([w], np.int32), words]), np.concatenate([old_edges[:at], np.array([edge], np.int32), edges]), best, at, used))
    ids = iter(ids_of(lattices, [x[1] for search in searches for x in search.found]))
    out = []
    for search in searches:
        kappa, samples = search.best() if len(search.found) == k else -np.inf, []
        for _, _, log_prob, value in search.found:
            over = math.exp(min(log_prob - kappa, 50.0))
            samples.append((next(ids), log_prob, value, math.log(-math.expm1(-over)) if over > 1e-12 else log_prob - kappa))
        out.append(samples)
    return out


_LATTICES: dict[tuple[str, str], Lattices] = {}


def _lattices(path: str, weights: np.ndarray) -> Lattices:
    """One for each Python worker and table of weights, kept between its tasks."""
    name = (path, hashlib.blake2b(weights.tobytes(), digest_size=8).hexdigest())
    if name not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[name] = Lattices(Vocabulary(path, weights))
    return _LATTICES[name]


SAMPLES = "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, log_inclusion double"


def sampler(spark: SparkSession, path: str, weights: np.ndarray, k: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns batches of keys and texts into SAMPLES batches."""
    shared = spark.sparkContext.broadcast(weights)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(path, shared.value)
        for batch in rows:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in text_batches(texts, TOGETHER):
                found = sample_texts(lattices, keys[first:last], texts[first:last], k, seed)
                flat = [(key, r + 1, *s) for key, samples in zip(keys[first:last], found) for r, s in enumerate(samples)]
                ends = np.concatenate([[0], np.cumsum([len(x[2]) for x in flat])]).astype(np.int32)
                ids = np.concatenate([np.zeros(0, np.int32), *[x[2] for x in flat]]).astype(np.int32)
                names, ranks, _, *numbers = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ranks, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), *[pa.array(x, pa.float64()) for x in numbers]], ["doc_id", "rank", "ids", "log_prob", "perturbed", "log_inclusion"])

    return run


def keyed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def sample(docs: DataFrame, path: str, weights: np.ndarray, k: int = 3, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SAMPLES rows: up to k distinct segmentations of each text, ranks from 1."""
    return in_arrow(keyed_texts(docs, doc_id, text), sampler(docs.sparkSession, path, weights, k, seed), SAMPLES)


def decode(samples: DataFrame, path: str, ids: str = "ids", output: str = "text") -> DataFrame:
    """All columns of samples and the text that the ids stand for."""
    position = samples.columns.index(ids)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(path)
        for batch in rows:
            texts = [None if x is None else model.decode(x) for x in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, output])

    return in_arrow(samples, run, samples.select("*", F.lit("").alias(output)).schema)


DIGESTS = "doc_id long, rank int, n_pieces int, ids_crc32 long, log_prob double, log_inclusion double"


def digests(samples: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SAMPLES batches to DIGESTS batches."""
    for batch in samples:
        ids, ends = np.asarray(batch.column(2).values, np.uint32), np.asarray(batch.column(2).offsets)
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), batch.column(3), batch.column(5)], ["doc_id", "rank", "n_pieces", "ids_crc32", "log_prob", "log_inclusion"])


def sampling_query(docs: DataFrame, path: str, k: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, rank, n_pieces, ids_crc32, log_prob, log_inclusion of the samples of every document.

    The digests are taken where the samples are drawn: a second Python worker for each task would hold memory of its own,
    lattices of its earlier tasks too."""
    run = sampler(docs.sparkSession, path, piece_weights(docs, path), k, seed)
    return in_arrow(keyed_texts(docs), lambda rows: digests(run(rows)), DIGESTS)
