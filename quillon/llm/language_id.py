"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree (up to ORDER bytes of context) with
PPM escape probabilities (method C, without exclusions): a symbol seen c times in a context with n
symbols of q kinds costs -log2(c / (n + q)) bits, any other -log2(q / (n + q)) and what the
context shorter by one byte asks; unseen contexts cost nothing, below all there are 256 equal
bytes. The trees are frozen after counting. A text's code length under each language is exact;
the language with the shortest one is predicted.

Counting is distributed over all training rows: 4-byte grams by language, summed before and after one
shuffle. The driver gets all of them, none is dropped, so that totals and escapes are those of all rows. They grow
slowly with the input and cost 9 bytes for each language that knows them, where all do 4: the trees have a row for all
languages only for grams that all of them know and for contexts under three bytes, of which there are few.

Defined results: texts of any length are scored whole; null or letterless texts give `und` with score 0.0; repeated rows are scored
each; with no training row every text is `und`; ties go to the smaller language name. Other columns,
whatever their names, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, in_arrow, in_arrow_column, slices, utf8

ORDER = 3
UNKNOWN = "und"
#: Before a text's first byte: line ends.
PAD = 10
#: Digits count as 0; tabs, line ends and carriage returns as a space.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[[9, 10, 13]] = 32


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, it and the three before it in its text, as one 32-bit number."""
    b = _CLASS[raw].astype(np.uint32)
    out = b.copy()
    for k in (1, 2, 3):
        back = np.full(len(b), PAD, np.uint32)
        back[k:] = b[:-k]
        for j in range(k):  # the first bytes of each text have no text before them
            at = offsets[:-1] + j
            back[at[at < offsets[1:]]] = PAD
        out |= back << np.uint32(8 * k)
    return out


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


class Finder:
    """Open-addressing map from 32-bit keys to their positions, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        bits = max(4, int(np.ceil(np.log2(len(keys) * 2.5 + 1))))
        self.shift, self.size = np.uint32(32 - bits), 1 << bits
        self.slots = np.full(self.size, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (self.size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Positions, -1 for keys that are not there."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        at = self._home(wanted)
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != wanted))
        at = at[left]
        while len(left):
            at = (at + 1) & (self.size - 1)
            got = self.slots[at]
            found[left] = got
            on = (got >= 0) & (self.keys[got] != wanted[left])
            left, at = left[on], at[on]
        return found


@dataclass
class ContextTrees:
    """Frozen trees of all languages as tables: code lengths of grams known to any language, by language."""

    languages: list[str]
    known: list[np.ndarray]  # grams of four bytes, of three: those that all languages know first
    shared: np.ndarray  # code lengths of the four-byte grams that all languages know, a column for each language
    first: np.ndarray  # for each other four-byte gram, its first place in `of` and `bits`; one more at the end
    of: np.ndarray  # languages that know these grams
    bits: np.ndarray  # their code lengths
    three: np.ndarray  # code lengths of three-byte grams, a column for each language
    contexts: list[np.ndarray]  # by context length 3, 2: sorted contexts
    escapes: list[np.ndarray]  # their escape costs
    pairs: np.ndarray  # code lengths of a byte after one byte, 65536 rows

    def __post_init__(self):
        self.finders = None

    def cost(self, wanted: np.ndarray) -> np.ndarray:
        """Code lengths in bits, a row for each gram, a column for each language."""
        if self.finders is None:
            self.finders = [[Finder(k) for k in x] for x in (self.known, self.contexts)]
        grams_of, contexts_of = self.finders
        at, common = grams_of[0].find(wanted), len(self.shared)
        out = self.shared[np.minimum(np.maximum(at, 0), common - 1)] if common else np.zeros((len(at), len(self.languages)), np.float32)
        miss = rest = np.flatnonzero((at < 0) | (at >= common))
        if len(rest):  # some languages, or all, go by the shorter contexts
            tail = wanted[rest]
            below = grams_of[1].find(tail & np.uint32(0xFFFFFF))
            out[rest] = self.three[np.maximum(below, 0)] if len(self.three) else 0
            miss = np.flatnonzero(below < 0)
            own = tail[miss]
            out[rest[miss]] = self.pairs[own & np.uint32(0xFFFF)]
            for level, width, rows in ((1, 16, miss), (0, 24, np.arange(len(rest)))):
                above = contexts_of[level].find((tail[rows] >> np.uint32(8)) & np.uint32((1 << width) - 1))
                out[rest[rows[above >= 0]]] += self.escapes[level][above[above >= 0]]
            some = np.flatnonzero(at[rest] >= 0)
            gram = at[rest[some]] - common
            number = self.first[gram + 1] - self.first[gram]
            entry = np.repeat(self.first[gram] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
            out[np.repeat(rest[some], number), self.of[entry]] = self.bits[entry]
        return out

    def __getstate__(self):
        return {**self.__dict__, "finders": None}

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray, block: int = 1 << 19) -> np.ndarray:
        """Bits of each text under each language."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        g = grams(raw, offsets)
        for first in range(0, len(g), block):
            cost = self.cost(g[first : first + block])
            end = first + len(cost)
            low, high = np.searchsorted(offsets, first, "right") - 1, np.searchsorted(offsets, end, "left")
            at = offsets[low:high]
            own = np.flatnonzero(offsets[low + 1 : high + 1] > at)  # empty texts hold nothing
            total[low + own] += np.add.reduceat(cost, np.maximum(at[own] - first, 0), axis=0, dtype=np.float64)
        return total


def _tree(gram: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Counts of one context length: distinct grams, their own costs, contexts, escape costs."""
    gram = gram & np.uint32((1 << width) - 1) if width < 32 else gram
    keys, where = np.unique(gram, return_inverse=True)
    seen = np.bincount(where, count, len(keys))
    context, of = np.unique(keys >> np.uint32(8), return_inverse=True)
    total = np.bincount(of, seen, len(context)) if len(keys) else np.zeros(0)
    kinds = np.bincount(of, minlength=len(context))
    return keys, -np.log2(seen / (total + kinds)[of]), context, -np.log2(kinds / (total + kinds))


def freeze(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> ContextTrees:
    """Trees from each language's 4-byte grams and their counts."""
    languages = sorted(counts)
    trees = {(name, k): _tree(*counts[name], 8 * (k + 1)) for name in languages for k in range(ORDER + 1)}

    def union(k: int, what: int) -> np.ndarray:
        return np.unique(np.concatenate([trees[x, k][what] for x in languages] or [np.zeros(0, np.uint32)]).astype(np.uint32))

    def spread(k: int, what: int, wanted: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """A column for each language: the values of its own keys, elsewhere those of `missing`."""
        out = missing.copy()
        for j, name in enumerate(languages):
            keys, values = trees[name, k][what], trees[name, k][what + 1]
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            own = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
            out[own, j] = values[at[own]]
        return out

    def escape(k: int, context: np.ndarray) -> np.ndarray:
        return spread(k, 2, context, np.zeros((len(context), len(languages))))

    below = np.full((256, len(languages)), 8.0)
    below = spread(0, 0, np.arange(256, dtype=np.uint32), escape(0, np.zeros(256, np.uint32)) + below)
    pair = np.arange(65536, dtype=np.uint32)
    pairs = spread(1, 0, pair, escape(1, pair >> np.uint32(8)) + below[pair & 255])
    three = union(2, 0)
    bits3 = spread(2, 0, three, escape(2, three >> np.uint32(8)) + pairs[three & np.uint32(0xFFFF)])
    contexts = [union(3, 2), union(2, 2)]
    escapes = [escape(3, contexts[0]), escape(2, contexts[1])]
    # Four-byte grams with the languages that know them, by gram.
    gram = np.concatenate([trees[x, 3][0] for x in languages] or [np.zeros(0, np.uint32)]).astype(np.uint32)
    of = np.repeat(np.arange(len(languages), dtype=np.uint8 if len(languages) < 256 else np.int32), [len(trees[x, 3][0]) for x in languages])
    bits = np.concatenate([trees[x, 3][1] for x in languages] or [np.zeros(0)]).astype(np.float32)
    order = np.argsort(gram, kind="stable")
    gram, of, bits = gram[order], of[order], bits[order]
    four, first, number = np.unique(gram, return_index=True, return_counts=True)
    every = number == len(languages)
    shared = bits[np.repeat(every, number)].reshape(-1, max(1, len(languages)))
    partly = np.repeat(~every, number)
    first = np.concatenate([[0], np.cumsum(number[~every])])
    small = lambda x: x.astype(np.float32)
    return ContextTrees(languages, [np.concatenate([four[every], four[~every]]), three], shared, first, of[partly], bits[partly], small(bits3), contexts, [small(x) for x in escapes], small(pairs))


def count_grams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to (lang, gram, n), each gram of a language about once for a task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in rows:
        names = batch.column(0).dictionary_encode()
        codes = np.asarray(names.indices)
        for code, name in enumerate(names.dictionary.to_pylist()):
            raw, offsets, _ = utf8(lowered(batch.column(1).filter(pa.array(codes == code))))
            for first, last in slices(offsets):
                part = raw[offsets[first] : offsets[last]]
                if len(part):
                    held.setdefault(name, []).append(np.unique(grams(part, offsets[first : last + 1] - offsets[first]), return_counts=True))
            if len(held.get(name, ())) > 8:
                held[name] = [merged(held[name])]
    for name, parts in held.items():
        keys, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> ContextTrees:
    """Counts every row of docs with text and language and freezes the trees."""
    counted = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    table = in_arrow(counted, count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = table["lang"].combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    code = np.asarray(names.indices)
    gram, n = table["gram"].to_numpy().astype(np.uint32), table["n"].to_numpy().astype(np.float64)
    return freeze({name: (gram[code == j], n[code == j]) for j, name in enumerate(names.dictionary.to_pylist())})


def predict(texts: pa.Array, trees: ContextTrees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted language, its probability and its bits a byte for each text."""
    n = len(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    has = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)) if n else np.zeros(0, bool)
    names = np.full(n, UNKNOWN, object)
    score, rate = np.zeros(n), np.zeros(n)
    if trees.languages and n:
        raw, offsets, _ = utf8(lowered(texts))
        for first, last in slices(offsets):
            bits = trees.code_lengths(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            best = bits.argmin(1)
            least = bits[np.arange(len(bits)), best]
            names[first:last] = np.array(trees.languages, object)[best]
            score[first:last] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            rate[first:last] = least / np.maximum(1, np.diff(offsets[first : last + 1]))
    names[~has] = UNKNOWN
    score[~has] = 0
    return names, score, rate


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text", output: str = "language") -> DataFrame:
    """All columns of docs and a struct `output` of lang_pred, score and bits_per_byte."""
    if output.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{output} is a column of the input")
    frozen = docs.sparkSession.sparkContext.broadcast(trees)

    def score(texts: pa.Array) -> pa.Array:
        names, own, rate = predict(texts, frozen.value)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(own), pa.array(rate)], ["lang_pred", "score", "bits_per_byte"])

    told = in_arrow_column(docs.sparkSession, score, "struct<lang_pred: string, score: double, bits_per_byte: double>")
    return docs.select("*", told(F.col(f"`{text}`")).alias(output))


def held_out(docs: DataFrame):
    return F.coalesce(fold(docs["doc_id"], 4) == 2, F.lit(False))


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; see the module for edge cases."""
    own = docs.select("doc_id", "text", "lang")
    trees = train(own.filter(fold(F.col("doc_id"), 4) != 2))
    told = identify(own.select("doc_id", "text"), trees)
    return told.select("doc_id", held_out(told).alias("held_out"), "language.lang_pred", "language.score")


def language_stage(docs: DataFrame) -> DataFrame:
    """Documents without a recognisable language go, all columns of the others stay.

    A language counts as recognised when it takes more than half of the probability.
    """
    trees = train(docs.select("lang", "text"))
    name = fresh(docs.columns, "language")
    told = identify(docs, trees, output=name)
    return told.filter((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] > 0.5)).drop(name)
