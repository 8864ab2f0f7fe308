"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. STATISTICS of each whole text, computed in one pass over its bytes.
2. Boosted trees of depth 3 over a bounded sample of labelled rows; each path from a root to a node is
   a rule, a conjunction of comparisons.
3. A logistic model with lasso weights over the rules keeps a few of them.
4. The kept rules become one Spark column expression, so scoring needs no Python.

The sample: `fit_rows` (20000) labelled rows with the smallest hashes of their ids; the driver holds that many
rows of statistics. Labels, language, source and id are never inputs of a score.

Defined results: texts of any length are measured whole; null texts count as empty, with all statistics 0; without labelled rows each score is 0.5;
repeated rows are scored each; labels that disagree count as the mean, half up. Other columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Scratch, fold, fresh, in_arrow_column, mix, runs, slices, span_hashes, utf8

STATISTICS = ("words", "word_bytes", "upper_share", "digit_share", "bang_rate", "bar_rate", "symbol_share", "stop_rate", "words_a_line", "lines", "unique_share", "top_share", "repeat_share", "line_copies", "triple_copies", "long_share", "capital_share", "rare_bytes")


def _mask(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


_UPPER, _DIGIT, _LINE = _mask((65, 90)), _mask((48, 57)), _mask((10, 10))
_LETTER = _mask((65, 90), (97, 122), (128, 255))
_SYMBOL = _mask((35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126))
_STOP, _RARE = _mask((33, 33), (46, 46), (63, 63)), _mask((0, 8), (14, 31), (127, 127), (240, 255))


def _per_row(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hit) + 1, np.int64 if len(hit) >> 31 else np.int32)
    np.cumsum(hit, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _copies(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the highest count of one, for each row."""
    distinct, most = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            own = np.sort(values[a:b])
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            distinct[k] = len(cut) + 1
            most[k] = np.diff(np.concatenate([[0], cut, [b - a]])).max()
    return distinct, most


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A column for each of STATISTICS."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    rows, starts, ends = runs(raw, offsets, IS_SPACE)
    at = np.searchsorted(rows, np.arange(n + 1))
    words = np.diff(at).astype(float)
    some = np.maximum(words, 1)
    code = span_hashes(raw, starts, ends)
    distinct, top = _copies(code, at)
    upper_at = _UPPER[raw]
    if len(raw):  # upper-case letters of Latin-1 in UTF-8: C3 80 to C3 9E
        upper_at[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    upper, letters = _per_row(upper_at, offsets), _per_row(_LETTER[raw], offsets)
    inside = np.concatenate([[0], np.cumsum(upper_at, dtype=np.int64)])
    capital = (inside[ends] - inside[starts]) >= np.maximum(2, (ends - starts) / 3) if len(starts) else np.zeros(0, bool)
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & (rows[1:] == rows[:-1])
    line_rows, line_starts, line_ends = runs(raw, offsets, _LINE)
    line_at = np.searchsorted(line_rows, np.arange(n + 1))
    lines = np.maximum(np.diff(line_at), 1).astype(float)
    line_distinct, _ = _copies(span_hashes(raw, line_starts, line_ends), line_at)
    triple = np.zeros(0, np.uint64)
    triple_at = np.zeros(n + 1, np.int64)
    if len(code) > 2:
        whole = np.flatnonzero(rows[2:] == rows[:-2])
        triple = mix(mix(mix(code[whole]) + code[whole + 1]) + code[whole + 2])
        triple_at = np.searchsorted(rows[whole], np.arange(n + 1))
    triples = np.maximum(np.diff(triple_at), 1)
    triple_distinct, _ = _copies(triple, triple_at)
    by_word = lambda hit: np.bincount(rows, hit, n) / some
    out = [
        words, by_word((ends - starts).astype(float)), upper / np.maximum(letters, 1), _per_row(_DIGIT[raw], offsets) / size, _per_row(raw == 33, offsets) / some, _per_row(raw == 124, offsets) / some,
        _per_row(_SYMBOL[raw], offsets) / size, _per_row(_STOP[raw], offsets) / some, words / lines, np.where(words > 0, lines, 0), distinct / some, top / some, by_word(same.astype(float)),
        np.where(words > 0, 1 - line_distinct / lines, 0), np.where(np.diff(triple_at) > 0, 1 - triple_distinct / triples, 0), by_word((ends - starts > 20).astype(float)), by_word(capital.astype(float)), _per_row(_RARE[raw], offsets) / size,
    ]
    return np.column_stack(out)


STATISTICS_TYPE = f"struct<{', '.join(f'{x}: double' for x in STATISTICS)}>"


def with_statistics(docs: DataFrame, text: str, output: str) -> DataFrame:
    """All columns of docs and a struct of statistics."""

    def measure(texts: pa.Array) -> pa.Array:
        raw, offsets, _ = utf8(texts)
        parts = [statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
        values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(STATISTICS))], list(STATISTICS))

    return docs.select("*", in_arrow_column(docs.sparkSession, measure, STATISTICS_TYPE)(F.col(f"`{text}`")).alias(output))


# ------------------------------------------------------------------ fitting


@dataclass(frozen=True)
class Rule:
    """True where each (statistic, threshold, above) holds: value > threshold or value <= threshold."""

    terms: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, cut, above in self.terms:
            out &= (x[:, k] > cut) == above
        return out


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        """The same probability as a Spark expression over a struct of STATISTICS."""
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, cut, above in rule.terms:
                value = stats[STATISTICS[k]]
                holds = holds & ((value > F.lit(cut)) if above else (value <= F.lit(cut)))
            z = z + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, weight: np.ndarray, depth: int, least: int) -> list[tuple[tuple, np.ndarray]]:
    """Nodes of a regression tree as (terms, rows), the root left out."""
    found: list[tuple[tuple, np.ndarray]] = []

    def split(rows: np.ndarray, terms: tuple, left: int) -> None:
        if not left or len(rows) < 2 * least:
            return
        best, choice = 1e-6, None
        for k, edge in enumerate(cuts):
            if not len(edge):
                continue
            own = bins[rows, k]
            g = np.cumsum(np.bincount(own, target[rows], len(edge) + 1))
            h = np.cumsum(np.bincount(own, weight[rows], len(edge) + 1))
            c = np.cumsum(np.bincount(own, minlength=len(edge) + 1))
            gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
            gain[(c[:-1] < least) | (c[-1] - c[:-1] < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best:
                best, choice = gain[at], (k, at)
        if choice is None:
            return
        k, at = choice
        above = bins[rows, k] > at
        for side in (True, False):
            term = (*terms, (k, float(cuts[k][at]), side))
            own = rows[above == side]
            found.append((term, own))
            split(own, term, left - 1)

    split(np.arange(len(bins)), (), depth)
    return found


def _simple(terms: tuple) -> tuple:
    """Only the narrowest comparison for each statistic and side."""
    kept: dict[tuple[int, bool], float] = {}
    for k, cut, above in terms:
        now = kept.get((k, above))
        kept[k, above] = cut if now is None else max(now, cut) if above else min(now, cut)
    return tuple(sorted((k, cut, above) for (k, above), cut in kept.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.001, rounds: int = 400) -> RuleEnsemble:
    """Boosted trees, their paths as rules, and lasso logistic weights (accelerated proximal gradient)."""
    rate = y.mean() if len(y) else 0.5
    if not len(y) or rate in (0, 1):
        return RuleEnsemble([], np.zeros(0), float(np.log((rate * len(y) + 0.5) / ((1 - rate) * len(y) + 0.5))))
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, 64)))
        cuts.append((values[1:] + values[:-1]) / 2)
    bins = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    least = max(3, len(y) // 2000)
    margin, rules = np.full(len(y), np.log(rate / (1 - rate))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        nodes = _grow(bins, cuts, y - p, p * (1 - p), depth, least)
        if not nodes:
            break
        held = {t for t, _ in nodes}
        for terms, rows in nodes:
            rules.setdefault(_simple(terms))
            if not any(t[:-1] == terms for t in held):  # a leaf
                margin[rows] += 0.3 * np.sum(y[rows] - p[rows]) / (np.sum(p[rows] * (1 - p[rows])) + 1)
    rules = [Rule(t) for t in rules]
    m = np.column_stack([r.holds(x) for r in rules]).astype(float)
    center, scale = m.mean(0), np.maximum(m.std(0), 1e-3)
    m = (m - center) / scale
    step = 4 * len(y) / np.linalg.eigvalsh(m.T @ m)[-1]
    w = v = np.zeros(m.shape[1])
    b, c, t = np.log(rate / (1 - rate)), np.log(rate / (1 - rate)), 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(m @ v + c))) - y
        new = v - step * (m.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias = c - 4 * error.mean() * 0.5
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / after * (new - w), bias + (t - 1) / after * (bias - b)
        w, b, t = new, bias, after
    own = np.flatnonzero(np.abs(w) > 1e-9)
    raw = w / scale
    return RuleEnsemble([rules[k] for k in own], raw[own], float(b - (raw * center)[own].sum()))


def train(stats: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = 20000) -> RuleEnsemble:
    """stats: doc_id, s (struct of STATISTICS). labels: doc_id and the target of the rows to learn from."""
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("double").alias("y"))
    rows = stats.join(known, "doc_id").select("y", "doc_id", *[F.col("s")[x].alias(x) for x in STATISTICS])
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).drop("doc_id").toPandas().to_numpy(float)
    return fit_rules(sample[:, 1:], sample[:, 0]) if len(sample) else RuleEnsemble([], np.zeros(0), 0.0)


def quality_query(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    own = with_statistics(docs.select("doc_id", "text"), "text", "s").select("doc_id", "s")
    own = scratch.write(own, "statistics")
    model = train(own, labels.filter(fold(F.col("doc_id"), 3) != 1))
    score = own.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), model.column(F.col("s")).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_stage(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents whose score is under 0.5 go; all columns of the others stay."""
    name = fresh(docs.columns, "statistics")
    own = scratch.write(with_statistics(docs, "text", name), "statistics")
    model = train(own.select("doc_id", F.col(name).alias("s")), labels)
    return own.filter(model.column(F.col(name)) >= 0.5).drop(name)
