"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model counts the letters of all texts (at most 61**3 counts).
2. Each word that the channel may have changed (letters written as digits or signs, letters set apart by
   white space or signs, letters repeated; numbers are none) is a lattice of intended letters. A Viterbi search takes the
   path that the channel and the character model together find likeliest. Plain words have one
   path only and stay.
3. Words and their beginnings get weights, the log odds of toxic against other documents, lowered by
   1.5 standard errors. They are learned on a bounded sample of labelled rows, near copies counted once.
4. A logistic model of the strongest weights in the original and the restored words gives the score. It is
   calibrated on the half of the sample that the weights in its inputs have not seen.

The sample: at most `fit_rows` labelled rows of each kind, those with the smallest hashes of their ids.
Labels, language, source and id are never inputs of a score.

Defined results: texts of any length are scored whole; an unbroken token takes time in proportion to its length; null texts count as empty and get the score of a text without any weighted word;
with labels of one kind only, or none, every score is the smoothed share of toxic rows; repeated rows are
scored each. Other columns do no harm.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, in_arrow, utf8
from .minhash_dedup import shingle_rows
from .word_ids import text_batches

# Signs and the letters that they are written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
#: Signs that only set letters apart.
APART = set(" .-_*~'`^/\\,:;")
EDGES = ".,;:!?\"'()[]{}<>|*_-~`«»¡¿…“”‘’"
#: Channel costs in nats: a letter as itself, a sign for a letter, a sign between letters, another sign that means nothing.
SAME, SIGN, BETWEEN, IDLE = 0.01, 1.0, 1.2, 9.0
#: A letter that repeats the one before by accident, and each one after that.
AGAIN, MORE = 4.0, 0.4

#: Symbols of the character model: 0 no letter, a-z, ß-ÿ, 60 other letters.
SYMBOLS = 61
_SYMBOL_OF = np.zeros(0x250, np.int64)
_SYMBOL_OF[97:123] = np.arange(1, 27)
_SYMBOL_OF[0xDF:0x100] = np.arange(27, 60)
_SYMBOL_OF[0xF7] = 0  # the division sign
_SYMBOL_OF[0x100:] = 60


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.where(points < len(_SYMBOL_OF), _SYMBOL_OF[np.minimum(points, len(_SYMBOL_OF) - 1)], 60)


def count_letters(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in rows:
        texts = [t for t in batch.column(0).to_pylist() if t]
        for first, last in text_batches(texts):
            s = np.concatenate([[0, 0], symbols("\n".join(texts[first:last])), [0]])
            code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
            total += np.bincount(code, minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])


def letter_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs (nats) of a symbol after two others, from all texts; interpolated with shorter contexts."""
    counted = in_arrow(docs.select(text), count_letters, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(SYMBOLS**3)
    three[counted["code"].to_numpy()] = counted["n"].to_numpy()
    three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one + 0.5).sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


_PLAIN = re.compile(r"(?:([^\W\d_])(?!\1))+")
_LETTER = re.compile(r"[^\W\d_]")
_SIGN = re.compile("[" + re.escape("".join(k for k in LEET if not k.isdigit())) + "]")
_BLANK = re.compile(r"\s")
#: Single characters parted by white space, between brackets, quotes or punctuation.
_SPACED = re.compile(r"(?<!\S)[\"'(\[{<«“‘¡¿*_~]*(\S(?:\s+\S){2,})(?=[.,;:!?\"')\]}>»”’…*_~]*(?!\S))")
#: The least letters of a word inside a spelled-out run, and of one written with signs and digits only.
LEAST_LETTERS = 3


class Restorer:
    """Finds what was meant by the words of a text."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def decode(self, word: str) -> str:
        """The cheapest path through the lattice of the word's intended letters."""
        costs = self.costs
        # Paths by their last two symbols: cost, and letters so far as a chain (letters before, last letter).
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        run, before = 0, ""
        for char in word:
            run = run + 1 if char == before else 0
            before = char
            again = MORE if run > 1 else AGAIN
            signs = LEET.get(char, "")
            letter = char.isalpha()
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, so_far) in paths.items():
                steps = []
                if letter:
                    steps.append((char, SAME))
                for s in signs:
                    steps.append((s, SIGN))
                for s, price in steps:
                    k = _symbol(s)
                    now = cost + price + costs[a][b][k]
                    if now < after.get((b, k), (np.inf,))[0]:
                        after[b, k] = (now, (so_far, s))
                    if so_far is not None and so_far[1] == s:  # the same letter once more
                        now = cost + again
                        if now < after.get((a, b), (np.inf,))[0]:
                            after[a, b] = (now, so_far)
                if not letter:
                    now = cost + (BETWEEN if char in APART else IDLE)
                    if now < after.get((a, b), (np.inf,))[0]:
                        after[a, b] = (now, so_far)
            paths = after
        ends = [(cost + costs[a][b][0], so_far) for (a, b), (cost, so_far) in paths.items()]
        least = min(cost for cost, _ in ends)
        return min(_spelled(so_far) for cost, so_far in ends if cost == least)

    def forms(self, token: str) -> tuple[str, ...]:
        """The word itself and, where it differs, the restored one; a token with white space was spelled out."""
        if _BLANK.search(token):
            meant = self.decode(" ".join(token.lower().split()))
            return tuple(meant[k:] for k in range(max(1, len(meant) - LEAST_LETTERS + 1))) if meant else ()
        word = token.strip(EDGES).lower()
        if _PLAIN.fullmatch(word):
            if word == token.lower().rstrip(EDGES):
                return (word,)
        elif not _LETTER.search(word):
            if not _SIGN.search(word):  # a number
                return (word,) if word else ()
            meant = self.decode(word)
            return (word, meant) if len(meant) >= LEAST_LETTERS else (word,)
        meant = self.decode(token.rstrip(".,;:?\"')]}>").lower())
        return (word, meant) if meant != word and meant else (word,)


def _spelled(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


def _symbol(letter: str) -> int:
    point = ord(letter)
    return int(_SYMBOL_OF[point]) if point < len(_SYMBOL_OF) else 60


def tokens(text: str) -> list[str]:
    return [*text.split(), *(m[1] for m in _SPACED.finditer(text))]


def features(form: str) -> list[str]:
    """A whole word and its beginnings of 3 to 8 letters."""
    return [f"={form}", *(f"^{form[:k]}" for k in range(3, min(8, len(form)) + 1))]


# ------------------------------------------------------------------ learning


def sample_words(restorer) -> callable:
    """(y, doc, text) to y, half, two sketches of its shingles, and the distinct features of its words."""

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(restorer.value)
        for batch in rows:
            raw, offsets, _ = utf8(batch.column(1))
            value, at, one, _ = shingle_rows(raw, offsets, 3)
            low = [int(value[a:b].min().view(np.int64)) if b > a else int(k.view(np.int64)) for a, b, k in zip(at[:-1], at[1:], one)]
            high = [int(value[a:b].max().view(np.int64)) if b > a else int(k.view(np.int64)) for a, b, k in zip(at[:-1], at[1:], one)]
            words = []
            for text in batch.column(1).to_pylist():
                forms = {f for token in set(tokens(text or "")) for f in r.forms(token)}
                words.append(sorted(forms))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low), pa.array(high), pa.array([len((t or "").split()) for t in batch.column(1).to_pylist()], pa.int64()), pa.array(words, pa.list_(pa.string()))], ["y", "low", "high", "n", "words"])

    return gather


def count_features(wanted) -> callable:
    """(y, half, words) to (feature, half, y, n); only wanted features, if given."""

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        only = None if wanted is None else wanted.value
        for batch in rows:
            for y, half, words in zip(*(c.to_pylist() for c in batch.columns)):
                own = {f for w in words for f in features(w)}
                held.update((f, half, y) for f in (own if only is None else own & only))
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(held.values()), pa.int64())], ["feature", "half", "y", "n"])

    return gather


STRENGTH = 6


def strengths(hits: list[float], n: int) -> list[float]:
    """What the score rests on: the strongest weights of distinct words, their number, the text's length."""
    top = sorted(hits, reverse=True)[:5]
    return [top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, sum(top), np.log1p(len(hits)), np.log1p(n) * bool(top), len(hits) / max(n, 1)]


def weight(lexicon: dict[str, float], form: str) -> float:
    return max(map(lexicon.get, features(form), [0.0] * 7))


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1)) - 1.5 * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


#: Weights under this are left out.
LEAST_WEIGHT = 2.2


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias; Newton steps with a ridge on standardised inputs."""
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    m = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w = np.zeros(m.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + keep, m.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - (raw * center).sum())


class ToxicityModel:
    def __init__(self, costs: np.ndarray, lexicon: dict[str, float], weights: np.ndarray):
        self.costs, self.lexicon, self.weights = costs, lexicon, weights

    def scorer(self):
        """A function from a text to its score; it keeps the weights of words that it has met."""
        restorer, lexicon, kept = Restorer(self.costs), self.lexicon, {}

        def token_weight(token: str) -> float:
            return max([weight(lexicon, f) for f in restorer.forms(token)], default=0.0)

        def score(text: str) -> float:
            if len(kept) > 500_000:
                kept.clear()
            words = text.split()
            found = list(map(kept.get, words))
            hits: dict[str, float] = {}
            for word, value in zip(words, found):
                if value is None:
                    value = kept.get(word)
                    if value is None:
                        value = token_weight(word)
                        if len(word) <= 64:
                            kept[word] = value
                if value:
                    hits[word.strip(EDGES).lower()] = value
            for m in _SPACED.finditer(text):
                if (value := token_weight(m[1])):
                    hits[m[1]] = value
            z = float(np.dot(strengths(list(hits.values()), len(words)), self.weights[:-1]) + self.weights[-1])
            return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))

        return score


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, target: str = "toxic", fit_rows: int = 8000) -> ToxicityModel:
    """docs: doc_id, text, all of them. labels: doc_id and the target of the rows to learn from.

    fit_rows: most labelled rows of each kind. The driver gets the counts of all features that three of them share."""
    spark = docs.sparkSession
    costs = letter_model(docs)
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("y"))
    chosen = None
    for kind in (0, 1):
        part = known.filter(F.col("y") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.union(part)
    chosen = spark.createDataFrame(chosen.collect(), "doc_id long, y int")  # at most 2 * fit_rows ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")
    shared = spark.sparkContext.broadcast(costs)
    sample = in_arrow(texts, sample_words(shared), "y int, low long, high long, n long, words array<string>")
    sample = scratch.write(sample, "sample")
    for one, other in (("low", "high"), ("high", "low")):  # of rows that share a sketch the least one stays
        sample = sample.groupBy(one).agg(F.min(F.struct("y", other, "n", "words")).alias("least")).select(one, "least.*")
    sample = scratch.write(sample.withColumn("half", (F.pmod(F.xxhash64("low"), F.lit(2))).cast("int")), "distinct")
    size = {(r["half"], r["y"]): r["n"] for r in sample.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = {y: sum(n for (_, k), n in size.items() if k == y) for y in (0, 1)}
    base = (rows[1] + 0.5) / (rows[0] + rows[1] + 1)
    constant = ToxicityModel(costs, {}, np.append(np.zeros(STRENGTH), np.log(base / (1 - base))))
    if not rows[0] or not rows[1]:
        return constant
    schema = "feature string, half int, y int, n long"
    toxic = in_arrow(sample.filter("y = 1").select("y", "half", "words"), count_features(None), schema)
    toxic = toxic.groupBy("feature").agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"t{h}") for h in (0, 1)])
    toxic = toxic.filter("t0 + t1 >= 3").orderBy("feature").toPandas()
    wanted = spark.sparkContext.broadcast(set(toxic["feature"]))
    other = in_arrow(sample.filter("y = 0").select("y", "half", "words"), count_features(wanted), schema)
    other = other.groupBy("feature").agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"o{h}") for h in (0, 1)]).toPandas()
    table = toxic.merge(other, "left", "feature").fillna(0)
    names, t, o = table["feature"].tolist(), table[["t0", "t1"]].to_numpy(float), table[["o0", "o1"]].to_numpy(float)

    def lexicon(halves: list[int]) -> dict[str, float]:
        w = log_odds(t[:, halves].sum(1), o[:, halves].sum(1), sum(size.get((h, 1), 0) for h in halves), sum(size.get((h, 0), 0) for h in halves))
        return {name: float(x) for name, x in zip(names, w) if x >= LEAST_WEIGHT}

    halves = [spark.sparkContext.broadcast(lexicon([1 - h])) for h in (0, 1)]  # what the other half has told

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for half, n, words in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                hits = [x for x in (weight(halves[half].value, w) for w in words) if x]
                out.append(strengths(hits, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["y", "x"])

    seen = in_arrow(sample.select("y", "half", "n", "words"), strong, "y int, x array<double>").toPandas()
    x, y = np.array(seen["x"].tolist()), seen["y"].to_numpy(float)
    return ToxicityModel(costs, lexicon([0, 1]), fit_logistic(x, y))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", output: str = "toxicity") -> DataFrame:
    """All columns of docs and the score."""
    if output.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{output} is a column of the input")
    position = docs.columns.index(text)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(name, shared)
        for batch in rows:
            values = [of(t or "") for t in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, output])

    return in_arrow(docs, run, docs.select("*", F.lit(0.0).cast("double").alias(output)).schema)


_SCORERS: dict = {}


def _scorer(name: str, shared):
    """One for each Python worker and model, kept between its tasks."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = shared.value.scorer()
    return _SCORERS[name]


def toxicity_query(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    own = docs.select("doc_id", "text")
    model = train(own, labels.filter(fold(F.col("doc_id"), 3) != 1), scratch)
    told = score(own, model, output="score")
    return told.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
