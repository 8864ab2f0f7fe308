"""Language ID, quality rules, toxicity."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import language_id as L
from quillon.llm import quality_rules as Q
from quillon.llm import toxicity as T
from quillon.llm.common import Scratch


def slow_code_length(text: str, counts: dict, order: int = 3) -> float:
    """PPM as the module's text says it, byte by byte."""
    data = bytes(L._CLASS[np.frombuffer(text.lower().encode(), np.uint8)])
    padded = bytes([L.PAD] * order) + data
    bits = 0.0
    for k in range(order, len(padded)):
        cost = 0.0
        for n in range(order, -1, -1):
            seen = counts[n].get(padded[k - n : k], {})
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if padded[k] in seen:
                cost -= np.log2(seen[padded[k]] / (total + kinds))
                break
            cost -= np.log2(kinds / (total + kinds))
        else:
            cost += 8.0
        bits += cost
    return bits


def context_counts(texts, order=3):
    out = {n: {} for n in range(order + 1)}
    for text in texts:
        padded = bytes([L.PAD] * order) + bytes(L._CLASS[np.frombuffer(text.lower().encode(), np.uint8)])
        for k in range(order, len(padded)):
            for n in range(order + 1):
                own = out[n].setdefault(padded[k - n : k], {})
                own[padded[k]] = own.get(padded[k], 0) + 1
    return out


def test_code_lengths_are_those_of_ppm(spark, prose_of):
    r = random.Random(1)
    train = [("aa", prose_of(r, "aa", 50)) for _ in range(6)] + [("bb", prose_of(r, "bb", 50) + " Ä") for _ in range(6)]
    trees = L.train(spark.createDataFrame(train, "lang string, text string"))
    assert trees.languages == ["aa", "bb"]
    for text in (prose_of(r, "aa", 30), "zzqq ÄÖ 77\n\tx", "a", ""):
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        got = trees.code_lengths(raw, np.array([0, len(raw)]), block=17)[0]
        want = [slow_code_length(text, context_counts([t for x, t in train if x == lang])) for lang in trees.languages]
        assert got == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_languages_are_told(spark, prose_of, odd_rows, with_clashes):
    r = random.Random(2)
    rows = [(k, prose_of(r, "aa" if k % 2 else "bb", 20), "aa" if k % 2 else "bb") for k in range(120)] + [(i, t, None) for i, t in odd_rows]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = [tuple(x) for x in L.language_query(docs).collect()]
    assert len(told) == len(rows)
    held = [(i, p) for i, h, p, _ in told if h and i is not None and i < 120]
    assert len(held) > 10 and all(p == ("aa" if i % 2 else "bb") for i, p in held)
    by = {i: (p, s) for i, _, p, s in told}
    for i in (900, 901, 902, 904):
        assert by[i] == ("und", 0.0)
    assert by[903][0] == "aa" and by[905][0] == "bb" and all(0 <= s <= 1 for *_, s in told)
    assert sum(i is None for i, *_ in told) == 2
    kept = L.language_stage(docs)
    assert kept.columns == docs.columns
    assert {900, 901, 902, 904}.isdisjoint(x[0] for x in kept.select("doc_id").collect())
    assert kept.filter("doc_id < 120").count() == 120
    none = L.language_query(docs.limit(0))
    assert none.count() == 0
    untaught = L.identify(docs.select("text"), L.train(docs.filter("lang = 'zz'")))
    assert {x[0] for x in untaught.select("language.lang_pred").collect()} == {"und"}


def test_grams_kept_are_bounded(spark, prose_of):
    r = random.Random(3)
    docs = spark.createDataFrame([("aa", prose_of(r, "aa", 400))], "lang string, text string")


def quality_rows(r, prose_of, n):
    rows, labels = [], []
    for k in range(n):
        text, good = prose_of(r, "aa", r.randint(8, 80)), 1
        if k % 4 == 0:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif k % 4 == 1:
            text, good = " ".join([text.split()[0]] * 30), 0
        rows.append((k, text))
        labels.append((k, good))
    return rows, labels


def test_quality(spark, prose_of, odd_rows, with_clashes):
    rows, labels = quality_rows(random.Random(4), prose_of, 240)
    docs = with_clashes(spark.createDataFrame(rows + odd_rows, "doc_id long, text string"))
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (100_000, 0)], "doc_id long, quality int")
    told = {x[0]: tuple(x) for x in Q.quality_query(docs, marks, Scratch(spark, "test")).collect()}
    held = [(told[k][3], y) for k, y in labels if told[k][1]]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= x[2] <= 1 and x[3] == (x[2] >= 0.5) for x in told.values()) and {900, 901, 903} <= set(told)
    kept = Q.quality_stage(docs, marks, Scratch(spark, "test"))
    assert kept.columns == docs.columns and kept.filter("doc_id < 240").count() == pytest.approx(120, abs=4)
    nothing = Q.quality_query(docs, marks.limit(0), Scratch(spark, "test"))
    assert {x[0] for x in nothing.select("score").distinct().collect()} == {0.5}
    assert Q.quality_query(docs.limit(0), marks, Scratch(spark, "test")).count() == 0


def test_compiled_rules_score_as_the_model_does(spark):
    random_ = np.random.default_rng(6)
    x = random_.random((600, len(Q.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3) | (x[:, 2] > 0.9)).astype(float)
    model = Q.fit_rules(x, y)
    assert model.rules and np.mean((model.probability(x) >= 0.5) == y) > 0.97
    df = spark.createDataFrame([tuple(map(float, v)) for v in x[:50]], ", ".join(f"{c} double" for c in Q.STATISTICS))
    from pyspark.sql import functions as F

    got = df.select(model.column(F.struct(*Q.STATISTICS)).alias("p")).toPandas()["p"].to_numpy()
    assert np.allclose(got, model.probability(x[:50]))


def test_statistics_of_a_text():
    raw = "Aa AA! b b\nc|c 1.\nAa AA! b b".encode()
    told = dict(zip(Q.STATISTICS, Q.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]))
    assert (told["words"], told["lines"], told["bang_rate"], told["bar_rate"]) == (10, 3, 0.2, 0.1)
    assert told["unique_share"] == 0.5 and told["top_share"] == 0.4 and told["repeat_share"] == pytest.approx(0.2) and told["line_copies"] == pytest.approx(1 / 3)
    assert (Q.statistics(np.zeros(0, np.uint8), np.array([0, 0])) == 0).all()


BAD = "zonkface grubling fumewit".split()


def test_all_grams_of_a_large_language_count(spark):
    text = "".join(map(chr, np.random.default_rng(4).integers(0x590, 0x7FF, 1_500_000))) + "".join(map(chr, np.random.default_rng(5).integers(0xE0, 0x590, 2_500_000)))
    raw = np.frombuffer(L.lowered(pa.array([text]))[0].as_py().encode(), np.uint8)
    every = np.unique(L.grams(raw, np.array([0, len(raw)])))
    assert len(every) > 1 << 21
    assert len(L.train(spark.createDataFrame([("aa", text)], "lang string, text string")).known[0]) == len(every)


def toxic_rows(r, prose_of, n):
    rows, labels = [], []
    for k in range(n):
        words, bad = prose_of(r, "aa", r.randint(10, 60)).split(), int(k % 3 == 0)
        for _ in range(3 * bad):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((k, " ".join(words)))
        labels.append((k, bad))
    return rows, labels


def test_toxicity(spark, prose_of, odd_rows, with_clashes):
    r = random.Random(7)
    rows, labels = toxic_rows(r, prose_of, 300)
    hidden = [(1000, "what a z0nkf4ce and grubl1ng you are"), (1001, "such a z o n k f a c e here and f.u.m.e.w.i.t there"), (1002, "zonkfaaaaace and grubbbbling again")]
    docs = with_clashes(spark.createDataFrame(rows + hidden + odd_rows, "doc_id long, text string"))
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    told = {x[0]: tuple(x) for x in T.toxicity_query(docs, marks, Scratch(spark, "test")).collect()}
    held = [(told[k][3], y) for k, y in labels if told[k][1]]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.97
    assert [told[k][3] for k in (1000, 1001, 1002)] == [1, 1, 1]
    assert [told[k][3] for k in (900, 901, 903, 904)] == [0, 0, 0, 0] and all(0 <= x[2] <= 1 and x[3] == (x[2] >= 0.7) for x in told.values())
    one_kind = T.toxicity_query(docs, marks.filter("toxic = 0"), Scratch(spark, "test"))
    assert one_kind.select("score").distinct().count() == 1
    assert T.toxicity_query(docs.limit(0), marks, Scratch(spark, "test")).count() == 0


def test_restored_words(spark):
    docs = spark.createDataFrame([("idiot moron trash scum the idea of a video is not a bother " * 20,)], "text string")
    r = T.Restorer(T.letter_model(docs))
    for hidden, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("s.c.u.m", "scum"), ("m o r o n", "moron"), ("morooooon", "moron"), ("!diot", "idiot")):
        assert meant in r.forms(hidden)
    assert r.forms("Idea,") == ("idea",) and r.forms("...") == () and r.forms("2024") == ("2024",)


def test_spelled_out_words_end_anywhere(spark):
    docs = spark.createDataFrame([("idiot moron trash scum die ass the idea of a video is not a bother " * 20,)], "text string")
    r = T.Restorer(T.letter_model(docs))

    def meant(text):
        return {f for token in T.tokens(text) for f in r.forms(token)}

    for text, word in (("you s c u m. Go", "scum"), ("s c u m, you", "scum"), ("now d i e!", "die"), ("d i e", "die"), ("(s c u m)", "scum"), ("m\to\tr\to\tn", "moron"), ("m  o   r\no n.", "moron"), ("you are s c u m", "scum"), ("you @$$ there", "ass"), ("an @55.", "ass")):
        assert word in meant(text), text
    assert meant("2024 1,000 ... -") == {"2024", "1,000"} and meant("a b") == {"a", "b"} and meant("- - -") == set()


def test_statistics_batches_accept_null_columns():
    batch = pa.RecordBatch.from_arrays([pa.array([None, None], pa.string())], ["text"])
    assert L.predict(batch.column(0), L.freeze({}))[0].tolist() == ["und", "und"]


def exhaustive_decoding(costs, word):
    """The cheapest of all readings of a word, each one written out."""
    found = []

    def go(at, cost, text, a, b, run):
        if at == len(word):
            found.append((cost + float(costs[a][b][0]), text))
            return
        char = word[at]
        run = run + 1 if at and char == word[at - 1] else 0
        for s, price in [(char, T.SAME)] * char.isalpha() + [(s, T.SIGN) for s in T.LEET.get(char, "")]:
            k = T._symbol(s)
            go(at + 1, cost + price + float(costs[a][b][k]), text + s, b, k, run)
            if text and text[-1] == s:
                go(at + 1, cost + (T.MORE if run > 1 else T.AGAIN), text, a, b, run)
        if not char.isalpha():
            go(at + 1, cost + (T.BETWEEN if char in T.APART else T.IDLE), text, a, b, run)

    go(0, 0.0, "", 0, 0, 0)
    return min(found)


def test_decoding_is_exhaustive_search():
    r = random.Random(4)
    costs = np.random.default_rng(4).random((T.SYMBOLS,) * 3).astype(np.float32) * 6
    restorer = T.Restorer(costs)
    for _ in range(400):
        word = "".join(r.choice("aabl1!5$-.6#ss") for _ in range(r.randint(1, 7)))
        cost, text = exhaustive_decoding(costs, word)
        assert restorer.decode(word) == text, (word, cost)
    assert restorer.decode("") == "" and len(restorer.decode("ab1-" * 50_000)) > 50_000


def slow_statistics(text):
    """The statistics of one text, one after the other, from its bytes."""
    raw = text.encode()
    lower = lambda x: bytes(c + 32 if 65 <= c <= 90 else c for c in x)
    words = [lower(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    own = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [lower(x) for x in re.findall(rb"[^\n]+", raw)]
    n, some, size, n_lines = len(words), max(1, len(words)), max(1, len(raw)), max(1, len(lines))
    upper_at = {k for k, c in enumerate(raw) if 65 <= c <= 90 or k and raw[k - 1] == 0xC3 and 0x80 <= c <= 0x9E}
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in raw)
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    triples = list(zip(words, words[1:], words[2:]))
    symbols = set(b"#$%&*+/<=>@[\\]^_`{|}~")
    return [
        n, sum(map(len, own)) / some, len(upper_at) / max(1, letters), sum(48 <= c <= 57 for c in raw) / size, raw.count(b"!") / some, raw.count(b"|") / some,
        sum(c in symbols for c in raw) / size, sum(c in b"!.?" for c in raw) / some, n / n_lines, n_lines if n else 0, len(set(words)) / some, max(Counter(words).values(), default=0) / some,
        sum(a == b for a, b in zip(words, words[1:])) / some, 1 - len(set(lines)) / n_lines if n else 0, 1 - len(set(triples)) / len(triples) if triples else 0, sum(len(w) > 20 for w in own) / some,
        sum(sum(k in upper_at for k in range(a, b)) >= max(2, (b - a) / 3) for a, b in spans) / some, sum(c <= 8 or 14 <= c <= 31 or c == 127 or c >= 240 for c in raw) / size,
    ]


def test_statistics_are_those_of_a_slow_version(prose_of, odd_rows):
    r = random.Random(12)
    parts = ["the ", "The ", "THE ", "ÀÉ ", "é", "!!", "| ", "\n", "\n\n", " ", "12 ", "a|b ", "x" * 25 + " ", "😀", "\x07", "the cat sat ", "#$% ", "end. "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(300)] + [t or "" for _, t in odd_rows if len(t or "") < 10_000] + [prose_of(r, "aa", 60)]
    coded = [t.encode() for t in texts]
    got = Q.statistics(np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in coded])]))
    for text, row in zip(texts, got):
        assert dict(zip(Q.STATISTICS, row)) == pytest.approx(dict(zip(Q.STATISTICS, slow_statistics(text)))), text
