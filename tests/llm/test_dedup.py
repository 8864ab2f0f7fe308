"""MinHash and embedding near-duplicates against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from quillon.llm import embedding_dedup as V
from quillon.llm import minhash_dedup as M
from quillon.llm.common import Scratch, components


def reach(ids, links):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows, width, percent=80):
    own = {i: shingles(t, width) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(own, 2) if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
    return {i: (len(own[i]), c) for i, c in reach(own, links).items()}


@pytest.fixture(scope="module")
def copies(prose_of):
    """A large group of near copies around the threshold, exact copies, chains, and texts on their own."""
    r = random.Random(11)
    rows = [(k, prose_of(r, "aa", r.randint(1, 60))) for k in range(120)]
    base = prose_of(r, "aa", 120).split()
    for k in range(200, 330):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(k, rows[5][1].upper().replace(" ", "\n")) for k in range(400, 440)]
    chain = prose_of(r, "bb", 80).split()
    for k in range(500, 520):
        chain = chain[2:] + [f"c{k}", f"d{k}"]
        rows.append((k, " ".join(chain)))
    return rows


def test_minhash_is_brute_force(spark, copies, odd_rows, with_clashes):
    rows, width = copies + odd_rows, 4
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    told = M.near_duplicates(docs, width).collect()
    assert len(told) == len(rows)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in told if x["doc_id"] is not None} == brute(rows, width)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in told if x["doc_id"] is not None)
    assert [x["kept"] for x in told if x["doc_id"] is None] == [True, True]


@pytest.mark.parametrize("block, crowded", [(4, 10**6), (16, 0)])
def test_minhash_in_small_blocks_is_brute_force(spark, copies, monkeypatch, block, crowded):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "CROWDED", crowded)
    told = M.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), 4).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in told} == brute(copies, 4)


def test_blocks_bring_all_components_together(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = [(k, 10, 1 if k < 40 else 2, 100 if k % 40 < 12 else 100 + k // 2) for k in range(46)]
    left = spark.createDataFrame(rows, "node long, n long, band long, component long")
    met = {}
    for x in M.Blocks(left, Scratch(spark, "test")).dealt().collect():
        met.setdefault((x["band"], x["low"], x["high"]), []).append(x)
    pairs = {(a["node"], b["node"]) for (_, low, high), own in met.items() for a in own for b in own if a["block"] == low and b["block"] == high and a["component"] != b["component"]}
    pairs |= {(b, a) for a, b in pairs}
    assert pairs == {(a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and a[3] != b[3]}
    assert max(map(len, met.values())) <= 2 * 16


def test_minhash_stage_keeps_one_of_each_group(spark, copies, with_clashes):
    docs = with_clashes(spark.createDataFrame([*copies, (None, "no id")], "doc_id long, text string"))
    kept = M.dedup_stage(docs)
    assert kept.columns == docs.columns
    assert {x[0] for x in kept.select("doc_id").collect()} == {i for i, (_, c) in brute(copies, 5).items() if i == c} | {None}
    assert M.dedup_query(docs.limit(0)).count() == 0
    assert M.dedup_query(docs.filter("doc_id = 3")).collect()[0]["kept"]


def test_minhash_stage_keeps_one_row_of_each_group(spark, prose_of, with_clashes):
    r = random.Random(23)
    a, b, c, d, e, f = (prose_of(r, "aa", 60) for _ in range(6))
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (4, c), (4, c.upper()), (5, d), (None, d), (None, e), (None, e), (None, e + " more"), (6, f), (6, f + " more"), (7, ""), (7, ""), (None, ""), (None, None)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    kept = M.dedup_stage(docs)
    assert kept.columns == docs.columns
    got = [(x["doc_id"], x["text"]) for x in kept.collect()]
    one_of = [{(1, a)}, {(2, b)}, {(4, c), (4, c.upper())}, {(5, d)}, {(None, e), (None, e + " more")}, {(6, f), (6, f + " more")}, {(7, "")}, {(None, "")}, {(None, None)}]
    assert len(got) == len(one_of) and all(sum(x in group for x in got) == 1 for group in one_of)


def test_signatures_do_not_depend_on_blocks():
    random_ = np.random.default_rng(1)
    values, offsets = random_.integers(0, 1 << 63, 500, dtype=np.uint64), np.array([0, 0, 3, 200, 200, 500])
    assert (M.minima(values, offsets) == M.minima(values, offsets, block=7)).all()


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000)]
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()
    links = [(a, b) for a, b in links if a != b]
    ids = {x for pair in links for x in pair}
    assert dict(map(tuple, got)) == reach(ids, links) and len(got) == len(ids)


def brute_vectors(rows, threshold):
    own = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[i] = (label, len(v), np.array(v, float) / np.linalg.norm(np.array(v, float)))
    links = [(a, b) for a, b in itertools.combinations(own, 2) if own[a][:2] == own[b][:2] and own[a][2] @ own[b][2] >= threshold]
    ids = [i for i, _, _ in rows if i is not None]
    count = dict.fromkeys(ids, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], c) for i, c in reach(ids, links).items()}


def test_embeddings_are_brute_force(spark, with_clashes, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    random_ = np.random.default_rng(5)
    rows = [(k, random_.standard_normal(16).tolist(), k % 3) for k in range(300)]
    centre = random_.standard_normal(16)
    for k in range(300, 420):
        rows.append((k, (centre + 0.25 * random_.standard_normal(16)).tolist(), 1))
    rows += [(k, rows[7][1], rows[7][2]) for k in range(420, 450)] + [(450, rows[7][1], 2), (451, (2.0 * np.array(rows[7][1])).tolist(), rows[7][2])]
    nan, inf = float("nan"), float("inf")
    rows += [(460, None, 1), (461, [], 1), (462, [0.0] * 16, 1), (463, [nan] * 16, 1), (464, [inf] + [0.0] * 15, 1), (465, [None] + [1.0] * 15, 1), (466, rows[7][1], None), (467, [1.0, 2.0], 1), (468, [2.0, 4.0], 1)]
    repeated = [*rows, rows[7], (None, rows[7][1], 1), (None, None, None)]
    df = with_clashes(spark.createDataFrame([(i, v, label) for i, v, label in repeated], "vec_id long, embedding array<double>, label int")).repartition(4)
    told = V.near_duplicates(df, Scratch(spark, "test"), window=8).collect()
    assert len(told) == len(repeated)
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in told if x["vec_id"] is not None} == brute_vectors(rows, 0.93)
    assert all(x["n_links"] == 0 and x["kept"] for x in told if x["vec_id"] is None)
    assert V.near_duplicates(df.limit(0), Scratch(spark, "test")).count() == 0


def test_an_id_with_several_vectors_is_all_of_them(spark):
    one, two, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, one, 1), (5, two, 1), (6, one, 1), (7, two, 1), (8, two, 1), (9, other, 1)]
    told = V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), Scratch(spark, "test")).collect()
    assert sorted(map(tuple, told)) == [(5, 2, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False), (8, 2, 5, False), (9, 0, 9, True)]


def test_more_passes_for_more_vectors():
    assert V.passes_needed(10, 0.93, 64, 1e-6) == 4 and V.passes_needed(10**4, 0.93, 64, 1e-6) < V.passes_needed(10**8, 0.93, 64, 1e-6)


def test_embeddings_of_one_cone_are_brute_force(spark):
    random_ = np.random.default_rng(8)
    centre, near = random_.standard_normal(32), lambda v, part: v + part * np.linalg.norm(v) / np.sqrt(len(v)) * random_.standard_normal(len(v))
    own = [near(centre, 0.45) for _ in range(1500)]  # mutual cosine about 0.83
    own += [near(v, 0.36) for v in own[:300]]  # about 0.94
    rows = [(k, v.tolist(), 1) for k, v in enumerate(own)]
    told = V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4), Scratch(spark, "test"), window=16).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in told} == brute_vectors(rows, 0.93)


def test_depths_are_those_of_whole_buckets():
    random_ = np.random.default_rng(9)
    code = np.sort(np.concatenate([random_.integers(0, 1 << 62, 300), random_.integers(0, 1 << 40, 90), np.full(12, 77)]))
    group, window = np.repeat([0, 1, 2], [1, len(code), 1]), 8
    told = V.depths(group, np.concatenate([[5], code, [5]]), window)
    assert told[0] == told[-1] == V.BITS + 1  # what lies before and after is not known
    for k, x in enumerate(code):
        shared = np.array([V.BITS - (int(x) ^ int(y)).bit_length() for y in code])
        fits = [d for d in range(V.BITS + 1) if np.abs(np.flatnonzero(shared >= d) - k).max() <= window]
        assert told[k + 1] == (fits[0] if fits else V.BITS + 1)


def test_partitions_hold_several_windows():
    assert V.partitions(625 * 4, 64, 200) == 4 and V.partitions(0, 64, 200) == 1 and V.partitions(10**8, 64, 200) == 200
