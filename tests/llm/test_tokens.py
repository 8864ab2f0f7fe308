"""Packing, token store, piece sampling, search, sharding."""

import heapq
import random
import tracemalloc
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quillon.llm import exact_search as S
from quillon.llm import packing as K
from quillon.llm import piece_sampling as G
from quillon.llm import rans_store as R
from quillon.llm import sharding as H
from quillon.llm.common import Scratch
from quillon.llm.word_ids import WordIds

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library_ids(path, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [x.ids for x in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("path", "leads"), [(BYTE, True), (WORD, False)])
def test_word_ids_are_the_librarys(path, leads, odd_rows, prose_of):
    r = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "\n ", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "a", "Bc", "'s", "é", "É", "ß", "1", "22", ".", "!?", "_", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "日本", "́", "İ", "ﬁ", "Σ", "x'"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)] + [t or "" for _, t in odd_rows] + [prose_of(r, "bb", 50) for _ in range(20)]
    words = WordIds(path, leads)
    want = [array("I", x).tobytes() for x in library_ids(path, texts)]
    assert words.ids(texts) == want and words.ids(texts) == want


def test_packing(spark, prose_of, odd_rows, with_clashes, monkeypatch):
    monkeypatch.setattr(K, "ISLAND", 60)
    r = random.Random(2)
    rows = [(k, prose_of(r, "aa", r.randint(1, 25))) for k in range(200)] + odd_rows
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    out = K.packing_query(docs, BYTE, Scratch(spark, "test"), capacity=64).collect()
    want = Counter()
    total = 0
    for (i, t), ids in zip(rows, library_ids(BYTE, [t for _, t in rows])):
        ids = [*ids, 0]
        total += len(ids)
        at, step, piece = 0, len(ids) if len(ids) <= 64 else len(ids) % 64 or 64, 0
        while at < len(ids):
            want[i, piece, at, step, zlib.crc32(array("I", ids[at : at + step]).tobytes())] += 1
            at, step, piece = at + step, 64, piece + 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out) == want
    bins = defaultdict(list)
    for x in out:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) <= 64
    assert len(bins) <= 1.02 * -(-total // 64) + 2
    assert K.packing_query(docs.limit(0), BYTE, Scratch(spark, "test")).count() == 0


def test_genetic_search_betters_best_fit():
    random_ = np.random.default_rng(1)
    size = random_.integers(500, 800, 3000)
    plain = K.fresh_packing(size, 2048, random_, 0.0)
    best = K.evolve(size, 2048, 1)
    again = K.evolve(size, 2048, 2, best.bin_of, K.elite_lists(best, size, 2048))
    assert len(again.fill) <= len(best.fill) < len(plain.fill)
    for packing in (plain, best, again):
        assert packing.fill.max() <= 2048 and (np.bincount(packing.bin_of, size) == packing.fill).all()
    child = K.crossover(plain, best, size, 2048, random_)
    assert child.fill.max() <= 2048 and len(child.bin_of) == len(size)


def test_coder_round_trip_and_checkpoints():
    random_ = np.random.default_rng(1)
    coder = R.Coder(R.shared_frequencies(random_.zipf(1.3, 5000)))
    assert int(coder.frequency.sum()) == 1 << R.PRECISION and coder.frequency.min() >= 1
    for n in (0, 1, 1023, 1024, 1025, 300_000):
        ids = np.minimum(random_.zipf(1.2, n), 4999)
        state, words, marks = coder.encode(ids)
        assert (coder.decode(n, state, words) == ids).all()
        for step, at, own in marks:
            assert (coder.decode(n, own, words, step, at) == ids[step * R.LANES :]).all()
    assert marks
    a, b = b"hello" * 99, b"world" * 77
    assert R.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_store(spark, prose_of, odd_rows, with_clashes, monkeypatch):
    r = random.Random(3)
    rows = [(k * 7 % 101, prose_of(r, "aa", r.randint(0, 40))) for k in range(101)] + [x for x in odd_rows if x[0] is not None]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    scratch = Scratch(spark, "test")
    path = scratch.path("store")
    R.write_store(docs, path, WORD, scratch)
    out = sorted(map(tuple, R.read_documents(spark, path, scratch).collect()))
    at, want = 0, []
    for (i, _), ids in sorted(zip(rows, library_ids(WORD, [t for _, t in rows])), key=lambda x: x[0][0]):
        ids = [*ids, 1]
        want.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert out == want
    block = spark.read.parquet(f"{path}/blocks").first().asDict()
    coder = R.Coder(np.frombuffer(spark.read.parquet(f"{path}/frequencies").first()[0], "<u4"))
    whole = R.decode_block(coder, block)
    if block["checkpoints"]:
        assert (R.decode_block(coder, block, 0) == whole[R.CHECKPOINT * R.LANES :]).all()
        with pytest.raises(ValueError, match="checksum"):
            R.decode_block(coder, {**block, "checkpoints": block["checkpoints"][:16] + b"\1" + block["checkpoints"][17:]}, 0)
    for start, n in ((0, 5), (len(whole) // 2, 70_000), (len(whole) - 3, 10), (0, 1 << 30)):
        parts = sorted(map(tuple, R.read_span(spark, path, block["segment"], start, n).collect()))
        assert parts[0][0] == start and parts[0][1] == whole[start : start + n].tolist()[: len(parts[0][1])]
        assert all(a[0] + len(a[1]) == b[0] for a, b in zip(parts, parts[1:]))
    with pytest.raises(ValueError, match="checksum"):
        R.decode_block(coder, {**block, "crc32": block["crc32"] ^ 1})
    assert R.store_query(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string"), WORD, scratch).count() == 2
    assert R.store_query(docs.limit(0), WORD, scratch).count() == 0


def test_documents_longer_than_a_block():
    ids = [(5, 0, 10, b"abcd" * 10), (5, 10, 4, b"efgh" * 4), (6, 14, 2, b"ijkl" * 2), (6, 16, 3, b"mnop" * 3)]
    rows = [{"segment": 0, "doc_id": d, "part": p, "start": s, "length": n, "ids_crc32": zlib.crc32(x)} for (d, s, n, x), p in zip(ids, (0, 1, 0, 1))]
    import pyarrow as pa

    out = R._join_parts(None, pa.Table.from_pylist(rows)).to_pylist()
    assert [(x["doc_id"], x["start"], x["length"], x["ids_crc32"]) for x in out] == [(5, 0, 14, zlib.crc32(b"abcd" * 10 + b"efgh" * 4)), (6, 14, 5, zlib.crc32(b"ijkl" * 2 + b"mnop" * 3))]


def all_segmentations(vocabulary, text):
    """Every segmentation of a short text with its probability."""
    model, total = vocabulary.model, {(): 1.0}
    for word in G.words_of(model, text):
        own = {}

        def go(at, ids, weight, word=word, own=own):
            if at == len(word):
                own[ids] = weight
                return
            single = False
            for n in range(1, len(word) - at + 1):
                k = model.piece_to_id(word[at : at + n])
                if model.id_to_piece(k) == word[at : at + n] and not (model.is_unknown(k) or model.is_byte(k) or model.is_control(k)):
                    go(at + n, (*ids, k), weight * np.exp(vocabulary.weights[k]))
                    single |= n == 1
            if not single:
                k = vocabulary.byte_ids(word[at])
                go(at + 1, (*ids, *k), weight * np.exp(vocabulary.weights[k].sum()))

        go(0, (), 1.0)
        mass = sum(own.values())
        total = {(*a, *b): p * q / mass for a, p in total.items() for b, q in own.items()}
    return total


@pytest.mark.parametrize("text", ["ab cd", "  x", "日a𒀀", ""])
def test_samples_follow_the_lattice(text):
    random_ = np.random.default_rng(0)
    weights = np.log(random_.random(32_000) * 0.001 + 0.01)
    vocabulary = G.Vocabulary(PIECE, weights)
    exact = all_segmentations(vocabulary, text)
    n, k = 2500, 2
    found = G.sample_texts(G.Lattices(vocabulary), list(range(n)), [text] * n, k, 5)
    first, seen = Counter(), Counter()
    for samples in found:
        ids = [tuple(x[0].tolist()) for x in samples]
        assert len(set(ids)) == len(ids) == min(k, len(exact))
        assert all(np.exp(x[1]) == pytest.approx(exact[i], rel=1e-5) for x, i in zip(samples, ids))
        first[ids[0]] += 1
        seen.update(ids)
    for ids, p in exact.items():
        assert first[ids] / n == pytest.approx(p, abs=0.045)
        both = min(1.0, p + sum(q * p / (1 - q) for other, q in exact.items() if other != ids and q < 1))
        assert seen[ids] / n == pytest.approx(both, abs=0.045)
    weighted = np.mean([sum(np.exp(x[1] - x[3]) for x in samples) for samples in found])
    assert weighted == pytest.approx(1.0, abs=0.06)


def test_samples_do_not_depend_on_the_batch(prose_of, monkeypatch):
    r = random.Random(3)
    texts = [prose_of(r, "aa", n) for n in (3, 400, 20, 60, 1)] + ["", "x" * 3000, " a  b ", "日本語 𒀀𒀀"]
    vocabulary = G.Vocabulary(PIECE, np.log(np.random.default_rng(2).random(32_000) * 0.01 + 0.001))
    plain = lambda found: [[(x[0].tolist(), *x[1:]) for x in samples] for samples in found]
    whole = plain(G.sample_texts(G.Lattices(vocabulary), list(range(9)), texts, 4, 1))
    kept = G.Lattices(vocabulary)
    monkeypatch.setattr(G, "KEPT_STATES", 900)
    one_by_one = {k: plain(G.sample_texts(kept, [k], [texts[k]], 4, 1))[0] for k in reversed(range(9))}
    assert [one_by_one[k] for k in range(9)] == whole


def test_far_sets_are_opened(monkeypatch):
    vocabulary = G.Vocabulary(PIECE, np.log(np.full(32_000, 1 / 32_000)))
    monkeypatch.setattr(G, "FAR", -0.01)
    found = G.sample_texts(G.Lattices(vocabulary), [1, 2], ["the cat", "a b"], 500, 1)
    exact = [all_segmentations(vocabulary, t) for t in ("the cat", "a b")]
    assert [len({tuple(x[0].tolist()) for x in s}) for s in found] == [len(x) for x in exact]


def test_sampling_and_decoding(spark, prose_of, odd_rows, with_clashes):
    r = random.Random(4)
    rows = [(k, prose_of(r, "aa", 20)) for k in range(20)] + odd_rows
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    weights = G.piece_weights(docs, PIECE)
    drawn = G.sample(docs, PIECE, weights, k=3)
    model = G.processor(PIECE)
    texts = {i: model.decode(model.encode(t or "")) for i, t in rows if i is not None}
    decoded = G.decode(drawn, PIECE).filter("doc_id is not null").collect()
    assert all(x["text"] == texts[x["doc_id"]] for x in decoded)
    again = {(x["doc_id"], x["rank"]): tuple(x["ids"]) for x in G.sample(docs.repartition(7), PIECE, weights, k=3).collect() if x["doc_id"] is not None}
    assert again == {(x["doc_id"], x["rank"]): tuple(x["ids"]) for x in decoded}
    assert len([1 for i, _ in again if i == 901]) == 1 and len([1 for i, _ in again if i == 3]) == 3
    assert all(x["log_inclusion"] <= 1e-9 for x in decoded)
    assert G.sampling_query(docs.limit(0), PIECE).count() == 0


def test_digests_need_no_worker_besides_the_one_that_draws(spark, prose_of, odd_rows, with_clashes):
    r = random.Random(8)
    docs = with_clashes(spark.createDataFrame([(k, prose_of(r, "bb", 15)) for k in range(10)] + odd_rows, "doc_id long, text string"))
    query = G.sampling_query(docs, PIECE)
    assert query._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    drawn = G.sample(docs, PIECE, G.piece_weights(docs, PIECE)).collect()
    want = Counter((x["doc_id"], x["rank"], len(x["ids"]), zlib.crc32(array("I", x["ids"]).tobytes()), x["log_prob"], x["log_inclusion"]) for x in drawn)
    assert Counter(map(tuple, query.collect())) == want


def test_lattices_take_little_more_memory_than_they_hold(prose_of):
    vocabulary = G.Vocabulary(PIECE, np.log(np.full(32_000, 1 / 32_000)))
    words = list(dict.fromkeys(prose_of(random.Random(9), "aa", 150_000).split(" ")))
    tracemalloc.start()
    try:
        lattices = G.Lattices(vocabulary)
        lattices.numbers(words)
        assert tracemalloc.get_traced_memory()[1] < 80 * lattices.edges
    finally:
        tracemalloc.stop()


def brute_search(rows, every, k):
    own = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in own:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q and len(v) == len(own[q]))[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_search_is_brute_force(spark, with_clashes, monkeypatch, scale):
    monkeypatch.setattr(S, "SHARD", 100)
    monkeypatch.setattr(S, "QUERIES", 8)
    monkeypatch.setattr(S, "LEAF", 8)
    random_ = np.random.default_rng(2)
    rows = [(int(k), (np.round(random_.standard_normal(4), 1) * scale).tolist()) for k in range(350)]  # many ties
    rows += [(400, None), (420, []), (440, [float("nan")] * 4), (460, [0.0] * 4), (480, [1.0, 2.0]), (481, [3.0, 4.0]), (500, [None, 1.0, 1.0, 1.0])]
    df = with_clashes(spark.createDataFrame([*rows, rows[20], (None, [1.0] * 4)], "vec_id long, embedding array<double>")).repartition(3)
    got = S.top_k(df, Scratch(spark, "test"), every=20, k=20)
    assert {tuple(x) for x in got.collect()} == brute_search(rows, 20, 20) and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_search_edges(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in S.top_k(df, Scratch(spark, "test")).collect()] == [(0, 1, 1, 64 * 128)]
    assert S.top_k(df.limit(0), Scratch(spark, "test")).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 2.0]), (1, [5.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(x)[1:] for x in S.top_k(twice, Scratch(spark, "test"), k=3).orderBy("rank").collect()] == [(1, 1, 64 * 320), (2, 1, 64 * 192), (3, 1, 64 * 128)]


def test_tree_boxes_are_tight():
    random_ = np.random.default_rng(3)
    v = np.floor(64 * random_.standard_normal((500, 6)))
    tree = S.build(np.arange(500), v, 16)
    assert (tree.vectors == v[tree.ids]).all()
    for k in range(len(tree.low)):
        own = tree.vectors[tree.first[k] : tree.last[k]]
        assert (own.min(0) == tree.low[k]).all() and (own.max(0) == tree.high[k]).all()
        if tree.left[k] >= 0:
            assert (tree.first[tree.left[k]], tree.last[tree.left[k]], tree.last[tree.right[k]]) == (tree.first[k], tree.first[tree.right[k]], tree.last[k])


def test_bounds_from_elsewhere_prune_whole_trees():
    random_ = np.random.default_rng(4)
    v = np.floor(64 * random_.standard_normal((300, 5)))
    tree, q = S.build(np.arange(300), v, 8), np.floor(64 * random_.standard_normal((1, 5)))
    scores = v @ q[0]
    allowed = (np.maximum(q, 0) @ tree.high[0] + np.minimum(q, 0) @ tree.low[0]).item()
    for bound in (*np.quantile(scores, [0, 0.5, 0.9, 1]), scores.max() + 1, *np.linspace(scores.max(), allowed, 9), allowed + 1):
        _, ids, found = S.search(tree, np.array([-1]), q, np.array([bound]), 4)
        want = sorted((-s, i) for i, s in enumerate(scores) if s >= bound)[:4]
        assert [(-s, i) for s, i in zip(found, ids)] == want


def test_schedule_is_that_of_a_heap():
    random_ = np.random.default_rng(1)
    for sizes in (random_.integers(1, 50, 3000), np.append(random_.integers(1, 2000, 300), 100_000), random_.zipf(1.5, 1000) % 9000 + 1, np.full(17, 3), np.array([5]), np.append(random_.integers(1 << 17, 1 << 22, 200), [(1 << 40) + 1, 1 << 40, (1 << 17) + 1])):
        values, counts = np.unique(sizes, return_counts=True)
        plan = H.schedule(values[::-1], counts[::-1], 8)
        assert (plan.sum(1) == counts[::-1]).all()
        heap = [(0, s) for s in range(8)]
        for x in sorted(sizes.tolist(), reverse=True):
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + x, s))
        assert sorted((plan * values[::-1][:, None]).sum(0)) == sorted(x for x, _ in heap)


def test_sharding(spark, prose_of, odd_rows, with_clashes):
    r = random.Random(6)
    rows = [(k, prose_of(r, "aa", r.randint(1, 30))) for k in range(300)] + [(k, "the same") for k in range(1000, 1100)] + odd_rows + [(990, None), (991, None)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    out = H.assign(docs, Scratch(spark, "test")).collect()
    assert len(out) == len(rows) and {x["law"] for x in out} == {"bytes"} and {x["grown_shard"] for x in out} == {None}
    where = defaultdict(set)
    text = defaultdict(set)
    for i, t in rows:
        text[i].add(t)
    for x in out:
        if x["doc_id"] is not None:
            (t,) = text[x["doc_id"]]
            where[t].add(x["shard"])
            assert (x["size"], x["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert all(len(s) == 1 for s in where.values())
    for s in range(8):
        assert sorted(x["slot"] for x in out if x["shard"] == s) == list(range(sum(x["shard"] == s for x in out)))
    load = Counter()
    for x in out:
        load[x["shard"]] += x["size"]
    longest = max(len((t or "").encode()) + 1 for _, t in odd_rows)
    others = sorted(load.values())[:-1]
    assert max(load.values()) == longest and max(others) - min(others) < 40
    assert H.assign(docs.limit(0), Scratch(spark, "test")).count() == 0
