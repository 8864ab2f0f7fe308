import random

import corpus_pipeline
from quillon.llm import minhash_dedup as M
from quillon.llm.queries import ORACLE, QUERIES


def test_stages_and_queries():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in QUERIES and set(ORACLE) <= set(QUERIES)
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10


def test_pipeline(spark, prose_of, tmp_path):
    r = random.Random(8)
    rows = []
    for k in range(160):
        lang = "aa" if k % 2 else "bb"
        text = prose_of(r, lang, r.randint(20, 60))
        if k % 10 == 3:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if k % 20 == 7:
            text = "12 34 !!"
        rows.append((k, text, lang, f"src{k % 3}", len(text)))
    rows += [(1000 + k, rows[k][1], rows[k][2], "src0", rows[k][4]) for k in (0, 1, 2, 4)] + [(2000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k % 10 != 3), 0) for k in range(0, 160) if k % 20 != 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        docs = after
    left = {x[0] for x in docs.select("doc_id").collect()}
    assert left == {k for k in range(160) if k % 10 != 3 and k % 20 != 7}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} == left
    assert M.dedup_query(docs).filter("not kept").count() == 0


def test_pipeline_of_nothing_and_of_odd_rows(spark, odd_rows, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(i, t, "aa", "src", len(t or ""), "x") for i, t in odd_rows]
    for name, own, labels in (("none", [], []), ("odd", rows, [(903, 1, 0), (905, 1, 0), (904, 0, 0), (None, None, None)])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, f"{tmp_path}/odd")
        assert after.columns == docs.columns
        docs = after
    left = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert not {i for i, _ in left} & {900, 901, 902, 904} and sum(t == odd_rows[5][1] for _, t in left) == 1
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {x["doc_id"] for x in out} == {i for i, _ in left}
    bins = {}
    for x in out:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in bins.values():  # no gap, no overlap, nothing beyond a sequence
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 2048
