from pyspark.sql import functions as F

import corpus_pipeline
from occuflow.llm import quality


def test_stages_take_effect(spark, tmp_path, make_docs):
    clean = [f"the river {i} and the green stone {i} of house {i} with light for tree {i} under a walk {i * 7}" for i in range(40)]
    passage = "benchmark question number one asks for the sum of two odd numbers and their product"
    texts = [*clean, clean[0], " ".join(["junk$$$"] * 60), f"{clean[1]} {passage}", f'of the key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and the end', None]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "secret scans":
            assert "04dbebab" not in "".join(r["text"] for r in docs.collect())
    n = len(clean)
    assert kept[0] == {*range(n + 1), n + 2, n + 3}
    assert kept[1] == {*range(n), n + 2, n + 3}
    assert kept[2] == kept[3] == kept[4] == {*range(n), n + 3}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]
    assert quality.KEEP == 0.5


def test_odd_rows(spark, tmp_path, make_docs):
    clean = [f"the river {i} and the green stone {i} of house {i} with light for tree {i} under a walk {i * 7}" for i in range(40)]
    passage = "benchmark question number one asks for the sum of two odd numbers and their product"
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(None, clean[3]), (None, f"{clean[9]} {passage}"), (None, "a text without an id and of no other, for the light of the house"), (5, clean[5]), (5, f"{clean[6]} {passage} and the end of it"), (77, None), (78, ""), (79, "the end of the key " * 9000 + f'token = "{token}"'), (None, None)]
    docs = make_docs(clean, [(i, t, None, None, None) for i, t in rows])
    names = ("key_", "spans", "quality_score", "votes", "component_id", "bucket", "row", "item_id", "mark")
    for c in names:
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        assert left.columns == docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "")[:30]) for r in left.collect()), key=repr)
    want = sorted([*((i, t[:30]) for i, t in enumerate(clean)), (None, rows[2][1][:30]), (79, rows[7][1][:30])], key=repr)
    assert got == want and all(r[c] == "mine" for r in left.collect() for c in names)
    assert token not in "".join(r["text"] for r in left.collect())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in left.collect()}


def test_empty_tables(spark, tmp_path, make_docs):
    make_docs(["a"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
