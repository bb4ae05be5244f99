"""The pipeline on a small fixture, stage by stage against plain rules."""

import corpus_pipeline as c
from samples import letters
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    rows = [(i, f"clean document {letters(i)} " + " ".join(letters((i * 70 + k * k) % 997) for k in range(60)), "en", "s", 0) for i in range(60)]
    rows += [(i, t.replace("clean", "moron idiot filthy"), *r) for i, t, *r in [(100 + r[0], r[1] + f" z{r[0]}", *r[2:]) for r in rows[:40]]]
    item = " ".join(f"bench{k}" for k in range(20))
    rows += [(200, f"before it {item} after it", "en", "s", 0), (201, rows[0][1], "en", "s", 0), (202, "mail me at a.b@c.org now please", "en", "s", 0), (203, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(100 <= i < 140), 1) for i, *_ in rows if i < 200], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = {i for i, *_ in rows}, sorted(docs.columns)
    gone = {"toxicity": set(range(100, 140)), "simhash": {201}, "decontamination": {200}, "pii": set(), "byte_bpe": set()}
    for k, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept -= gone[name]
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(kept)
        if k < len(c.STAGES) - 1:
            assert sorted(docs.columns) == columns
        if name == "pii":
            assert docs.filter("doc_id = 202").first().text == "mail me at [EMAIL] now please"
            assert docs.filter("doc_id = 5").first().text == rows[5][1]
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    for _, stage in c.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path)).count() == 0
    assert c.run(spark, str(tmp_path)).count() == len(kept)
