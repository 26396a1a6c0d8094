from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stationlake.llm import language_id, queries


def test_held_out_accuracy(spark, sf_dir):
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    got = queries.op8_language_id(spark, sf_dir)
    assert got.count() == labelled.count()
    told = {r["lang"] for r in labelled.filter("lang is not null").select("lang").distinct().collect()}
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in told or r["lang_pred"] == "und")
    letters = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    held = got.filter("held_out").join(letters, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert held[0] > 0.9 and held[1] < 0.1


def test_label_is_no_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, F.col("doc_id") % 2 == 0)
    stripped = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s"), "doc_id": F.col("doc_id") + 7})
    a = [(r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).orderBy("doc_id").collect()]
    b = [(r["lang_pred"], r["score"]) for r in language_id.predict(stripped, model).orderBy("doc_id").collect()]
    assert a == b


def test_nearest_centroid_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, F.lit(True))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language_id.predict(docs, model).collect():
        v = language_id.counts(texts[r["doc_id"]], len(model.idf))
        if v is None:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        x = v * model.idf
        likeness = model.centroids.astype(np.float64) @ (x / np.sqrt((x * x).sum()))
        assert abs(likeness.max() - r["score"]) < 1e-5
        assert r["lang_pred"] in {model.languages[k] for k in np.flatnonzero(likeness > likeness.max() - 1e-5)}


def test_rejects_what_is_far(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, F.lit(True))
    other = spark.createDataFrame([(1, "слово не воробей вылетит не поймаешь"), (2, "漢字かな交じり文の文章です")], "doc_id long, text string")
    assert all(r["rejected"] for r in language_id.predict(other, model).collect())
    assert language_id.keep_known(other, model).count() == 0


def test_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, F.lit(True))
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "12 34 !!", "x"), (4, "² ½ _", "x"), (None, "the and of it " * 50_000, "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string").withColumn("score", F.lit("clash"))
    got = language_id.predict(odd, model).collect()
    assert len(got) == 6 and sum(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in got) == 5
    assert language_id.keep_known(odd, model).columns == odd.columns
    assert language_id.predict(odd.limit(0), model).count() == 0
    nothing = language_id.fit(docs, F.lit(False))
    assert nothing.languages == [] and {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.fit(unlabelled, F.lit(True)).languages == []


def test_sample_is_bounded(spark, monkeypatch):
    """Whatever the rows of a language, about twice the wanted ones are ranked; a row repeated without end is one."""
    docs = spark.range(8000).selectExpr("id as doc_id", "concat('mot et mots ', id) as text", "if(id % 4 = 0, 'de', 'fr') as lang")
    hot = spark.range(8000).selectExpr("cast(null as long) as doc_id", "'le mot' as text", "'fr' as lang")
    counted, settle = {}, language_id.settle

    def counting(df, name):
        counted[name] = (back := settle(df, name)).groupBy().count().first()[0]
        return back

    monkeypatch.setattr(language_id, "settle", counting)
    assert set(language_id.fit(docs.union(hot), F.lit(True), sample_per_language=100).languages) == {"de", "fr"}
    assert counted["language-sample"] <= 200 and counted["language-draw"] < 500
