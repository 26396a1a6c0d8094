from __future__ import annotations

import corpus_pipeline
from stationlake.llm import language_id, secret_scan
from test_ngram_join import brute_force
from test_packing import check


def test_run_matches_brute_force(spark, sf_dir):
    """Each stage redone plainly over all rows: predictions as they are, near duplicates by all pairs, secrets by the scanner,
    and every id of every text that is left in one sequence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, corpus_pipeline.learned_from())
    rejected = {r["doc_id"] for r in language_id.predict(docs, model).filter("rejected").collect()}
    kept = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in rejected]
    classes = brute_force(kept)
    scanner, texts = secret_scan.Scanner(), {}
    for i, text in kept:
        if classes[i][0] == i:
            data = (text or "").encode()
            for _, _, stop, value in sorted(scanner.spans(data), key=lambda s: -s[3]):
                data = data[:value] + b"[SECRET]" + data[stop:]
            texts[i] = data.decode()
    assert len(texts) < len(kept)
    assert check(corpus_pipeline.run(spark, sf_dir).collect(), texts) < 0.05


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        assert after.count() <= docs.count()


def test_few_clean_documents_are_lost(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = docs.filter(docs["text"].rlike(r"\p{L}"))
    kept = corpus_pipeline.known_languages(spark, docs, sf_dir)
    assert letters.join(kept, "doc_id", "left_anti").count() <= 0.02 * letters.count()


def test_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = "the same text of some words that is long enough to be told apart"
    odd = spark.createDataFrame([(None, text, "en", "s", None), (900_001, None, None, None, None), (900_002, text, "en", "s", 1), (900_002, text, "en", "s", 1)], docs.schema)
    stay = corpus_pipeline.without_near_duplicates(spark, odd, sf_dir).collect()
    assert sorted((r["doc_id"] for r in stay), key=str) == [900_001, 900_002]
    other = "quite another text whose words are all new but which has an id that is known already, so it is judged by itself"
    rows = [(1, text, "en", "s", 1), (1, text, "de", "s", 1), (1, other, "en", "s", 1), (2, text, "en", "s", 1), (3, text + " now", "en", "s", 1), (3, other, "en", "t", 1), (1, other, "en", "s", 1)]
    stay = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()
    assert sorted((r["doc_id"], r["lang"], r["text"]) for r in stay) == sorted([(1, "en", text), (1, "de", text), (1, "en", other)])
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
