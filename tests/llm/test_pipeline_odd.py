"""The pipeline on odd rows and on none: it ends, and keeps clean documents."""

from test_llm import odd_rows

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, KIND).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one window of a test item that no document here holds at all"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows_and_none(spark, tmp_path):
    rows = [tuple(r[:5]) for r in odd_rows()]
    rows += [(100 + k, f"you are a stupid worthless idiot number {k} and everyone hates such vermin", "en", "s", 70) for k in range(30)]
    rows += [(200 + k, f"a quiet walk along river {k} with bread, cheese and an old map of town {k * 7}", "en", "s", 70) for k in range(30)]
    labels = [(100 + k, 0, 1) for k in range(30)] + [(200 + k, 1, 0) for k in range(30)] + [(None, 1, 1), (0, None, None)]
    out = corpus_pipeline.run(spark, written(spark, tmp_path / "odd", rows, labels)).collect()
    kept = {r.doc_id for r in out}
    assert {0, 1, 3, 4} <= kept and not any(k in kept for k in range(100, 130)), kept
    assert all(r.length <= 1024 for r in out)
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [], [])).count() == 0
