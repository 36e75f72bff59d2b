"""The pipeline's cutoffs are proven on labels that its classifier was not fitted to."""

import zlib

from pyspark.sql import functions as F


def test_cutoffs_see_held_out_labels_only(spark, tmp_path, docs, labels, monkeypatch):
    import corpus_pipeline
    from tidewatch.llm import rules

    where = str(tmp_path)
    many = labels.unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    many.write.parquet(f"{where}/labels.parquet")
    seen = []
    monkeypatch.setattr(rules, "keep", lambda frame, held: seen.append(held) or frame)
    corpus_pipeline.check_rules(spark, docs, where)
    ids = {r.doc_id for r in seen[0].collect()}
    assert ids == {r.doc_id for r in many.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert 40 < len(ids) < 90


def test_cutoffs_need_no_labels_at_all(spark, tmp_path, docs, labels):
    """Without a held-out label the base rules alone decide."""
    import corpus_pipeline

    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.check_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
