"""Rows that were lost, doubled or refused: multiplied rows, formats without row numbers, repeated ids, empty tables."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, prose
from tests.llm.test_text import junk
from trialspark.llm import exact_dedup, quality, queries
from trialspark.llm.common import limit_batches


def test_multiplied_rows_keep_one_of_a_group(spark, tmp_path):
    documents(spark, [prose(1, 30), prose(1, 30), prose(2, 30)]).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert exact_dedup.one_row_a_place(docs) and exact_dedup.one_row_a_place(docs.where("doc_id > 0").select("doc_id", "text"))
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert not exact_dedup.one_row_a_place(twice)
    assert not exact_dedup.one_row_a_place(docs.where(F.rand() > 0.5))
    assert not exact_dedup.one_row_a_place(docs.unionByName(docs))
    rows = exact_dedup.exact_groups(twice).collect()
    assert sorted((r.group_size, r.kept) for r in rows) == [(2, False), (2, True), (4, False), (4, False), (4, False), (4, True)]
    assert exact_dedup.keep_first(twice).count() == 2
    assert exact_dedup.keep_first(docs.unionByName(docs)).count() == 2


def test_exact_dedup_reads_json(spark, tmp_path):
    documents(spark, [prose(1, 30), prose(1, 30), None, ""]).write.json(f"{tmp_path}/d")
    docs = spark.read.schema("doc_id long, text string, key string").json(f"{tmp_path}/d")
    assert sorted((r.doc_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()) == [(0, 2, True), (1, 2, False), (2, 2, True), (3, 2, False)]


def test_quality_fit_has_its_bound_whatever_the_ids(spark, monkeypatch):
    """3,000 rows of one id in both tables: two rows for the fit, one positive and one unlabelled."""
    docs = spark.range(3000).select(F.lit(8).cast("long").alias("doc_id"), F.lit(prose(1, 50)).alias("text"))
    labels = spark.range(3000).select(F.lit(8).cast("long").alias("doc_id"), F.lit(1).alias("quality"))
    sizes = []
    fit = quality.fit_features
    monkeypatch.setattr(quality, "fit_features", lambda p, u, prior: sizes.append((len(p), len(u))) or fit(p, u, prior))
    quality.fit(docs, labels, F.lit(True))
    assert sizes == [(1, 1)]


def test_quality_of_empty_tables_and_without_labels(spark, tmp_path):
    docs, labels = documents(spark, [prose(1, 30), None]), spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    assert not model.trained and {r[0] for r in docs.select(quality.score("text", model)).collect()} == {0.5}
    other = spark.createDataFrame([(77, 1)], "doc_id long, quality int")  # a label without its document
    assert not quality.fit(docs, other, F.lit(True)).trained
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.op2_quality(spark, str(tmp_path)).collect() == []


def test_quality_scores_equal_a_plain_fit(spark, tmp_path):
    """The query against the risk written out: same rows, plain gradient steps on the same features."""
    texts = [junk(k, 60) if k % 3 == 0 else prose(k, 60) for k in range(300)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(0, 300, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in queries.op2_quality(spark, str(tmp_path)).collect()}
    import zlib

    fold = [k for k in range(300) if zlib.crc32(str(k).encode()) % 4 != 2]
    x = np.array([quality.features(t) for t in texts])
    known = [k for k in fold if k % 2 == 0]
    good = [k for k in known if k % 3]
    model = quality.fit_features(x[good], x[fold], len(good) / len(known))
    want = model.score(x)
    assert all(abs(rows[k].score - want[k]) < 1e-6 for k in range(300))
    assert [rows[k].held_out for k in range(300)] == [k not in set(fold) for k in range(300)]
    held = [k for k in range(300) if rows[k].held_out]
    assert np.mean([rows[k].predicted == int(k % 3 != 0) for k in held]) > 0.95
    limit_batches(spark)
