"""The pipeline on planted cases, against the plain definition of each stage."""

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import documents, odd_texts, prose
from tests.llm.test_dedup import exact_expected, near_expected
from tests.llm.test_text import junk
from trialspark.llm import bpe


def test_stages_and_run(spark, tmp_path):
    items = [prose(700 + k, 25) for k in range(3)]
    texts = [junk(k, 70) if k % 8 == 0 else prose(k, 70) for k in range(240)]
    bad = {k for k in range(240) if k % 8 == 0}
    texts += [texts[k].replace(" ", "  ") for k in (1, 2, 3, 3)]  # exact copies, longer: they stay
    for k in (5, 6, 7):  # near copies: one word differs
        words = texts[k].split()
        texts.append(" ".join([*words[:30], "harboured", *words[31:]]))
    leaky = {len(texts) + k for k in range(3)}
    texts += [f"{prose(300 + k, 60)}\n{items[k].upper()}\n{prose(400 + k, 20)}" for k in range(3)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k not in bad)) for k in range(240) if k % 5 < 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in enumerate(texts) if i not in bad]
    exact = exact_expected(left)
    left = [(i, t) for i, t in left if exact[i][0] == i]
    near = near_expected(left, 5, 80)
    left = {i: t for i, t in left if near[i][1] == i and i not in leaky}

    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == left and len(rows) == len(left)
    assert all(r["round_trip"] for r in rows)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(corpus_pipeline.RANKS), special_tokens={})
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"]) for r in rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == columns
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, null and very long texts, repeated rows, clashing names; no labels and no benchmark."""
    docs = documents(spark, odd_texts(), [None, None, *range(len(odd_texts()) - 2)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.good_quality(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.exact_duplicates(spark, docs, str(tmp_path)).count() == len(exact_groups_of(odd_texts()))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r["round_trip"] for r in rows) and all(r["score"] == "clash" for r in rows)


def exact_groups_of(texts):
    return {"".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r") for t in texts}
