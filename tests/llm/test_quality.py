"""Pairwise quality ranking: held-out labels, the threshold's quantile, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import common, quality, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    labels = common.table(spark, FOLDER, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return queries.op12_quality(spark, FOLDER).join(labels, "doc_id").toPandas()


def test_held_out_labels(judged):
    for part in (judged[judged.held_out], judged[~judged.held_out]):
        assert (part.predicted == part.quality).mean() >= 0.95
        good, bad = part.score[part.quality == 1].to_numpy(), part.score[part.quality == 0].to_numpy()
        assert (good[:, None] > bad[None, :]).mean() >= 0.98


def test_threshold_is_the_quantile_of_the_labels(judged):
    """Below the threshold lie as many learnt rows as are bad, but for ties."""
    learnt = judged[~judged.held_out]
    assert abs((learnt.score < quality.THRESHOLD).sum() - (learnt.quality == 0).sum()) <= 1
    assert ((learnt.score >= quality.THRESHOLD) == (learnt.predicted == 1)).all()


def test_scores_do_not_depend_on_ids_or_neighbours(spark):
    docs = common.table(spark, FOLDER, "documents").limit(50)
    x = np.array([quality.features(t or "") for t in docs.toPandas().text])
    model = quality.fit(np.arange(50) % 2 == 0, x)
    score = lambda df: {r.text: r.score for r in quality.score(quality.describe(df), model).collect()}
    assert score(docs.repartition(7).withColumn("doc_id", F.lit(1))) == score(docs.coalesce(1))


def test_edge_cases(spark):
    rows = [(1, None, "a", 5), (2, "", "a", 5), (3, "x" * 300_000 + "!", "a", 5), (None, "é\x00 \U0001f600", None, 5), (1, None, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, score string, c0 int")
    described = quality.describe(docs)
    assert described.columns == ["doc_id", "text", "score", "c0", "features"]
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id int, quality int")
    model = quality.train(quality.labelled(described, labels))
    out = quality.score(described, model).collect()
    assert [set(r.asDict()) for r in out] == [{"doc_id", "text", "c0", "score", "predicted"}] * 5
    assert all(abs(r.score - quality.THRESHOLD) < 1e-9 for r in out)
    empty = quality.describe(docs.limit(0))
    known = quality.labelled(empty, labels.limit(0))
    assert quality.score(empty, quality.train(known)).collect() == []


def test_several_labels_and_repeated_rows(spark):
    docs = spark.createDataFrame(
        [(i, ("Fine words here. " if i % 2 else "### %%% $$$ ") * (1 + i % 5)) for i in range(80)] * 2, "doc_id int, text string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(i, 0) for i in range(0, 80, 2)], "doc_id int, quality int")
    described = quality.describe(docs, keep_text=False)
    out = quality.score(described, quality.train(quality.labelled(described, labels))).collect()
    assert len(out) == 160
    assert all(r.predicted == r.doc_id % 2 for r in out)
