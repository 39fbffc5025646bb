"""The scorer's training set is drawn from distinct texts, however many copies the table has."""

import pytest

from byteloom.llm import quality_classifier


@pytest.mark.parametrize(("distinct", "copies", "want"), [(20, 500, 20), (400, 5, 50), (1, 3000, 1)])
def test_copies_leave_the_sample_whole(spark, monkeypatch, distinct, copies, want):
    sizes = []
    train = quality_classifier.train
    monkeypatch.setattr(quality_classifier, "train", lambda rows: (sizes.append(len(rows)), train(rows))[1])
    docs = spark.range(distinct * copies).selectExpr("id AS doc_id", f"concat('word', id % {distinct}, repeat(concat(' text', id % {distinct}), 1 + id % {distinct})) AS text").repartition(3)
    _, w, _ = quality_classifier.fit(docs, sample=50)
    assert sizes == [want] and w.any()
