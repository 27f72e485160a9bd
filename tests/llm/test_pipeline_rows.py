"""Stages of the pipeline on null and repeated ids and clashing names."""

import corpus_pipeline

TEXT = " ".join(f"word{i}" for i in range(120))
OTHER = " ".join(f"other{i}" for i in range(120))
THIRD = " ".join(f"third{i}" for i in range(120))


def test_near_stage_judges_rows(spark):
    rows = [
        (1, TEXT, "a"), (1, TEXT, "a"), (1, OTHER, "a"), (None, THIRD, "a"), (None, THIRD + " end", "b"),
        (2, TEXT + " end", "b"), (3, "", "b"), (4, None, None), (5, "alone", "b"), (5, "alone", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, NEAR_KEY string")
    out = corpus_pipeline._near(spark, docs, "")
    assert out.columns == docs.columns
    found = [tuple(r) for r in out.collect()]
    assert set(found) <= set(rows) and len(found) == len(set(found))
    texts = [t for _, t, _ in found]
    assert sum(t in (TEXT, TEXT + " end") for t in texts) == 1
    assert sum(t in (THIRD, THIRD + " end") for t in texts) == 1
    assert texts.count(OTHER) == texts.count("alone") == texts.count("") == texts.count(None) == 1
    assert len(found) == 6
    assert corpus_pipeline._near(spark, docs.limit(0), "").count() == 0
