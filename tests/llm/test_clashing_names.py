"""Tables whose columns have the names that operators add or work with."""

from pyspark.sql import functions as F

from modelpulse.llm import line_dedup, mixing, quality_rules, toxicity

TEXT = " ".join(f"word{i} of the" for i in range(40))


def table(spark, *names):
    rows = [(i, TEXT if i % 2 else f"{TEXT} {i}", "a" if i % 3 else None, *(["x"] * len(names))) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string" + "".join(f", `{n}` string" for n in names))


def test_quality_rules(spark):
    docs = table(spark, "_counts", "rule_counts", "N_WORDS", "Kept")
    out = quality_rules.apply_rules(docs)
    lower = [c.lower() for c in out.columns]
    assert len(lower) == len(set(lower))
    for r in out.collect():
        assert r["_counts"] == r["rule_counts"] == "x" and r["n_words"] in (120, 121) and r["kept"] in (True, False)


def test_line_dedup(spark):
    docs = table(spark, "_gone_id", "gone_id", "Gone_Version", "line_places", "N_LINES", "id", "version", "a.b")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "source", "_gone_id", "gone_id", "Gone_Version", "line_places", "id", "version", "a.b", "n_lines", "n_removed"]
    assert {tuple(r)[3:10] for r in out.collect()} == {("x",) * 7}


def test_mix(spark):
    docs = table(spark, "_words", "words", "mix_sources", "cut_words", "SIZE", "_mix_rest", "n")
    out, sizes, targets = mixing.mix(docs, F.array("source"), mixing.word_count("text"))
    rows = out.collect()
    assert len(rows) == 12 and all(r["_words"] == r["cut_words"] == r["_mix_rest"] == "x" for r in rows)
    assert [c for c in out.columns if c.lower() == "size"] == ["size"]
    assert abs(sum(r["taken"] for r in rows) - sum(targets.values())) <= 2 * 121 and sum(sizes.values()) == sum(r["size"] for r in rows)


def test_toxicity(spark):
    docs = table(spark, "_id", "labelled_id", "SCORE")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "source", "_id", "labelled_id", "score"]
    assert all(0 <= r["score"] <= 1 for r in out.collect())
