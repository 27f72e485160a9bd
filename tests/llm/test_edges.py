"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modelpulse.llm import (
    bpe_automaton, embeddings, licenses, line_dedup, minhash, mixing, quality_rules, resampling, token_counts, toxicity,
)
from modelpulse.llm.pretokens import load
from modelpulse.llm.queries import BPE_FILE

SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint, kept string, n_words string, id string, t string"
PROSE = " ".join(f"word{k} the{'m' * (k % 7)} part{k} and unit{k} with" for k in range(40))
LONG = "\n".join(f"line {k} with the words that be of no other place {k * 7}" for k in range(20_000))
PASSAGE = "\n".join(f"shared line {k} of a passage that stands in both the documents here" for k in range(8))
ROWS = [
    (1, PROSE, "a", None, None), (2, PROSE, "a", "en", 5), (2, PROSE, "a", "en", 5), (3, "", "b", None, 0),
    (4, None, "b", None, None), (5, None, None, None, None), (6, "  \n\t ", "b", None, 1), (7, LONG, "b", "en", 9),
    (8, PASSAGE + "\nends one way", "a", "en", 1), (9, "starts another\n" + PASSAGE, None, "en", 1), (None, PROSE, "a", "en", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_near_duplicates(docs, none):
    found = by_id(minhash.near_duplicates(docs))
    assert set(found) == set(range(1, 10))
    assert found[2]["component_id"] == 1 and not found[2]["kept"] and found[1]["kept"]
    assert all(found[i]["component_id"] == i for i in (3, 4, 5, 6, 7))
    assert minhash.near_duplicates(none).count() == 0


def test_tokens(spark, docs, none):
    path = public_tokenizers.path(BPE_FILE)
    machine = bpe_automaton.compiled(spark, path)
    encoded = bpe_automaton.encode(docs, "text", machine)
    rows = encoded.withColumn("n", F.size("ids")).withColumn("back", bpe_automaton.decode("ids", machine)).collect()
    counted = token_counts.count_tokens(spark, docs, "text", path).collect()
    assert len(rows) == len(counted) == len(ROWS)
    assert sorted((r["doc_id"] or 0, r["n"]) for r in rows) == sorted((r["doc_id"] or 0, r["n_tokens"]) for r in counted)
    assert all(r["n"] == 0 and r["back"] == "" for r in rows if r["doc_id"] in (3, 4, 5, 6))
    assert {r["kept"] for r in rows} == {"x"} and {r["over_limit"] for r in counted if r["doc_id"] == 7} == {True}
    assert bpe_automaton.encode(none, "text", machine).count() == 0
    assert token_counts.count_tokens(spark, none, "text", path).count() == 0


def test_lines_of_a_very_long_text(docs):
    found = by_id(line_dedup.dedup_lines(docs.where("doc_id = 7")))
    assert found[7]["text"] == LONG


def test_lines(docs, none):
    docs = docs.where("doc_id is null or doc_id <> 7")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == len(ROWS) - 1
    found = {r["doc_id"]: r for r in rows}
    assert found[9]["text"] == "starts another" and found[9]["n_removed"] == 8 and found[8]["n_removed"] == 0
    assert found[4]["text"] is None and found[4]["n_lines"] == 0 and found[3]["n_lines"] == 1
    assert found[None]["text"] == PROSE
    assert line_dedup.dedup_lines(none).count() == 0


def test_rules(docs, none):
    rows = quality_rules.apply_rules(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r for r in rows}
    assert found[1]["kept"] and found[1]["n_words"] == 240
    assert all(found[i]["base_failed"] and not found[i]["kept"] and found[i]["n_words"] == 0 for i in (3, 4, 5, 6))
    assert found[7]["n_words"] == 12 * 20_000
    assert quality_rules.apply_rules(none).count() == 0


def test_mix(docs, none):
    taken, sizes, targets = mixing.mix(docs, F.array("source"), mixing.word_count("text"))
    assert {"kept", "n_words", "id", "size", "copies", "taken"} <= set(taken.columns)
    rows = taken.collect()
    assert len(rows) == len(ROWS) and sum(sizes.values()) == sum(r["size"] for r in rows)
    assert all(targets[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(none, F.array("source"), mixing.word_count("text"))[0].count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    for given in (labels, labels.limit(0)):
        rows = toxicity.score(docs, toxicity.fit(docs, given)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_resampling(docs, none):
    targets = docs.where("doc_id in (1, 2)").select("doc_id")
    rows = resampling.resample(docs, targets, 0.5).collect()
    assert len(rows) == len(ROWS)
    assert all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert all(not r["kept"] for r in rows if r["doc_id"] is None)
    assert resampling.resample(none, targets.limit(0), 0.5).count() == 0


def test_licenses(spark, docs, none):
    name, wordings = sorted(licenses.TEMPLATES.items())[0]
    noted = spark.createDataFrame(
        [(20, "code\n" + wordings[0].upper() + "\nmore"), (21, wordings[0] + "\n" + wordings[0]), (22, None)], "doc_id bigint, text string"
    )
    found = by_id(licenses.scan(noted))
    assert found[20]["license"] == name and found[20]["dice"] == 1.0 and found[20]["n_notices"] == 1
    assert found[21]["n_notices"] == 2 and found[22]["license"] is None and found[22]["licenses"] == []
    assert set(by_id(licenses.scan(docs))) == set(range(1, 10))
    assert licenses.scan(none).count() == 0


def test_vectors(spark):
    vectors = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.99, 0.05, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]),
        (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (9, [0.0, 1.0, 0.0]),
        (10, [0.0, 1.0, 0.0]), (10, [0.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (11, [1.0]), (12, []),
    ]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], "vec_id bigint, embedding array<double>, rep string, v string")
    found = by_id(embeddings.near_vectors(df), "vec_id")
    assert set(found) == set(range(1, 13))
    assert [found[i]["n_links"] for i in (1, 2, 3, 9, 10)] == [2, 2, 2, 1, 1]
    assert found[3]["component_id"] == 1 and found[10]["component_id"] == 9
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (4, 5, 6, 7, 8, 11, 12))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_long_texts_without_blanks_are_counted_like_the_library():
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    letters = ["a", "ab", "aab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz0123456789éß"]
    texts = ["".join(rng.choice(of) for _ in range(n)) for of in letters for n in (1_023, 1_024, 1_025, 6_000)]
    texts += ["ab" * 3_000, "é" * 2_000, "x " + "z" * 1_500 + " y", "".join(rng.choice("etaoin") for _ in range(200_000))]
    library = Tokenizer.from_file(path)
    wanted = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter(load(path)).count(texts) == wanted
