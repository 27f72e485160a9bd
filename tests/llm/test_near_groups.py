"""Near-duplicates in dense groups of copies, against all pairs."""

import random

import pytest

from modelpulse.llm import minhash
from tests.llm import brute


def edited(words, share, rng):
    return [f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies():
    """A group whose members lie at all distances from their original, chains of edits, equal texts, single texts."""
    rng = random.Random(4)
    base = [f"b{rng.randrange(300)}" for _ in range(160)]
    docs = {i: " ".join(edited(base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]), rng)) for i in range(240)}
    chain = [f"c{rng.randrange(300)}" for _ in range(200)]
    for i in range(300, 340):
        docs[i] = " ".join(chain)
        chain = edited(chain, 0.01, rng)
    repeated = ["again and again the same words"] * 40
    docs |= {400 + i: "\n".join(repeated[: 20 + i]) for i in range(20)}
    docs |= {500 + i: " ".join(f"s{rng.randrange(10**6)}" for _ in range(30)) for i in range(50)}
    docs |= {600: None, 601: "", 602: " \n", 603: "one", 604: " one\t"}
    return docs


@pytest.mark.parametrize("load", [minhash.BLOCK_LOAD, 8_000])
def test_dense_group_equals_all_pairs(spark, copies, monkeypatch, load):
    # A small load cuts heads, main groups and what is outside them into several blocks.
    monkeypatch.setattr(minhash, "BLOCK_LOAD", load)
    rows = [(i, t) for i, t in copies.items()]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    same = {i: " ".join((t or "").split()) for i, t in copies.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == brute.near_components(same)
    assert len(found) == len(copies) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_units_give_no_more_rows_than_texts(spark, copies):
    # Links between groups, not pairs: a dense group gives at most a row for each text in a unit.
    rows = [(i, t, 1, 0, 0, minhash.BOTH) for i, t in copies.items() if i < 240]
    units = spark.createDataFrame(rows, "id bigint, t string, bucket bigint, low bigint, high bigint, part int")
    links = minhash.linked(units.selectExpr("*", "id as g").drop("t"), units.select("id", "t"), 5, 0.8)
    assert 0 < links.count() < len(rows)


def test_text_ids_may_be_strings(spark):
    text = " ".join(map(str, range(100)))
    rows = [("b", text), ("a", text + " end"), ("c", "other words")]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {"a": "a", "b": "a", "c": "c"}
