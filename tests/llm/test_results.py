"""Every registered query over its whole table, against SQL, a library or a brute-force version."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from modelpulse.llm import mixing, resampling
from modelpulse.llm.queries import BPE_FILE, ORACLES, QUERIES
from tests.llm import brute
from tests.test_registry import plain


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(str(public_tokenizers.path(BPE_FILE)))
    made.no_padding()
    made.no_truncation()
    return made


def rows_of(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def test_all_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df, found = QUERIES[name](spark, sf_dir), con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


def test_tokens_equal_library(spark, sf_dir, library):
    docs = brute.texts(sf_dir)
    found = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op2_bpe_round_trip")}
    counted = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op5_token_counts")}
    assert set(found) == set(counted) == set(docs)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in docs.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        row, count = found[i], counted[i]
        assert row["n_tokens"] == count["n_tokens"] == len(ids)
        assert row["ids_sha256"] == digest(" ".join(map(str, ids)))
        assert row["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False))
        assert count["n_bytes"] == len((text or "").encode()) and count["over_limit"] == (len(ids) > 2048)


def test_near_duplicates_equal_all_pairs(spark, sf_dir):
    wanted = brute.near_components(brute.texts(sf_dir))
    found = rows_of(spark, sf_dir, "op1_near_duplicates")
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_vectors_equal_all_pairs(spark, sf_dir):
    given = brute.table(sf_dir, "embeddings")
    ids = given["vec_id"].tolist()
    links, component = brute.near_vectors(ids, np.array(given["embedding"].tolist(), float))
    found = {r["vec_id"]: r for r in rows_of(spark, sf_dir, "op9_near_vectors")}
    assert set(found) == set(ids)
    # No link is made up, and at least nine of ten are found.
    assert all(found[i]["n_links"] <= links[i] for i in ids)
    assert sum(r["n_links"] for r in found.values()) >= 0.9 * sum(links.values())
    assert all(found[i]["component_id"] >= component[i] for i in ids)


def test_mix_comes_near_its_targets(spark, sf_dir):
    found = rows_of(spark, sf_dir, "op7_source_mix")
    docs = brute.table(sf_dir, "documents")
    source = {i: None if s is None or s != s else s for i, s in zip(docs["doc_id"], docs["source"])}
    size = {i: len(re.findall(brute.WORD, t or "")) for i, t in brute.texts(sf_dir).items()}
    sizes, taken, longest = {}, {}, {}
    for r in found:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + size[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        longest[s] = max(longest.get(s, 0), r["size"])
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"]
    targets = brute.source_targets(sizes)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-3
    assert all(abs(taken[s] - targets[s]) <= longest[s] + 1 for s in sizes)
    assert sorted(map(str, found)) == sorted(map(str, rows_of(spark, sf_dir, "op7_source_mix")))


def test_flow_serves_overlapping_sources():
    # a can only be served by what both share, so b takes its own words.
    sent = mixing.flow({("a", "b"): 100, ("b",): 100}, {"a": 100, "b": 100})
    assert sent[("a", "b"), "a"] == 100 and sent[("b",), "b"] == 100
    # The second round through a pattern costs more than the first through another.
    sent = mixing.flow({("a",): 50, ("a", "b"): 100}, {"a": 100, "b": 50})
    assert sent[("a",), "a"] == 50 and sent[("a", "b"), "a"] == 50 and sent[("a", "b"), "b"] == 50


def test_toxic_documents_score_higher(spark):
    """On the table with some hundred toxic labels; the smaller ones hold a few dozen in all."""
    large = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in rows_of(spark, large, "op6_toxicity")}
    labels = brute.table(large, "labels").dropna(subset=["toxic"])
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(found[i]["score"], y) for i, y in zip(labels["doc_id"], labels["toxic"]) if i in found and found[i]["held_out"]]
    high, low = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    right = sum((a > b) + 0.5 * (a == b) for a in high for b in low)
    assert right >= 0.85 * len(high) * len(low)


def test_resampling_equals_plain_version(spark, sf_dir):
    found = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op8_quality_resample")}
    docs, labels = brute.texts(sf_dir), brute.table(sf_dir, "labels").dropna(subset=["quality"])
    good = set(labels["doc_id"][labels["quality"] == 1])
    raw, wanted = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    grams = {i: resampling.buckets([t or ""])[0] for i, t in docs.items()}
    for i, at in grams.items():
        np.add.at(raw, at, 1)
        if i in good:
            np.add.at(wanted, at, 1)
    ratio = np.log(wanted / wanted.sum()) - np.log(raw / raw.sum())
    assert set(found) == set(docs)
    for i, at in grams.items():
        assert abs(found[i]["log_weight"] - (ratio[at].mean() * resampling.STRETCH if len(at) else 0.0)) < 1e-6
    count = round(len(docs) * float((labels["quality"] == 1).mean()))
    drawn = sorted(found, key=lambda i: (-found[i]["key"], i))[:count]
    assert {i for i, r in found.items() if r["kept"]} == set(drawn)


def test_pipeline_equals_plain_stages(spark, sf_dir, library):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    passed = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op4_quality_rules']}) WHERE kept").fetchall()}
    docs = {i: t for i, t in brute.texts(sf_dir).items() if i in passed}
    docs = {i: t for i, t in brute.line_dedup(docs).items() if t.split()}
    group = brute.near_components(docs)
    docs = {i: t for i, t in docs.items() if group[i] == i}
    source = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    size = {i: len(re.findall(brute.WORD, t)) for i, t in docs.items()}
    sizes = {}
    for i in docs:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    targets = brute.source_targets(sizes)

    found = [r.asDict() for r in QUERIES["pipeline"](spark, sf_dir).collect()]
    taken, copies = {}, {}
    for r in found:
        i = r["doc_id"]
        ids = library.encode(docs[i], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["source"] == source[i]
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
        taken[source[i]] = taken.get(source[i], 0) + size[i]
        copies[i] = copies.get(i, 0) + 1
    assert max(copies.values()) <= 3
    for s in sizes:
        assert abs(taken.get(s, 0) - targets[s]) <= max(size[i] for i in docs if source[i] == s) + 1


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "near-duplicates" and len(corpus_pipeline.STAGES) == 5
    odd = docs.withColumn("kept", F.lit("x")).withColumn("size", F.lit(1)).withColumn("copies", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
