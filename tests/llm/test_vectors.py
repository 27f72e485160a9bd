"""Near vectors with planted partners, dense groups, extreme norms and mixed lengths."""

import numpy as np

from modelpulse.llm import embeddings
from tests.llm import brute

SCHEMA = "vec_id bigint, embedding array<double>"


def found_in(spark, vectors):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vectors.items()], SCHEMA)
    return {r["vec_id"]: r for r in embeddings.near_vectors(df).collect()}


def test_planted_partners_are_found(spark):
    random = np.random.default_rng(3)
    unit = random.normal(size=(1_500, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    side = random.normal(size=unit.shape)
    side -= (side * unit).sum(axis=1, keepdims=True) * unit
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = [c * unit + np.sqrt(1 - c * c) * side for c in (0.902, 0.95)]
    dense = unit[:1] + 0.05 * random.normal(size=(700, 32))
    whole = np.concatenate([unit, near[0][:800], near[1][800:], dense])
    links, component = brute.near_vectors(list(range(len(whole))), whole)
    found = found_in(spark, dict(enumerate(whole)))
    assert len(found) == len(whole) and sum(links.values()) > 200_000
    assert all(found[i]["n_links"] <= links[i] for i in found)
    planted = [i for i in range(1, 1_500) if links[i]]
    assert sum(found[i]["n_links"] > 0 for i in planted) >= 0.98 * len(planted)
    assert sum(r["n_links"] for r in found.values()) >= 0.98 * sum(links.values())
    assert sum(found[i]["component_id"] == component[i] for i in found) >= 0.98 * len(found)


def test_extreme_norms_and_lengths(spark):
    found = found_in(spark, {
        1: [1e200, 2e200, 0], 2: [1e-200, 2e-200, 0], 3: [5e-324, 1e-323, 0], 4: [1.0, 2.0], 5: [2e-310, 4e-310], 6: [1.0], 7: [3.0],
        8: [-1.0], 9: None, 10: [], 11: [0, 0, 0], 12: [float("nan"), 1, 2], 13: [float("inf"), 1, 2], 14: [0, 0, 1.7e308], 15: [-0.0, 0.0, 1.0],
    })
    assert {i: (r["n_links"], r["component_id"]) for i, r in found.items()} == {
        1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8),
        9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (0, 12), 13: (0, 13), 14: (1, 14), 15: (1, 14),
    }


def test_keys_get_shorter_where_tables_do_not_do(monkeypatch):
    monkeypatch.setattr(embeddings, "TABLES", 4)
    sample = np.random.default_rng(1).normal(size=(2_000, 16))
    index = embeddings.Index(sample, 1_000_000, 0.5)
    assert len(index.tables) <= 8 and all(len(t) < 14 for t in index.tables)
    assert index.keys(embeddings.scaled(sample)).shape == (2_000, len(index.tables))
