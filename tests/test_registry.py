"""Registered queries: every one has its SQL, and some run against it here."""

import duckdb
import pytest

import __spark_entry__ as entry

QUICK = [
    "vitals_record", "psi_by_feature", "gini", "parity_one_hot", "privacy_score", "validate_batches",
    "grade_domain", "history_reset", "batch_by_time", "propagate_impact", "telemetry_explode",
]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted(([cell(r[i]) for i in order] for r in rows), key=str)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert len(entry.QUERIES) > 80
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("region nation customer orders lineitem events documents labels embeddings pages").split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["model_id", "batch"]
