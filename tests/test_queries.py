"""Every registered query against its SQL text on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(text(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    kinds = dict(zip(want.columns, (str(t) for t in want.types)))
    assert {c: TYPES.get(t, t) for c, t in got.dtypes} == kinds
    # Whole numbers with missing ones among them stay whole on both sides.
    whole = {c: "Int64" for c, t in got.dtypes if t in ("bigint", "int")}
    assert rows(got.toPandas().astype(whole)) == rows(want.df().astype(whole))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() == 36
    assert out.columns[:2] == ["model", "lag"] or set(out.columns) >= {"model", "lag"}


def test_archive_members_takes_every_row(spark, tmp_path):
    """Odd, even, negative, repeated and missing ids."""
    ids = [0, 1, 2, 3, 3, 4, 4, 7, -5, -6, None, None, 2**62 + 1]
    events = spark.createDataFrame(
        [(n, 10 + k, None, float(k), "click" if k % 3 else "view") for k, n in enumerate(ids)],
        "event_id bigint, user_id bigint, ts timestamp_ntz, value double, event_type string",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["archive_members"](spark, str(tmp_path)).toPandas()
    members = [n if n is None else f"station/{n}.csv" for n in ids]
    kinds = ["click" if k % 3 else "view" for k in range(len(ids))]
    want = pd.DataFrame({"member": members, "n_bytes": [len(t) + 4 for t in kinds], "event_type": kinds})
    assert rows(got) == rows(want)
    sql = entry.oracle_sql()["archive_members"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(duckdb.sql(sql).df()) == rows(want)
