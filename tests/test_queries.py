import duckdb
import pytest
from compare import connect, same

from tidemark.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    assert same(df, con, queries.SQL[name]) is None
    types = {d[0]: str(d[1]).lower() for d in con.execute(f"DESCRIBE {queries.SQL[name]}").fetchall()}
    kinds = {"int": "integer", "string": "varchar"}
    assert {c: kinds.get(t, t) for c, t in df.dtypes} == types


def test_names_of_the_inventory():
    assert len(queries.QUERIES) == 72


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A folder whose log has sequences up to six million."""
    path = tmp_path_factory.mktemp("far")
    ids = "0, 99, 451799, 451800, 599999, 2097149, 2097150, 2097151, 2642244, 2642245, 5999999"
    duckdb.sql(f"COPY (SELECT * REPLACE (unnest([{ids}])::BIGINT AS event_id) FROM '{SF}/events.parquet' LIMIT 11) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


def same_wide(df, path, name):
    """As ``same``; the SQL's own bigints overflow there, so its sequences are made HUGEINT."""
    return same(df, connect_events(path), queries.SQL[name].replace("event_id + 1 AS seq", "CAST(event_id + 1 AS HUGEINT) AS seq"))


def connect_events(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return con


def test_format_bytes_of_far_sequences(spark, far):
    df = queries.QUERIES["format_bytes"](spark, far)
    assert same_wide(df, far, "format_bytes") is None
    assert df.count() == 11


def test_varint_length_of_far_sequences(spark, far):
    df = queries.QUERIES["varint_length"](spark, far)
    assert same_wide(df, far, "varint_length") is None
    assert dict(df.dtypes) == {"n": "decimal(38,0)", "length": "int"} and df.count() == 11
