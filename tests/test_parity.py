"""Every query with SQL against DuckDB on the same tables, by names, types and values."""

from pathlib import Path

import duckdb
import pytest

from flowlens.plans import correlation, detection, models, tuning, workflow

PARTS = (detection, tuning, correlation, workflow, models)
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
CASES = [(part, name) for part in PARTS for name in part.QUERIES]


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize(("part", "name"), CASES, ids=[name for _, name in CASES])
def test_query(spark, data, duck, part, name):
    got = part.QUERIES[name](spark, data)
    rows = [tuple(r) for r in got.collect()]
    if name not in part.SQL:
        assert rows and got.columns
        return
    want = duck.sql(part.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert {n: TYPES.get(t) for n, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    a, b = comparable(got.columns, rows), comparable(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-6) if any(isinstance(v, float) for v in x) else x == y


def test_means_on_the_edge_of_a_bin(spark, tmp_path):
    """Events whose exact mean score is the edge of two bins, where a sum of doubles falls on either side by its order; one thread adds in the SQL's order."""
    connection = duckdb.connect(config={"threads": 1})
    edges = "SELECT v, k FROM range(0, 50001, 100) a(v), range(100) b(k) WHERE (least(100000, 2 * v) + 1000 * k + least(100000, v + 500 * k)) % 30000 = 0"
    table = f"SELECT row_number() OVER (ORDER BY v, k) AS event_id, TIMESTAMP '2024-01-01' AS ts, 1::BIGINT AS user_id, 'click' AS event_type, v / 100 AS value, concat('{{\"k\": ', k, '}}') AS props FROM ({edges})"
    connection.sql(f"COPY ({table}) TO '{tmp_path}/events.parquet'")
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = tuning.QUERIES["al_diversity"](spark, str(tmp_path)), connection.sql(tuning.SQL["al_diversity"])
    a, b = comparable(got.columns, [tuple(r) for r in got.collect()]), comparable(want.columns, want.fetchall())
    assert a and a == b


def test_sql_names_have_queries():
    for part in PARTS:
        assert set(part.SQL) <= set(part.QUERIES)
