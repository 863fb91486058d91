"""Every registered query against its oracle in DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(int(v)) if isinstance(v, bool) else str(v)


def lines(rows, at):
    return sorted("|".join(plain(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = lines(cur.fetchall(), [columns.index(c) for c in sorted(columns)])
    assert lines(rows, [df.columns.index(c) for c in sorted(columns)]) == want


# Queries without an oracle give rows on the smallest tables.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_oracle_rows_prove_something(spark, sf_dir, duck):
    """Only these oracles may be empty on the smallest tables."""
    empty = {n for n, sql in ORACLES.items() if duck.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] == 0}
    assert empty <= {"h5_key_differences", "d7_mixed_senders"}
