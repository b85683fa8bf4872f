"""Every registered query of the library against its SQL; a query without one fails."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from oracle_check import TABLES, compare
from threadloom import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(data) / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, data, name):
    said = compare(spark, con, data, name)
    assert "BAD" not in said, said


def test_every_sql_has_a_query():
    assert set(catalog.oracles()) == set(NAMES)
