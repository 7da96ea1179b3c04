"""Queries with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tidemark.llm import queries as Q

SF = Path("/root/testdata/sf0.001")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = Q.QUERIES[name](spark, str(SF))
    found = con.execute(Q.ORACLES[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), [x[0] for x in found.description])
