"""Compares a Spark result with DuckDB's rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame) -> list:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.6f}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)

    names = sorted(frame.columns)
    return [names, *sorted([cell(v) for v in r] for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))]
