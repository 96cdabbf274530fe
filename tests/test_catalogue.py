"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from quarryline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return f"{float(v):.6g}" if isinstance(v, float) or hasattr(v, "is_finite") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
