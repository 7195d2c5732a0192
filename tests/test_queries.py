"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from roadspark.queries_edits import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    out = []
    for v in row:
        if isinstance(v, bool) or v is None:
            out.append(str(v))
        else:
            try:
                out.append(f"{float(v):.3f}")
            except (TypeError, ValueError):
                out.append(str(v))
    return tuple(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    if name not in ORACLE_SQL:
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert got == sorted(plain([r[k] for k in order]) for r in found.fetchall())
