"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from grainlake import queries as Q

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(round(float(v), 5) + 0.0 if isinstance(v, float) or hasattr(v, "dtype") else v for v in r) for r in frame[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [k for k in Q.QUERIES if k in Q.SQL])
def test_query_matches_sql(spark, duck, name):
    got = rows(Q.QUERIES[name](spark, FOLDER).toPandas())
    want = rows(duck.sql(Q.SQL[name]).df())
    assert got == want


def test_segment_volume_gives_particles(spark):
    got = Q.QUERIES["segment_volume"](spark, FOLDER).toPandas()
    assert len(got) > 0 and (got.label > 0).all() and not got.duplicated(["z", "y", "x"]).any()
