"""Every timeline query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from strophe.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
ORDER = ("session_id", "event_id", "vec_id", "frame", "onset_s", "anchor", "time_s", "pitch_class", "pitch", "start_s", "block", "first", "fresh", "seq", "k", "tick", "kind", "midi_note", "i")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DIR).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    keys = [c for c in ORDER if c in cols]
    ours, theirs = (x[cols].sort_values(keys).reset_index(drop=True) for x in (ours, theirs))
    for c in cols:
        if ours[c].dtype.kind == "f" or str(theirs[c].dtype).startswith(("Int", "float")):
            ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=0, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
