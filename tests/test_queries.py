"""Every registered query against its SQL on the driver's small tables."""

import math
import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest

from loomtick.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted([tuple(r[c] for c in columns) for r in got.collect()], key=str)
    if name not in registry.SQL:
        assert rows
        return
    made = con.execute(registry.SQL[name])
    names = [c[0] for c in made.description]
    assert sorted(names) == columns
    want = sorted([tuple(r[names.index(c)] for c in columns) for r in made.fetchall()], key=str)
    assert len(rows) == len(want)
    wrong = [(a, b) for a, b in zip(rows, want, strict=True) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]


def test_level_cuts_rounds_ties_as_its_sql_does(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 20, "view", rng.randrange(800) / 4, "{}") for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    one = duckdb.connect(config={"threads": 1})  # with more, its lists may come in another order
    one.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = {r[:2]: r[2] for r in one.execute(f"SELECT stream_id, pos, shift FROM ({registry.SQL['level_cuts']})").fetchall()}
    got = {r[:2]: r[2] for r in map(tuple, registry.QUERIES["level_cuts"](spark, str(tmp_path)).select("stream_id", "pos", "shift").collect())}
    assert got == want and len(got) == 2000
