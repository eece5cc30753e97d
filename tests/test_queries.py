import math
import os

import duckdb
import pytest

import __spark_entry__
from trajlake.plans import chats, reference  # noqa: F401

D = "/root/testdata/sf0.001"


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(D):
        c.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(reference.ORACLE))
def test_sql_twin(spark, duck, name):
    df = reference.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    twin = duck.sql(f"select {', '.join(cols)} from ({reference.ORACLE[name]})")
    assert sorted(tuple(map(norm, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(norm, r)) for r in twin.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entities(spark, tmp_path):
    from trajlake.sources.io import read_entities

    (tmp_path / "run_3").mkdir()
    (tmp_path / "run_3" / "a.json.json").write_text('{"success": 1.0, "efficiency": null, "response": "x"}')
    (tmp_path / "run_3" / "bad.json").write_text("{nope")
    rows = read_entities(spark, str(tmp_path / "run_3"), "judgment").collect()
    assert [(r.identifier, r.run_id, r.success) for r in rows] == [("a.json", 3, 1.0)]


def test_stream_sessions(spark, tmp_path):
    import pandas as pd

    from trajlake.streaming.sessions import stream_sessions

    t = pd.Timestamp("2025-01-01")
    ts = [t, t + pd.Timedelta(minutes=30), t + pd.Timedelta(minutes=61), t + pd.Timedelta(hours=9)]
    spark.createDataFrame(pd.DataFrame({"user_id": [1, 1, 1, 2], "ts": ts})).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_sessions(s).writeStream.format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert (1, 2) in {(r.key, r.n) for r in spark.table("sess").collect()}
