"""Texts and names of keys that the small data folders do not hold."""

import compare
import duckdb
import pytest

import __spark_entry__ as entry
from tidewrack.functions import columns as C

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name,table,rows", [
    ("P11_status_texts", "events", "SELECT * REPLACE (CAST(i AS BIGINT) AS event_id) FROM src, (VALUES (469333), (599333), (599334)) k(i)"),
    ("P18_renumber", "part", "SELECT * REPLACE (CAST(i AS BIGINT) AS p_partkey) FROM src, (VALUES (9), (10), (999999), (1000008), (12345678), (12345679)) k(i)"),
])
def test_matches_sql_on_large_keys(spark, tmp_path, name, table, rows):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW src AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet' LIMIT 1")
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    assert compare.difference(QUERIES[name](spark, str(tmp_path)), compare.connect(str(tmp_path)), SQL[name]) is None


def test_fixed_texts(spark):
    df = spark.createDataFrame([(649.435,), (0.25,), (1e300,), (None,)], "v double")
    got = [r.t for r in df.select(C.fixed(df.v, 2).alias("t")).collect()]
    assert got[:2] == ["649.43", "0.25"] and got[2].startswith("1000000") and len(got[2]) == 304


def test_a_sensor_line_is_split_once(spark):
    lines = spark.createDataFrame([("p:1,h:2.5, h : 3,P:x,P:7,noise,b:,l:1:2,t:1e2",), ("",), (None,)], "line string").withColumn("f", C.sensor_fields("line"))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    want = dict.fromkeys(C.SENSOR_KEYS)
    assert [r.f for r in lines.collect()] == [want | {"p": 1.0, "h": 3.0, "P": 7.0, "t": 100.0}, want, want]
