import math
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("quillon-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def same_rows(spark_df, sql, sf_dir):
    """(Spark's rows, DuckDB's rows), columns by name, in a common order."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            con.execute(f"create view {name[:-8]} as select * from read_parquet('{path}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(spark_df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in spark_df.collect()), key=repr)
    return got, want
