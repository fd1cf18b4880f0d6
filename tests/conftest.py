import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[2]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows_of(frame, columns):
    """Rows as sorted tuples; floats to nine digits."""
    clean = lambda x: None if x is None or x != x else round(x, 9) + 0.0 if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(clean(r[c]) for c in columns) for r in frame), key=str)


def same_result(spark, duck, query, sql, sf):
    got = query(spark, sf)
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = rows_of([r.asDict() for r in got.collect()], cols)
    b = rows_of([dict(zip(want.columns, r)) for r in want.fetchall()], cols)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) < 1e-6) for u, v in zip(x, y)), (x, y)
