import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillstone.session import session

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    s = session("tests", "local[4]", **conf)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Asserts that a query and its twin agree on names, types and rows in any order."""
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, sf_dir)
        found = duck.sql(sql)
        names = found.columns
        assert sorted(names) == sorted(df.columns)
        types = dict(df.dtypes)
        for n, t in zip(names, map(str, found.types), strict=True):
            assert kinds.get(t, types[n]) == types[n], n
        rows = lambda rs: sorted((tuple(map(value, r)) for r in rs), key=repr)
        assert rows(df.select(*(f"`{n}`" for n in names)).collect()) == rows(found.fetchall())

    return check
