import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL on the smallest driver tables and compares sorted rows."""
    import duckdb

    if not DATA.exists():
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def plain(value):
        if value is None or value != value:
            return None
        return round(float(value), 6) if isinstance(value, float) else str(value)

    def rows(records):
        return sorted((tuple(map(plain, r)) for r in records), key=repr)

    def run(query, sql):
        got = query(spark, str(DATA))
        names = sorted(got.columns)
        cursor = con.execute(sql)
        found = [d[0] for d in cursor.description]
        assert names == sorted(found)
        expected = rows([r[found.index(n)] for n in names] for r in cursor.fetchall())
        assert rows(got.select(*names).collect()) == expected

    return run
