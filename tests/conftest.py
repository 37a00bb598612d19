import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobtide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Evaluate columns over one-column rows: evaluate(type, values, fn) -> list of dicts."""

    def run(ddl, values, fn):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
        out = fn(F.col("v"))
        columns = out if isinstance(out, dict) else {"r": out}
        rows = df.select("i", *[c.alias(k) for k, c in columns.items()]).orderBy("i").collect()
        return [{k: r[k] for k in columns} for r in rows] if isinstance(out, dict) else [r["r"] for r in rows]

    return run
