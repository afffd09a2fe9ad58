import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from capacast import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    built = session.build("tests", "local[4]", 4, **{
        "spark.sql.warehouse.dir": str(base / "warehouse"),
        "spark.checkpoint.dir": str(base / "shared"),
        "spark.ui.showConsoleProgress": "false",
    })
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column over literal rows: values("a double", [(1.0,)], column)."""
    def run(ddl, rows, column):
        return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]
    return run
