import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from unisource import schemas  # noqa: E402
from unisource.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def land(spark):
    """Landed payloads from short tuples: (body,) or (source_id, entity_hint, body[, status])."""

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            source, hint, body, *status = row if len(row) > 1 else ("s", "e", row[0])
            full.append((source, "", hint, f"p{i}", status[0] if status else 200, body))
        return spark.createDataFrame(full, schemas.LANDED)

    return build


@pytest.fixture(scope="session")
def plan():
    """Text of a DataFrame's physical plan."""
    return lambda df: df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
