import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vouchsafe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    yield session
    session.stop()


def product(number, **changes):
    record = {
        "id": f"P{number}", "title": f"Product {number}", "category": "electronics",
        "price": 10.0 + number,
    }
    record.update(changes)
    return {k: v for k, v in record.items() if v is not ...}


@pytest.fixture
def make_product():
    return product


@pytest.fixture
def json_batch(spark):
    """JSON records as rows (_pos, rec)."""
    import json

    from pyspark.sql import functions as F

    def make(records):
        rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
        return spark.createDataFrame(rows, "_pos BIGINT, j STRING").select(
            "_pos", F.parse_json("j").alias("rec")
        )

    return make
