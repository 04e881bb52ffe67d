import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from ledgerlens.session import get_session  # noqa: E402

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("ledgerlens-tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALLEST


@pytest.fixture(scope="session")
def full_mode(spark):
    """Six purchases of five customers."""
    rows = [
        ("C1", "2024-01-01", 120.0, "Beauty"),
        ("C2", "2024-01-08", 320.0, "Electronics"),
        ("C3", "2024-01-15", 80.0, "Grocery"),
        ("C1", "2024-01-22", 450.0, "Electronics"),
        ("C4", "2024-01-29", 210.0, "Beauty"),
        ("C5", "2024-02-05", 95.0, "Home"),
    ]
    df = spark.createDataFrame(rows, "customer_id string, date string, total_amount double, product_category string")
    return df.selectExpr("customer_id", "to_timestamp(date) AS date", "total_amount", "product_category")
