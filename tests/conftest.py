import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tests.session import session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def sales(spark):
    """Makes flat sales rows from partial dicts; ``_seq`` is their position."""
    from decimal import Decimal

    from pyspark.sql import types as T

    from salescope.schema import SALES, SEQ

    defaults = {
        "Order_ID": "ORD-1",
        "Order_Date": "2024-01-05",
        "Customer_ID": "C1",
        "Customer_Name": "Ann",
        "Product_Category": "Toys",
        "Product_Name": "Ball",
        "Region": "North",
        "Quantity": 2,
        "Unit_Price": "10.00",
        "Discount": "0.0000",
        "Revenue": "20.00",
        "Profit": "5.00",
        "Sales_Channel": "Online",
    }
    money = {"Unit_Price", "Discount", "Revenue", "Profit"}
    schema = T.StructType(SALES.fields + [T.StructField(SEQ, T.LongType())])

    def build(*rows):
        data = []
        for i, row in enumerate(rows):
            full = {**defaults, **row}
            values = [
                Decimal(str(full[c])) if c in money and full[c] is not None else full[c]
                for c in SALES.names
            ]
            data.append((*values, i))
        return spark.createDataFrame(data, schema)

    return build
