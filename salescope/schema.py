"""Column names and types of the flat sales table and of the star tables.

Money is DECIMAL so that sums do not depend on the order in which partitions
are merged. Cleaned money has four decimals or those of its source, if they are
more: ``Revenue * 0.30`` and a median of two-decimal values are then kept
without rounding. Files are read with 22 digits before the point and 8 after it; the narrow
types are those of the warehouse tables.
"""

from pyspark.sql import types as T

RAW_MONEY = T.DecimalType(12, 2)
WIDE = T.DecimalType(30, 8)
RATIO = T.DecimalType(5, 4)

#: Flat table as read from a source; the order date is still text here.
SALES = T.StructType(
    [
        T.StructField("Order_ID", T.StringType()),
        T.StructField("Order_Date", T.StringType()),
        T.StructField("Customer_ID", T.StringType()),
        T.StructField("Customer_Name", T.StringType()),
        T.StructField("Product_Category", T.StringType()),
        T.StructField("Product_Name", T.StringType()),
        T.StructField("Region", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("Unit_Price", T.DecimalType(10, 2)),
        T.StructField("Discount", RATIO),
        T.StructField("Revenue", RAW_MONEY),
        T.StructField("Profit", RAW_MONEY),
        T.StructField("Sales_Channel", T.StringType()),
    ]
)

#: The same as read from files: any amount that a file may hold, and quantities that
#: may lie between whole numbers, as a filled one can.
SALES_FILE = T.StructType(
    [
        T.StructField(
            f.name,
            T.DoubleType() if f.name == "Quantity" else WIDE if isinstance(f.dataType, T.DecimalType) else f.dataType,
        )
        for f in SALES
    ]
)


def clean_money(kind: T.DecimalType) -> T.DecimalType:
    """Type of a cleaned amount: as many digits before the point, four or more after it."""
    scale = max(4, kind.scale)
    return T.DecimalType(min(38, max(12, kind.precision - kind.scale) + scale), scale)


#: Position of a row in its input; decides which copy "first" means.
SEQ = "_seq"

TEXT_COLUMNS = [f.name for f in SALES if isinstance(f.dataType, T.StringType)]
NUMERIC_COLUMNS = [f.name for f in SALES if f.name not in TEXT_COLUMNS]
DATE_PARTS = ["Year", "Month", "YearMonth", "Quarter"]
CLEAN_COLUMNS = SALES.names + DATE_PARTS

#: Columns of the star tables that a load writes (ids and timestamps excluded).
STAR_COLUMNS = {
    "customers": ["customer_id", "customer_name"],
    "products": ["product_name", "product_category"],
    "orders": ["order_id", "order_date", "customer_id", "region", "sales_channel"],
    "sales": [
        "order_id",
        "product_name",
        "quantity",
        "unit_price",
        "discount",
        "revenue",
        "profit",
    ],
}
