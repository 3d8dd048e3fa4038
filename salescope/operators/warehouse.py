"""The star tables: summary views, loads that insert what is absent, validation.

A warehouse is a folder with one Parquet table each for customers, products,
orders and sales.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.operators.clean import dedupe_keep_first
from salescope.schema import RATIO, SEQ, STAR_COLUMNS
from salescope.sources.shared import land

SUMMARY_VIEW = "vw_sales_summary"
#: Most partitions that rows are numbered in; their shifts take about a megabyte.
NUMBERED_PARTS = 1 << 16

SUMMARY_SQL = """
    SELECT region, product_category, trunc(order_date, 'MM') AS month,
           sum(revenue) AS total_revenue, sum(profit) AS total_profit,
           count(DISTINCT order_id) AS order_count
    FROM {sales} JOIN {orders} USING (order_id) JOIN {products} USING (product_name)
    GROUP BY region, product_category, trunc(order_date, 'MM')
    ORDER BY month, total_revenue DESC, region, product_category
"""

# --- queries over the star -------------------------------------------------


def sales_summary_view(star: dict[str, DataFrame], name: str | None = None) -> DataFrame:
    """Sales with their order, customer and product, 13 columns.

    With ``name`` (:data:`SUMMARY_VIEW` is the usual one) they also become a session view
    of that name, which replaces one that is there.
    Inner joins without hints. Spark broadcasts a side it finds small enough, and
    otherwise splits the skewed partitions of a sort-merge join at run time. Orders find their
    customers first, so that the sales, which are many more, are shuffled by order only.
    """
    orders = star["orders"].join(star["customers"], "customer_id")
    flat = (
        star["sales"]
        .join(orders, "order_id")
        .join(star["products"], "product_name")
        .select(
            "order_id",
            "order_date",
            "customer_id",
            "customer_name",
            "product_category",
            "product_name",
            "region",
            "quantity",
            "unit_price",
            "discount",
            "revenue",
            "profit",
            "sales_channel",
        )
    )
    if name:
        flat.createOrReplaceTempView(name)
    return flat


def sales_summary_monthly(star: dict[str, DataFrame]) -> DataFrame:
    """Revenue, profit and distinct orders by region, category and month."""
    return (
        star["sales"]
        .join(star["orders"], "order_id")
        .join(star["products"], "product_name")
        .groupBy("region", "product_category", F.trunc("order_date", "MM").alias("month"))
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.sum("profit").alias("total_profit"),
            F.count_distinct("order_id").alias("order_count"),
        )
        .orderBy("month", F.desc("total_revenue"), "region", "product_category")
    )


def read_sql(star: dict[str, DataFrame], query: str = SUMMARY_SQL) -> DataFrame:
    """The result of SQL text in which the star tables go by their names, in braces.

    The tables are handed over with the text, so no view of the session is replaced.
    """
    return star["sales"].sparkSession.sql(query, **star)


# --- ids and defaults ------------------------------------------------------


def dense_ids(df: DataFrame, name: str, keys: list[str], after: Column | int = 0) -> DataFrame:
    """Adds ids that run without gaps from ``after + 1``.

    Rows are ordered by the first four hex digits of a hash of the keys, then by the
    keys. Each of these 65,536 buckets is numbered on its own and shifted by the rows
    in the buckets before it, so the largest window has one row per bucket. The order
    is a function of the rows alone, which makes a retried task give the same ids. The
    keys together should identify a row.
    """
    spread = F.substring(F.md5(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])), 1, 4)
    rows = df.withColumn("_bucket", spread)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    shifts = sizes.select("_bucket", earlier.alias("_shift"))
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    start = F.lit(after) if isinstance(after, int) else after
    return (
        rows.withColumn("_number", number)
        .join(F.broadcast(shifts), "_bucket")
        .withColumn(name, start + F.col("_shift") + F.col("_number"))
        .drop("_bucket", "_number", "_shift")
    )


def numbered(df: DataFrame, name: str, after: Column | int = 0) -> DataFrame:
    """Adds ids that run without gaps from ``after + 1``, in the order of partitions.

    The rows are landed with their place in their partition, so that a retried task cannot
    change it, and shifted by the rows of the partitions before. Rows are not shuffled. Window
    and broadcast have one row per partition; beyond :data:`NUMBERED_PARTS`, partitions are put
    together, so they are never larger than that.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = df.coalesce(NUMBERED_PARTS)  # leaves fewer partitions as they are
    rows = land(parts.withColumns({"_part": F.spark_partition_id(), "_place": place}), "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    shifts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_shift"))
    start = F.lit(after) if isinstance(after, int) else after
    return (
        rows.join(F.broadcast(shifts), "_part")
        .withColumn(name, start + F.col("_shift") + F.col("_place") + 1)
        .drop("_part", "_place", "_shift")
    )


def insert_defaults(df: DataFrame) -> DataFrame:
    """What a column gets when an insert does not name it: discount 0, time now."""
    if "discount" in df.columns:
        df = df.withColumn("discount", F.coalesce("discount", F.lit(0).cast(RATIO)))
    return df.withColumn("created_at", F.current_timestamp())


# --- loads -----------------------------------------------------------------


def customer_rows(sales: DataFrame) -> DataFrame:
    """First name of each customer id."""
    first = dedupe_keep_first(
        sales.select("Customer_ID", "Customer_Name", "Order_ID", SEQ),
        ["Customer_ID"],
        [SEQ, "Order_ID"],
    )
    return first.select(
        F.col("Customer_ID").alias("customer_id"), F.col("Customer_Name").alias("customer_name")
    )


def product_rows(sales: DataFrame) -> DataFrame:
    """First category of each product name."""
    first = dedupe_keep_first(
        sales.select("Product_Name", "Product_Category", "Order_ID", SEQ),
        ["Product_Name"],
        [SEQ, "Order_ID"],
    )
    return first.select(
        F.col("Product_Name").alias("product_name"),
        F.col("Product_Category").alias("product_category"),
    )


def order_rows(sales: DataFrame) -> DataFrame:
    """First line of each order id."""
    columns = ["Order_ID", "Order_Date", "Customer_ID", "Region", "Sales_Channel"]
    first = dedupe_keep_first(sales.select(*columns, SEQ), ["Order_ID"])
    return first.select(
        F.col("Order_ID").alias("order_id"),
        F.to_date("Order_Date").alias("order_date"),
        F.col("Customer_ID").alias("customer_id"),
        F.col("Region").alias("region"),
        F.col("Sales_Channel").alias("sales_channel"),
    )


#: Columns of the sales table with the types of the warehouse.
SALES_TYPES = {
    "quantity": "int",
    "unit_price": "decimal(10,2)",
    "discount": "decimal(5,4)",
    "revenue": "decimal(12,2)",
    "profit": "decimal(12,2)",
}


def sales_rows(sales: DataFrame) -> DataFrame:
    """Every line with the types of the sales table; an amount that does not fit is an error."""
    names = dict(zip(SALES_TYPES, ("Quantity", "Unit_Price", "Discount", "Revenue", "Profit"), strict=True))
    return sales.select(
        F.col("Order_ID").alias("order_id"),
        F.col("Product_Name").alias("product_name"),
        *[F.col(source).cast(SALES_TYPES[c]).alias(c) for c, source in names.items()],
    )


def read_table(spark: SparkSession, warehouse: str, table: str) -> DataFrame | None:
    """A warehouse table, or None before its first load."""
    try:
        return spark.read.parquet(f"{warehouse}/{table}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_star(spark: SparkSession, warehouse: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{warehouse}/{t}") for t in STAR_COLUMNS}


def absent(new: DataFrame, present: DataFrame | None, key: str) -> DataFrame:
    """The rows whose key a table does not have yet."""
    return new if present is None else new.join(present.select(key), key, "left_anti")


def last_id(present: DataFrame | None, column: str) -> Column | int:
    """The highest id that a table has given so far."""
    if present is None:
        return 0
    return present.select(F.coalesce(F.max(column), F.lit(0)).alias("last")).scalar()


def _append(df: DataFrame, warehouse: str, table: str) -> None:
    insert_defaults(df).write.mode("append").parquet(f"{warehouse}/{table}")


def load_customers(sales: DataFrame, warehouse: str) -> None:
    """Inserts the customers whose id the table does not have yet."""
    present = read_table(sales.sparkSession, warehouse, "customers")
    _append(absent(customer_rows(sales), present, "customer_id"), warehouse, "customers")


def load_products(sales: DataFrame, warehouse: str) -> None:
    """Inserts the products whose name the table does not have yet, with new ids."""
    present = read_table(sales.sparkSession, warehouse, "products")
    # Landed, because numbering reads the rows twice and must see the same ones.
    new = land(absent(product_rows(sales), present, "product_name"), "new_products")
    numbered = dense_ids(new, "product_id", ["product_name"], last_id(present, "product_id"))
    _append(numbered, warehouse, "products")


def load_orders(sales: DataFrame, warehouse: str) -> None:
    """Inserts the orders whose id the table does not have yet."""
    present = read_table(sales.sparkSession, warehouse, "orders")
    _append(absent(order_rows(sales), present, "order_id"), warehouse, "orders")


def load_sales(sales: DataFrame, warehouse: str, idempotent: bool = False) -> None:
    """Appends every line, so that loading twice doubles the table.

    With ``idempotent`` the lines of orders that already have sales are left out.
    """
    present = read_table(sales.sparkSession, warehouse, "sales")
    new = sales_rows(sales)
    if idempotent and present is not None:
        new = new.join(present.select("order_id").distinct(), "order_id", "left_anti")
    _append(numbered(new, "sale_id", last_id(present, "sale_id")), warehouse, "sales")


# --- constraints -----------------------------------------------------------

# The rules that the star tables have to satisfy.
NOT_NULL = {
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
UNIQUE = {
    "customers": ["customer_id"],
    "products": ["product_name", "product_id"],
    "orders": ["order_id"],
    "sales": ["sale_id"],
}
REFERENCES = [
    ("orders", "customer_id", "customers"),
    ("sales", "order_id", "orders"),
    ("sales", "product_name", "products"),
]
CHECKS = {
    "quantity > 0": "quantity > 0",
    "unit_price >= 0": "unit_price >= 0",
    "discount in [0, 1]": "discount BETWEEN 0 AND 1",
}
LENGTHS = {
    "customers": {"customer_id": 20, "customer_name": 100},
    "products": {"product_name": 100, "product_category": 50},
    "orders": {"order_id": 20, "customer_id": 20, "region": 50, "sales_channel": 50},
    "sales": {"order_id": 20, "product_name": 100},
}

#: What a load takes each column of the star tables from.
SOURCES = {
    "customer_id": "Customer_ID",
    "customer_name": "Customer_Name",
    "product_name": "Product_Name",
    "product_category": "Product_Category",
    "order_id": "Order_ID",
    "order_date": "Order_Date",
    "region": "Region",
    "sales_channel": "Sales_Channel",
    "quantity": "Quantity",
    "unit_price": "Unit_Price",
    "discount": "Discount",
    "revenue": "Revenue",
    "profit": "Profit",
}


def _tests(table: str, columns: dict[str, Column]) -> dict[str, Column]:
    """For each rule that looks at one row of ``table``, whether a row breaks it."""
    tests = {f"not null {c}": columns[c].isNull() for c in NOT_NULL[table]}
    tests |= {f"length {c} <= {n}": F.char_length(columns[c]) > n for c, n in LENGTHS[table].items()}
    if table == "sales":
        fitted = {c: columns[c].try_cast(kind) for c, kind in SALES_TYPES.items()}
        tests |= {
            f"type {c} {kind}": columns[c].isNotNull() & fitted[c].isNull() for c, kind in SALES_TYPES.items()
        }
        tests["check quantity > 0"] = fitted["quantity"] <= 0
        tests["check unit_price >= 0"] = fitted["unit_price"] < 0
        tests["check discount in [0, 1]"] = ~fitted["discount"].between(0, 1)
    return tests


def _counted(df: DataFrame, tests: dict[tuple[str, str], Column]) -> DataFrame:
    """Violations of rules that look at one row, from one scan."""
    entries = [
        F.struct(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.count_if(test).alias("violations"))
        for (table, rule), test in tests.items()
    ]
    return df.agg(F.array(*entries).alias("rules")).select(F.inline("rules"))


def _row_rules(table: str, df: DataFrame) -> DataFrame:
    tests = _tests(table, {c: F.col(c) for c in NOT_NULL[table]})
    return _counted(df, {(table, rule): test for rule, test in tests.items()})


def _key_rules(star: dict[str, DataFrame]) -> DataFrame:
    """Rows beyond the first of each unique key, and rows that refer to a key that is not there.

    Every table gives its keys in one scan, each with the place that it is unique in. Those of all tables
    are counted together, combined inside tasks, so a frequent key is one row per task and
    no join is needed.
    """
    unique = [(t, k) for t, keys in UNIQUE.items() for k in keys if k in star[t].columns]
    held = unique + [(t, k) for t, k, _ in REFERENCES]
    place = {(t, k): f"{t}.{k}" for t, k in unique} | {(t, k): f"{target}.{k}" for t, k, target in REFERENCES}
    found = None
    for table, df in star.items():
        keys = [
            F.struct(F.lit(place[t, k]).alias("place"), F.col(k).cast("string").alias("k")) for t, k in held if t == table
        ]
        rows = df.select(F.inline(F.array(*keys))).withColumn("holder", F.lit(table))
        found = rows if found is None else found.unionByName(rows)
    counts = found.where("k IS NOT NULL").groupBy("place", "k").agg(
        *[F.count_if(F.col("holder") == t).alias(t) for t in star]
    )
    here = {own: F.col("place") == name for own, name in place.items()}
    broken = {(t, f"unique {k}"): F.when(here[t, k] & (F.col(t) > 1), F.col(t) - 1) for t, k in unique}
    broken |= {
        (t, f"references {target} {k}"): F.when(here[t, k] & (F.col(target) == 0), F.col(t)) for t, k, target in REFERENCES
    }
    entries = [
        F.struct(F.lit(t).alias("table"), F.lit(rule).alias("rule"), F.coalesce(F.sum(n), F.lit(0)).alias("violations"))
        for (t, rule), n in broken.items()
    ]
    return counts.agg(F.array(*entries).alias("rules")).select(F.inline("rules"))


def validate_constraints(star: dict[str, DataFrame]) -> DataFrame:
    """How many rows break each rule, as (table, rule, violations).

    A table is read once for the rules about single rows, and once for its keys. An id that a load
    generates is checked where the table has it.
    """
    results = [*(_row_rules(table, star[table]) for table in NOT_NULL), _key_rules(star)]
    return reduce(DataFrame.unionByName, results)


def _broken(df: DataFrame, tables: list[str], columns: dict[str, Column]) -> list:
    """Rules about single rows that rows of ``df`` break, from one scan; few rows at most."""
    tests = {(t, rule): test for t in tables for rule, test in _tests(t, columns).items()}
    return _counted(df, tests).where("violations > 0").collect()


def require_valid(sales: DataFrame) -> None:
    """Raises ValueError if a row to be inserted breaks a rule about single rows.

    One scan of all rows finds nothing in most cases. Only if it finds something are
    the first rows per key looked up, to tell whether one of those is concerned. Keys
    need no check: a load keeps one row per key, and inserts what is referred to first.
    """
    columns = {c: F.col(source) for c, source in SOURCES.items()}
    columns["discount"] = F.coalesce(columns["discount"], F.lit(0))  # as an insert does
    tables = list(NOT_NULL)
    if not (broken := _broken(sales, tables, columns)):
        return
    broken = [r for r in broken if r.table == "sales"]
    firsts = {"customers": customer_rows, "products": product_rows, "orders": order_rows}
    for table, rows in firsts.items():
        broken += _broken(rows(sales), [table], {c: F.col(c) for c in NOT_NULL[table]})
    if broken:
        raise ValueError(
            "; ".join(f"{r.table}: {r.rule} broken by {r.violations} rows" for r in broken)
        )


def load_all(sales: DataFrame, warehouse: str, idempotent: bool = False) -> dict[str, DataFrame]:
    """Checks the rows, then loads the four tables, keys before what refers to them."""
    require_valid(sales)
    load_customers(sales, warehouse)
    load_products(sales, warehouse)
    load_orders(sales, warehouse)
    load_sales(sales, warehouse, idempotent)
    return read_star(sales.sparkSession, warehouse)
