import pytest
from pyspark.sql import functions as F

from salescope.operators import clean, warehouse


@pytest.fixture
def lines(sales):
    return clean.convert_dates(
        sales(
            {"Order_ID": "A", "Product_Name": "Ball", "Product_Category": "Toys"},
            {"Order_ID": "A", "Product_Name": "Lamp", "Product_Category": "Home", "Region": "South"},
            {"Order_ID": "B", "Product_Name": "Ball", "Product_Category": "Sport", "Customer_ID": "C2"},
        )
    )


def table(star, name, *columns):
    return sorted(tuple(r) for r in star[name].select(*columns).collect())


def test_first_row_per_key_wins(lines, tmp_path):
    star = warehouse.load_all(lines, str(tmp_path / "w"))
    assert table(star, "products", "product_name", "product_category") == [("Ball", "Toys"), ("Lamp", "Home")]
    assert table(star, "orders", "order_id", "region") == [("A", "North"), ("B", "North")]
    assert star["sales"].count() == 3
    # The name decides the category, so order B comes back as Toys.
    view = warehouse.sales_summary_view(star)
    assert {r.product_category for r in view.where("order_id = 'B'").collect()} == {"Toys"}
    assert view.count() == 3


def test_loading_again_adds_only_sales(lines, tmp_path):
    path = str(tmp_path / "w")
    warehouse.load_all(lines, path)
    star = warehouse.load_all(lines, path)
    assert {t: df.count() for t, df in star.items()} == {
        "customers": 2,
        "products": 2,
        "orders": 2,
        "sales": 6,
    }
    ids = [r.sale_id for r in star["sales"].collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5, 6]


def test_idempotent_load_adds_nothing(lines, tmp_path):
    path = str(tmp_path / "w")
    warehouse.load_all(lines, path)
    star = warehouse.load_all(lines, path, idempotent=True)
    assert star["sales"].count() == 3


def test_present_rows_are_kept_and_new_ids_follow(spark, lines, sales, tmp_path):
    path = str(tmp_path / "w")
    warehouse.load_all(lines, path)
    more = clean.convert_dates(
        sales(
            {"Order_ID": "C", "Customer_Name": "Other", "Product_Name": "Ball", "Product_Category": "New"},
            {"Order_ID": "D", "Product_Name": "Desk"},
            {"Order_ID": "D", "Product_Name": "Chair"},
        )
    )
    star = warehouse.load_all(more, path)
    assert table(star, "customers", "customer_id", "customer_name") == [("C1", "Ann"), ("C2", "Ann")]
    assert sorted(r.product_id for r in star["products"].collect()) == [1, 2, 3, 4]
    assert ("Ball", "Toys") in table(star, "products", "product_name", "product_category")


def test_dense_ids_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("concat('k', id) AS key")
    one = {r.key: r.id for r in warehouse.dense_ids(df.repartition(7), "id", ["key"]).collect()}
    other = {r.key: r.id for r in warehouse.dense_ids(df.coalesce(1), "id", ["key"], after=10).collect()}
    assert sorted(one.values()) == list(range(1, 1001))
    assert other == {k: v + 10 for k, v in one.items()}


def test_rows_that_break_a_rule_stop_the_load(sales, tmp_path):
    df = clean.convert_dates(sales({"Quantity": 0}, {"Discount": "1.2000"}))
    with pytest.raises(ValueError, match="quantity > 0 broken by 1 rows"):
        warehouse.load_all(df, str(tmp_path / "w"))
    assert warehouse.read_table(df.sparkSession, str(tmp_path / "w"), "customers") is None


def test_a_missing_name_matters_only_in_the_first_row(sales, tmp_path):
    good = clean.convert_dates(sales({}, {"Customer_Name": None}))
    assert warehouse.load_all(good, str(tmp_path / "good"))["customers"].count() == 1
    bad = clean.convert_dates(sales({"Customer_Name": None}, {}))
    with pytest.raises(ValueError, match="not null customer_name"):
        warehouse.load_all(bad, str(tmp_path / "bad"))


def test_constraints_are_counted(spark):
    star = {
        "customers": spark.createDataFrame([("C1", "Ann"), ("C1", "Bob")], "customer_id string, customer_name string"),
        "products": spark.createDataFrame([("Ball", None)], "product_name string, product_category string"),
        "orders": spark.sql(
            "SELECT 'A' AS order_id, date'2024-01-01' AS order_date, 'C9' AS customer_id,"
            " CAST(NULL AS STRING) AS region, 'Online' AS sales_channel"
        ),
        "sales": spark.sql(
            "SELECT * FROM VALUES ('A', 'Ball', 0, 1.0BD, 0.1BD, 1.0BD, 1.0BD),"
            " ('Z', 'Ball', 1, -1.0BD, 1.2BD, 1.0BD, 1.0BD), ('Z', 'Cup', 1, 1.0BD, 0BD, 1.0BD, NULL)"
            " AS t(order_id, product_name, quantity, unit_price, discount, revenue, profit)"
        ),
    }
    found = {(r.table, r.rule): r.violations for r in warehouse.validate_constraints(star).collect()}
    assert len(found) == 40
    assert {k: v for k, v in found.items() if v} == {
        ("customers", "unique customer_id"): 1,
        ("products", "not null product_category"): 1,
        ("orders", "not null region"): 1,
        ("orders", "references customers customer_id"): 1,
        ("sales", "not null profit"): 1,
        ("sales", "check quantity > 0"): 1,
        ("sales", "check unit_price >= 0"): 1,
        ("sales", "check discount in [0, 1]"): 1,
        ("sales", "references orders order_id"): 2,
        ("sales", "references products product_name"): 1,
    }


def test_summary_by_sql_text_equals_the_operator(lines, tmp_path):
    star = warehouse.load_all(lines, str(tmp_path / "w"))
    assert warehouse.read_sql(star).collect() == warehouse.sales_summary_monthly(star).collect()


def test_defaults(spark):
    df = spark.sql("SELECT CAST(NULL AS DECIMAL(5,4)) AS discount")
    row = warehouse.insert_defaults(df).first()
    assert float(row.discount) == 0 and row.created_at is not None


def test_sale_ids_have_no_gaps_over_loads_and_partitions(spark):
    df = spark.range(1000).repartition(7).where("id % 3 = 0")
    first = warehouse.numbered(df, "n")
    assert sorted(r.n for r in first.collect()) == list(range(1, 335))
    later = warehouse.numbered(df.limit(5), "n", after=first.selectExpr("max(n) AS m").scalar())
    assert sorted(r.n for r in later.collect()) == list(range(335, 340))


def test_rows_that_do_not_fit_their_column_stop_the_load(sales, tmp_path):
    rows = clean.clean(sales({}))
    for column, value, rule in (
        ("Revenue", "12345678901.00", r"type revenue decimal\(12,2\)"),
        ("Product_Name", "x" * 101, "length product_name <= 100"),
    ):
        df = rows.withColumn(column, F.lit(value).cast("decimal(20,2)" if column == "Revenue" else "string"))
        with pytest.raises(ValueError, match=rule):
            warehouse.load_all(df, str(tmp_path / "w"))


def test_ids_that_repeat_are_counted(lines, tmp_path):
    star = warehouse.load_all(lines, str(tmp_path / "w"))
    star["sales"] = star["sales"].unionByName(star["sales"].limit(1))
    star["products"] = star["products"].withColumn("product_id", star["products"].product_id * 0)
    found = {r.rule: r.violations for r in warehouse.validate_constraints(star).collect()}
    assert (found["unique sale_id"], found["unique product_id"], found["unique product_name"]) == (1, 1, 0)


def _scans(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("Final Plan") : text.index("Initial Plan")].count("FileScan") if "Initial Plan" in text else text.count("FileScan")


def test_each_table_is_read_twice_at_most(spark, lines, tmp_path, monkeypatch):
    star = warehouse.load_all(lines, str(tmp_path / "w"))
    slim = {t: df.drop("sale_id") for t, df in star.items()}
    assert _scans(warehouse.validate_constraints(slim)) <= 8
    # The check before a load is one scan.
    stored = lines.write.parquet(str(tmp_path / "lines"))
    assert stored is None
    seen = []
    monkeypatch.setattr(warehouse, "_counted", lambda df, tests, f=warehouse._counted: seen.append(f(df, tests)) or seen[-1])
    warehouse.require_valid(spark.read.parquet(str(tmp_path / "lines")))
    assert len(seen) == 1 and _scans(seen[0]) == 1


def test_sql_text_leaves_views_of_the_session_alone(spark, lines, tmp_path):
    star = warehouse.load_all(lines, str(tmp_path / "w"))
    for name in ("sales", warehouse.SUMMARY_VIEW):
        spark.range(3).createOrReplaceTempView(name)
    try:
        warehouse.read_sql(star).collect()
        warehouse.sales_summary_view(star).collect()
        assert spark.table("sales").columns == spark.table(warehouse.SUMMARY_VIEW).columns == ["id"]
        warehouse.sales_summary_view(star, warehouse.SUMMARY_VIEW)
        assert "revenue" in spark.table(warehouse.SUMMARY_VIEW).columns
    finally:
        for name in ("sales", warehouse.SUMMARY_VIEW):
            spark.catalog.dropTempView(name)


def test_ids_run_on_over_merged_partitions(spark, monkeypatch):
    monkeypatch.setattr(warehouse, "NUMBERED_PARTS", 3)
    rows = warehouse.numbered(spark.range(100).repartition(9), "id2", 5).collect()
    assert sorted(r.id2 for r in rows) == list(range(6, 106)) and sorted(r.id for r in rows) == list(range(100))
