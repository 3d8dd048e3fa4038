"""Every operator as a query over the given tables, by key.

A query reads the published sales tables of :mod:`salescope.plans.fixtures`, applies
one operator to the whole of them and hands the result to :func:`result`, which sets
the column types that are compared across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.functions import formats
from salescope.functions.quantiles import exact_quantiles
from salescope.operators import (
    calendar,
    clean,
    cube,
    dashboard,
    differences,
    filters,
    forecast,
    kpi,
    profile,
    seasonal,
    sketches,
    temporal,
    warehouse,
)
from salescope.operators.forecast import SalesForecaster
from salescope.plans import histories, streams
from salescope.plans.fixtures import read, sales_clean, sales_lines, sales_raw, star
from salescope.plans.pipeline import preprocess_pipeline
from salescope.schema import CLEAN_COLUMNS, SALES, SEQ
from salescope.sources.csv import load_sales_csv, save_sales_csv
from salescope.sources.shared import fresh_path, publish, release

Query = Callable[[SparkSession, str], DataFrame]

#: The selection that the filter and dashboard queries make.
DATES = ("1996-03-01", "1999-06-30")
REGIONS = ["AMERICA", "ASIA", "EUROPE", "Unknown"]
CATEGORIES = ["ECONOMY", "PROMO", "STANDARD"]
CHANNELS = ["1-URGENT", "2-HIGH", "5-LOW"]
NO_DATES = ("1980-01-01", "1980-12-31")


def result(df: DataFrame, **digits: int) -> DataFrame:
    """Exact decimals as DOUBLE, whole numbers as BIGINT, dates as ISO text.

    ``digits`` rounds columns whose last bits depend on the order of additions.
    """
    kinds = {T.DecimalType: "double", T.IntegerType: "bigint", T.DateType: "string"}
    columns = []
    for field in df.schema:
        value = F.col(field.name)
        kind = kinds.get(type(field.dataType))
        value = value.cast(kind) if kind else value
        value = F.round(value, digits[field.name]) if field.name in digits else value
        columns.append(value.alias(field.name))
    return df.select(columns)


def _on_clean(operator: Callable[[DataFrame], DataFrame], **digits: int) -> Query:
    return lambda spark, sf_dir: result(operator(sales_clean(spark, sf_dir)), **digits)


def _on_raw(operator: Callable[[DataFrame], DataFrame], **digits: int) -> Query:
    return lambda spark, sf_dir: result(operator(sales_raw(spark, sf_dir)), **digits)


def _selected(df: DataFrame) -> DataFrame:
    return filters.apply_filters(df, DATES, REGIONS, CATEGORIES, CHANNELS)


def _on_selected(operator: Callable[[DataFrame], DataFrame], **digits: int) -> Query:
    return _on_clean(lambda df: operator(_selected(df)), **digits)


def _order_dates(df: DataFrame) -> DataFrame:
    """The order date back as text, the way it arrives in a file."""
    return df.withColumn("Order_Date", F.col("Order_Date").cast("string"))


# --- files -----------------------------------------------------------------


def _csv_file(spark: SparkSession, sf_dir: str, in_order: bool = False) -> str:
    path = fresh_path(spark, "sales_csv")
    save_sales_csv(sales_raw(spark, sf_dir, in_order), path, compression="gzip")
    return path


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(load_sales_csv(spark, _csv_file(spark, sf_dir)).drop(SEQ))


def _timestamp_text(df: DataFrame) -> DataFrame:
    """Order dates as text with a time of day, in three notations."""
    day, nth = F.col("Order_Date").cast("timestamp"), F.abs(F.hash("Order_ID")) % 3
    patterns = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd"]
    text = F.coalesce(*[F.when(nth == k, F.date_format(day, p)) for k, p in enumerate(patterns)])
    return df.withColumn("Order_Date", text)


def save_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that was written, read back without types."""
    path = fresh_path(spark, "saved_csv")
    save_sales_csv(sales_clean(spark, sf_dir).orderBy("Order_ID"), path, compression="gzip")
    return result(spark.read.option("header", True).csv(path))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table written to files and read again, with its types."""
    path = fresh_path(spark, "saved_csv")
    save_sales_csv(sales_clean(spark, sf_dir), path, compression="gzip")
    return result(load_sales_csv(spark, path).drop(SEQ))


def _preprocessed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The pipeline's results on CSV files, which go when the cleaned table is there."""
    path = _csv_file(spark, sf_dir, in_order=True)
    found = preprocess_pipeline(spark, path)
    release(spark, path)
    return found


def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From CSV files to the cleaned table; which copy is first follows the files."""
    cleaned, _ = _preprocessed(spark, sf_dir)
    return result(cleaned.drop(SEQ).select(CLEAN_COLUMNS))


def preprocess_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kpis = _preprocessed(spark, sf_dir)
    return result(kpis["kpi_scalars"])


# --- cleaning --------------------------------------------------------------


def _filled(column: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_raw(lambda df: operator(df).select("Order_ID", "Revenue", column))


def _imputed(df: DataFrame) -> DataFrame:
    ready = df.transform(clean.fill_discount).transform(clean.derive_profit)
    return clean.impute_median(ready).select(
        "Order_ID", "Quantity", "Unit_Price", "Discount", "Revenue", "Profit"
    )


def _unknowns(df: DataFrame) -> DataFrame:
    return clean.fill_unknown(_order_dates(df)).select(
        "Order_ID", "Order_Date", "Product_Name", "Region", "Sales_Channel"
    )


# --- forecasting -----------------------------------------------------------

_models: dict[tuple[str, str], tuple[SalesForecaster, str]] = {}


def _forecaster(spark: SparkSession, sf_dir: str) -> tuple[SalesForecaster, str]:
    """The model trained on the cleaned table and its folder; trained once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        path = fresh_path(spark, "model")
        _models[key] = (forecast.train_and_save(sales_clean(spark, sf_dir), path), path)
    return _models[key]


def _lags(df: DataFrame) -> DataFrame:
    return forecast.lag_features(forecast.segment_monthly(df))


def _landed_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag features as a table, for queries that read them more than once."""
    return publish(spark, "lag_features", sf_dir, lambda: _lags(sales_clean(spark, sf_dir)))


def _naive(df: DataFrame) -> DataFrame:
    """Two predictions that need no model: last revenue, and last quantity times 900."""
    return _lags(df).withColumns(
        {"by_revenue": F.col("Previous_Revenue"), "by_sales": F.col("Previous_Sales") * 900}
    )


def _naive_metrics(df: DataFrame) -> DataFrame:
    return forecast.regression_metrics(_naive(df), "Revenue", linear="by_revenue", rf="by_sales")


def linear_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the least-squares fit on the training part."""
    monthly = _landed_lags(spark, sf_dir)
    encoder = forecast.label_encoder(forecast.CODES).fit(monthly)
    rows = forecast.training_rows(monthly, encoder).where("NOT is_test")
    model = forecast.fit_linear(rows).stages[-1]
    terms = [("Intercept", float(model.intercept))]
    terms += list(zip(forecast.FEATURES, map(float, model.coefficients)))
    return result(spark.createDataFrame(terms, "term string, coefficient double"), coefficient=4)


def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _forecaster(spark, sf_dir)
    rows = forecast.train_test_split(_lags(sales_clean(spark, sf_dir))).where("is_test")
    return result(
        model.predict_rows(rows, model.forest).select(
            "YearMonth", "Region", "Product_Category", "Revenue", "prediction"
        )
    )


def linear_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _forecaster(spark, sf_dir)
    return result(model.predict_future(sales_clean(spark, sf_dir), 12, model.linear), Predicted_Revenue=1)


def linear_forecast_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _forecaster(spark, sf_dir)
    rows = model.forecast_all_segments(sales_clean(spark, sf_dir), 6, model.linear)
    return result(rows, Predicted_Revenue=1)


def best_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(_forecaster(spark, sf_dir)[0].predict_future(sales_clean(spark, sf_dir)))


def best_forecast_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(_forecaster(spark, sf_dir)[0].forecast_all_segments(sales_clean(spark, sf_dir)))


def trained_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecaster(spark, sf_dir)[0].metrics_frame(spark)


def loaded_or_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, path = _forecaster(spark, sf_dir)
    return forecast.load_or_train(sales_clean(spark, sf_dir), path).metrics_frame(spark)


def reloaded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, path = _forecaster(spark, sf_dir)
    model = SalesForecaster.load(spark, path)
    rows = model.predict_rows(_lags(sales_clean(spark, sf_dir)))
    return result(rows.select("YearMonth", "Region", "Product_Category", "prediction"))


def reloaded_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the reloaded linear model, and how far both reloaded models are off the fitted ones."""
    fitted, path = _forecaster(spark, sf_dir)
    loaded = SalesForecaster.load(spark, path)
    rows = _landed_lags(spark, sf_dir)
    for name, model in (
        ("_fitted", fitted.linear),
        ("_fitted_forest", fitted.forest),
        ("_forest", loaded.forest),
        ("prediction", loaded.linear),
    ):
        rows = loaded.predict_rows(rows, model).withColumnRenamed("prediction", name)
    return result(
        rows.selectExpr(
            "YearMonth",
            "Region",
            "Product_Category",
            "prediction",
            "abs(prediction - _fitted) AS linear_difference",
            "abs(_forest - _fitted_forest) AS forest_difference",
        ),
        prediction=1,
    )


def forest_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with what a forest has to satisfy: means of labels, and better than the last month."""
    model, _ = _forecaster(spark, sf_dir)
    rows = forecast.train_test_split(_landed_lags(spark, sf_dir))
    ends = rows.where("NOT is_test").agg(
        F.struct(F.min("Revenue").alias("low"), F.max("Revenue").alias("high")).alias("e")
    )
    test = model.predict_rows(rows.where("is_test"), model.forest)
    errors = test.agg(
        (F.avg(F.abs(F.col("Revenue") - F.col("prediction"))) < F.avg(F.abs(F.col("Revenue") - F.col("Previous_Revenue")))).alias("b")
    )
    return result(
        test.withColumns({"_ends": ends.scalar(), "better_than_naive": errors.scalar()}).selectExpr(
            "YearMonth",
            "Region",
            "Product_Category",
            "Revenue",
            "prediction BETWEEN CAST(_ends.low AS DOUBLE) AND CAST(_ends.high AS DOUBLE) AS in_range",
            "better_than_naive",
        )
    )


def forest_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree with one split, on all rows and on lags in coarse steps, which leaves no choice to chance."""
    coarse = {"Previous_Revenue": "least(200, floor(Previous_Revenue / 50000))", "Previous_Sales": "least(200, floor(Previous_Sales / 40))"}
    monthly = _landed_lags(spark, sf_dir).withColumns({c: F.expr(e) for c, e in coarse.items()})
    encoder = forecast.label_encoder(forecast.CODES).fit(monthly)
    model = forecast.fit_forest(forecast.training_rows(monthly, encoder), trees=1, depth=1, bootstrap=False)
    rows = model.transform(forecast._vectors(encoder.transform(monthly)))
    return result(rows.select("YearMonth", "Region", "Product_Category", "prediction"), prediction=2)


def _linear_metrics(model: SalesForecaster, spark: SparkSession) -> DataFrame:
    frame = model.metrics_frame(spark).select("linear_rmse", "linear_mae", "linear_r2")
    return result(frame, linear_rmse=2, linear_mae=2, linear_r2=6)


def trained_linear_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear_metrics(_forecaster(spark, sf_dir)[0], spark)


def loaded_or_trained_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics where no model is saved, which trains one, and where there is one."""
    path, rows = fresh_path(spark, "model"), sales_clean(spark, sf_dir)
    found = []
    for branch in ("absent", "present"):
        metrics = _linear_metrics(forecast.load_or_train(rows, path), spark)
        found.append(metrics.withColumn("branch", F.lit(branch)))
    return found[0].unionByName(found[1])


def linear_forecast_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales_clean(spark, sf_dir)
    model, _ = _forecaster(spark, sf_dir)
    predictions = model.predict_future(df, model=model.linear)
    return result(dashboard.forecast_series(kpi.monthly_revenue(df), predictions), Revenue=1)


def forecast_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales_clean(spark, sf_dir)
    predictions = _forecaster(spark, sf_dir)[0].predict_future(df)
    return result(dashboard.forecast_series(kpi.monthly_revenue(df), predictions))


# --- warehouse -------------------------------------------------------------


def _loaded_twice(load: Callable[[DataFrame, str], None], table: str, columns: list[str]) -> Query:
    """The table after two loads of the same rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh_path(spark, "warehouse")
        rows = sales_lines(spark, sf_dir)
        load(rows, path)
        load(rows, path)
        return result(spark.read.parquet(f"{path}/{table}").select(columns))

    return query


def loaded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = warehouse.load_all(sales_lines(spark, sf_dir), fresh_path(spark, "warehouse"))
    counts = [
        df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in tables.items()
    ]
    first, *others = counts
    for other in others:
        first = first.unionByName(other)
    return result(first)


def broken_star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Star tables in which rows break every rule, told by their line number and slot.

    Values are missing, too long, too large or out of range, keys are not unique, and ids
    that should be are not.
    """
    rows = sales_raw(spark, sf_dir)
    nth = "CAST(substring_index(Order_ID, '-', -1) AS INT)"

    def broken(column: str, at: int) -> str:
        return f"CASE WHEN {nth} = {at} THEN NULL WHEN {nth} = {at + 1} THEN repeat({column}, 30) ELSE {column} END"

    quantity = f"CASE WHEN {nth} = 1 THEN -Quantity WHEN {nth} = 2 THEN Quantity * 1000000000L ELSE CAST(Quantity AS BIGINT) END"
    money = {
        c: f"CASE WHEN {nth} = {k} THEN {c} * 1000000000 ELSE {c} END" for k, c in ((3, "Revenue"), (4, "Profit"))
    }
    return {
        "customers": rows.selectExpr(
            f"{broken('Customer_ID', 5)} AS customer_id", f"{broken('Customer_Name', 1)} AS customer_name"
        ),
        "products": rows.selectExpr(
            f"{broken('Product_Name', 1)} AS product_name",
            f"{broken('Product_Category', 3)} AS product_category",
            f"{nth} AS product_id",
        ),
        "orders": rows.selectExpr(
            f"{broken('Order_ID', 1)} AS order_id",
            f"CASE WHEN {nth} <> 3 THEN Order_Date END AS order_date",
            f"{broken('Customer_ID', 3)} AS customer_id",
            f"{broken('Region', 5)} AS region",
            f"{broken('Sales_Channel', 4)} AS sales_channel",
        ).unionByName(rows.where(f"{nth} = 3").selectExpr(
            "Order_ID AS order_id",
            "Order_Date AS order_date",
            "Customer_ID AS customer_id",
            "Region AS region",
            "Sales_Channel AS sales_channel",
        )),
        "sales": rows.selectExpr(
            f"{broken('Order_ID', 2)} AS order_id",
            f"{broken('Product_Name', 5)} AS product_name",
            f"{quantity} AS quantity",
            f"CASE WHEN {nth} = 1 THEN -Unit_Price WHEN {nth} = 2 THEN Unit_Price * 100000000"
            f" WHEN {nth} <> 3 THEN Unit_Price END AS unit_price",
            f"CASE WHEN {nth} = 1 THEN 2 WHEN {nth} = 2 THEN 12 ELSE Discount END AS discount",
            f"CASE WHEN {nth} = 5 THEN NULL ELSE {money['Revenue']} END AS revenue",
            f"{money['Profit']} AS profit",
            f"{nth} AS sale_id",
        ),
    }


def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of products and of orders."""
    rows = sales_lines(spark, sf_dir)
    products = warehouse.dense_ids(warehouse.product_rows(rows), "id", ["product_name"])
    orders = warehouse.dense_ids(warehouse.order_rows(rows), "id", ["order_id"])
    return result(
        products.selectExpr("'products' AS table", "product_name AS key", "id").unionByName(
            orders.selectExpr("'orders' AS table", "order_id AS key", "id")
        )
    )


def _defaults(df: DataFrame) -> DataFrame:
    rows = warehouse.insert_defaults(warehouse.sales_rows(df))
    return rows.select(
        "order_id", "product_name", "discount", F.col("created_at").isNotNull().alias("has_created_at")
    )


# --- joins on time ---------------------------------------------------------


def rates_asof(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Sales with the exchange rate of their region at their date, and the revenue at that rate."""
    sales = sales_clean(spark, sf_dir).select("Order_ID", "Region", "Order_Date", "Revenue")
    rates = histories.exchange_rates(spark, sf_dir)
    rows = temporal.asof_join(sales, rates, "Region", "Order_Date", "rate_date", ["rate"], **options)
    return result(rows.withColumn("Converted", F.col("Revenue") * F.col("rate")).drop("Revenue"))


def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the same user's last view, if it was at most an hour before."""
    events = read(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.where("event_type = 'view'").selectExpr("user_id", "ts AS viewed", "event_id AS view_id", "value AS view_value")
    rows = temporal.asof_join(bought, viewed, "user_id", "ts", "viewed", ["view_id", "view_value"], tolerance="1 hour")
    return rows.select("event_id", "user_id", "view_id", "view_value")


def promoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with each promotion of their part in force on their day."""
    rows = temporal.interval_join(
        histories.shipped(spark, sf_dir), histories.promotions(spark, sf_dir), "part", "day", "valid_from", "valid_to", "20 days"
    )
    return result(rows.drop("supplier"))


def overlapping_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of promotions of one part that were in force at the same time."""
    a = histories.promotions(spark, sf_dir)
    b = a.selectExpr("part", "promotion AS other", "valid_from AS other_from", "valid_to AS other_to")
    rows = temporal.overlap_join(a, b, "part", ("valid_from", "valid_to"), ("other_from", "other_to"), "20 days")
    return result(rows.where("promotion < other").select("part", "promotion", "other", "valid_from", "other_from"))


# --- cubes and calendars ---------------------------------------------------

DIMENSIONS = ["Region", "Product_Category", "Sales_Channel", "YearMonth"]
SEGMENT = ["Region", "Product_Category"]


def _dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.date_parts(sales_lines(spark, sf_dir))


def loaded_against_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the lines as they come and as the loaded star gives them back: nothing."""
    lines = sales_lines(spark, sf_dir)
    tables = warehouse.load_all(lines, fresh_path(spark, "warehouse"))
    sales = warehouse.sales_rows(lines)
    facts = [c for c in sales.columns if c not in ("order_id", "product_name")]
    names = {"order_id": "Order_ID", "order_date": "Order_Date", "customer_name": "Customer_Name", "product_name": "Product_Name", "region": "Region"}
    flat = lines.select(
        *[F.col(source).alias(c) for c, source in names.items()],
        *[F.col(warehouse.SOURCES[c]).cast(warehouse.SALES_TYPES[c]).alias(c) for c in facts],
    )
    own = warehouse.sales_summary_view(tables).select(flat.columns)
    return result(differences.differences(flat, own, ["order_id"]))


def planted_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines against themselves with some of them changed, left out or twice there."""
    lines = sales_lines(spark, sf_dir).select("Order_ID", "Product_Name", "Region", "Quantity", "Revenue", "_seq.l_suppkey")
    number = F.expr("CAST(substring(Order_ID, 5) AS BIGINT)")
    other = lines.where(number % 211 != 1).withColumns(
        {
            "Revenue": F.when(number % 211 == 2, F.col("Revenue") + F.lit(0.01).cast("decimal(3,2)")).otherwise(F.col("Revenue")).cast("decimal(12,2)"),
            "Region": F.when(number % 211 != 3, F.col("Region")),
        }
    )
    doubled = other.unionByName(other.where(number % 211 == 4))
    return result(differences.differences(lines, doubled, ["Order_ID"]))


_SKETCHED = ["YearMonth", "Region", "Product_Category"]
_COUNTED, _AMOUNTS = ["Customer_ID", "Product_Name", "Order_ID"], ["Revenue", "Profit"]


def _stored_sketches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sketches of distinct values and of amounts per month and segment, stored once."""
    df = sales_clean(spark, sf_dir)
    counts = publish(spark, "distinct_sketches", sf_dir, lambda: sketches.distinct_sketch(df, _SKETCHED, _COUNTED))
    amounts = publish(spark, "quantile_sketches", sf_dir, lambda: sketches.quantile_sketch(df, _SKETCHED, _AMOUNTS))
    return counts, amounts


def sketched_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates per region for some months and categories, from the stored sketches alone."""
    counts, amounts = (
        s.where(F.col("YearMonth").between("1996-03", "1999-06") & F.col("Product_Category").isin(CATEGORIES))
        for s in _stored_sketches(spark, sf_dir)
    )
    distinct = sketches.estimate_distinct(counts, ["Region"]).withColumn("prob", F.lit(None).cast("double"))
    quantiles = sketches.estimate_quantiles(amounts, [0.1, 0.5, 0.9, 0.99], ["Region"])
    return result(distinct.unionByName(quantiles), estimate=6)


def sketch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates for the whole table beside the exact figures, and whether they are near enough."""
    counts, amounts = _stored_sketches(spark, sf_dir)
    df, probs = sales_clean(spark, sf_dir), [0.1, 0.5, 0.9]
    exact = df.agg(*[F.count_distinct(c).cast("double").alias(c) for c in _COUNTED]).unpivot([], _COUNTED, "column", "exact")
    distinct = sketches.estimate_distinct(counts).join(F.broadcast(exact), "column")
    distinct = distinct.withColumns({"prob": F.lit(None).cast("double"), "_allowed": F.lit(0.065)})
    cuts = exact_quantiles(df, _AMOUNTS, probs).withColumnRenamed("value", "exact")
    quantiles = sketches.estimate_quantiles(amounts, probs).join(F.broadcast(cuts), ["column", "prob"])
    both = distinct.unionByName(quantiles.withColumn("_allowed", F.lit(0.01)))  # exact ones lie between two values
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.col("_allowed") * F.abs("exact")
    return result(both.withColumn("within", within).drop("_allowed"), estimate=6, exact=6)


def streamed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(warehouse.sales_summary_view(streams.streamed_star(spark, sf_dir)))


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.streamed_windows(spark, sf_dir)
    return result(rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("window_start", "window_end")}))


# --- registry --------------------------------------------------------------


def registry() -> dict[str, Query]:
    return {
        # files
        "load_sales_csv": load_csv,
        "save_sales_csv": save_csv,
        "csv_round_trip": csv_round_trip,
        "read_summary_sql": lambda s, d: result(warehouse.read_sql(star(s, d))),
        "model_save_load": reloaded_predictions,
        # cleaning
        "fill_discount": _filled("Discount", clean.fill_discount),
        "derive_profit": _filled("Profit", clean.derive_profit),
        "impute_median": _on_raw(_imputed),
        "fill_unknown": _on_raw(_unknowns),
        "dedupe_keep_first": _on_raw(lambda df: clean.dedupe_keep_first(df).drop(SEQ)),
        "coerce_dates": _on_raw(
            lambda df: clean.coerce_dates(_order_dates(df)).select("Order_ID", "Order_Date")
        ),
        "coerce_timestamps": _on_raw(
            lambda df: clean.coerce_dates(_timestamp_text(df)).select("Order_ID", "Order_Date")
        ),
        "date_parts": _on_raw(
            lambda df: clean.date_parts(df).select(
                "Order_ID", "Order_Date", "Year", "Month", "YearMonth", "Quarter"
            )
        ),
        "preprocess": preprocess,
        "preprocess_kpis": preprocess_kpis,
        "line_revenue": lambda s, d: result(
            sales_lines(s, d).select(
                "Order_ID",
                "Quantity",
                "Unit_Price",
                "Discount",
                clean.line_revenue(F.col("Quantity"), F.col("Unit_Price"), F.col("Discount")).alias("Revenue"),
            )
        ),
        "line_profit": lambda s, d: result(
            sales_lines(s, d).select(
                "Order_ID", "Revenue", clean.line_profit(F.col("Revenue"), F.lit("0.7000")).alias("Profit")
            )
        ),
        # filters
        "filter_date_range": _on_clean(
            lambda df: filters.filter_date_range(df, DATES).select("Order_ID", "Order_Date", "Revenue")
        ),
        "filter_region": _on_clean(
            lambda df: filters.filter_region(df, REGIONS).select("Order_ID", "Region", "Revenue")
        ),
        "filter_category": _on_clean(
            lambda df: filters.filter_category(df, CATEGORIES).select(
                "Order_ID", "Product_Category", "Revenue"
            )
        ),
        "filter_channel": _on_clean(
            lambda df: filters.filter_channel(df, CHANNELS).select("Order_ID", "Sales_Channel", "Revenue")
        ),
        "filter_combined": _on_clean(lambda df: _selected(df).select(SALES.names)),
        "date_bounds": _on_clean(filters.date_bounds),
        "filter_options": _on_clean(filters.filter_options),
        "is_empty": _on_selected(filters.is_empty),
        "select_rename": _on_clean(
            lambda df: filters.select_rename(
                df, {"YearMonth": "Month", "Revenue": "Revenue ($)", "Order_ID": "Order"}
            )
        ),
        "drop_null_subset": _on_raw(
            lambda df: filters.drop_null_subset(df, ["Region", "Quantity"]).select(
                "Order_ID", "Region", "Quantity"
            )
        ),
        # key figures
        "total_revenue": _on_clean(kpi.total_revenue),
        "total_profit": _on_clean(kpi.total_profit),
        "total_orders": _on_clean(kpi.total_orders),
        "total_customers": _on_clean(kpi.total_customers),
        "average_order_value": _on_clean(kpi.average_order_value),
        "kpi_scalars": _on_clean(kpi.kpi_scalars),
        "monthly_revenue": _on_clean(kpi.monthly_revenue),
        "monthly_revenue_growth": _on_clean(kpi.monthly_revenue_growth, Revenue_Growth_Pct=6),
        "top_selling_products": _on_clean(kpi.top_selling_products),
        "best_performing_regions": _on_clean(kpi.best_performing_regions),
        "kpi_empty": _on_clean(lambda df: kpi.kpi_scalars(filters.filter_date_range(df, NO_DATES))),
        # profile
        "row_count": _on_clean(profile.row_count),
        "head": _on_clean(lambda df: profile.head(df, 10, [SEQ, "Order_ID"])),
        "column_info": _on_raw(profile.column_info),
        "nunique_per_column": _on_clean(profile.nunique_per_column),
        "missing_report": _on_raw(profile.missing_report),
        "missing_series": _on_raw(profile.missing_series),
        "any_missing": _on_raw(profile.any_missing),
        "describe": _on_clean(profile.describe, std=6, q25=6, q50=6, q75=6),
        "histogram_revenue": _on_clean(
            lambda df: profile.histogram(df, "Revenue"), bin_start=6, bin_end=6
        ),
        "kde_revenue": _on_clean(lambda df: profile.density(df, "Revenue"), x=4, y=4),
        "histogram_profit": _on_clean(
            lambda df: profile.histogram(df, "Profit"), bin_start=6, bin_end=6
        ),
        "kde_profit": _on_clean(lambda df: profile.density(df, "Profit"), x=4, y=4),
        "revenue_by_region_sorted": _on_clean(profile.revenue_by_region),
        "profit_margin": _on_clean(
            lambda df: profile.profit_margin(df).select("Order_ID", "Revenue", "Profit", "Profit_Margin")
        ),
        "profit_by_category": _on_clean(profile.profit_by_category),
        "top10_products": _on_clean(profile.top10_products),
        "customer_stats": _on_clean(profile.customer_stats),
        "top10_customers": _on_clean(lambda df: profile.customer_stats(df, 10)),
        "top15_customers": _on_clean(lambda df: profile.customer_stats(df, 15)),
        "revenue_by_channel_asc": _on_clean(profile.revenue_by_channel),
        "correlation_matrix": _on_clean(profile.correlation_matrix, correlation=8),
        "correlation_with_revenue": _on_clean(profile.correlation_with_revenue, correlation=8),
        # dashboard
        "dash_monthly_trend": _on_selected(dashboard.monthly_trend),
        "dash_revenue_by_region": _on_selected(dashboard.revenue_by_region),
        "dash_revenue_by_category": _on_selected(dashboard.revenue_by_category, Share_Pct=6),
        "dash_top_products": _on_selected(dashboard.top_products),
        "dash_product_profitability": _on_selected(dashboard.product_profitability, Margin_Pct=6),
        "dash_customer_segmentation": _on_selected(dashboard.customer_segmentation),
        "dash_channel_performance": _on_selected(dashboard.channel_performance),
        "dash_forecast_series": forecast_series,
        "format_kpi_cards": _on_selected(dashboard.kpi_cards),
        "format_currency": _on_clean(
            lambda df: kpi.top_selling_products(df).select(
                "Product_Name", formats.short_money(F.col("Revenue")).alias("Revenue")
            )
        ),
        "growth_table": _on_selected(dashboard.growth_table),
        "top_products_table": _on_selected(dashboard.top_products_table),
        "regions_table": _on_selected(dashboard.regions_table),
        # warehouse
        "sales_summary_view": lambda s, d: result(warehouse.sales_summary_view(star(s, d))),
        "sales_summary_view_ambiguous": lambda s, d: result(
            warehouse.sales_summary_view(star(s, d, ambiguous_names=True), name=None)
        ),
        "sales_summary_monthly": lambda s, d: result(warehouse.sales_summary_monthly(star(s, d))),
        "load_customers": _loaded_twice(
            warehouse.load_customers, "customers", ["customer_id", "customer_name"]
        ),
        "load_products": _loaded_twice(
            warehouse.load_products, "products", ["product_id", "product_name", "product_category"]
        ),
        "load_orders": _loaded_twice(
            warehouse.load_orders,
            "orders",
            ["order_id", "order_date", "customer_id", "region", "sales_channel"],
        ),
        "load_sales": _loaded_twice(
            warehouse.load_sales,
            "sales",
            ["order_id", "product_name", "quantity", "unit_price", "discount", "revenue", "profit"],
        ),
        "validate_constraints": lambda s, d: result(warehouse.validate_constraints(broken_star(s, d))),
        "surrogate_ids": surrogate_ids,
        "insert_defaults": _on_raw(_defaults),
        "load_all": loaded_counts,
        # streaming
        "stream_star": streamed_view,
        "stream_event_windows": streamed_windows,
        # joins on time
        "asof_exchange_rate": rates_asof,
        "asof_next_rate": lambda s, d: rates_asof(s, d, direction="forward", strict=True, tolerance="20 days"),
        "asof_last_view": last_view,
        "interval_join_promotions": promoted_lines,
        "overlap_join_promotions": overlapping_promotions,
        # cubes and calendars
        "kpi_cube": lambda s, d: result(cube.kpi_cube(_dated_lines(s, d), DIMENSIONS), average_order_value=6),
        "kpi_rollup": lambda s, d: result(
            cube.kpi_cube(_dated_lines(s, d), DIMENSIONS[::3], cube.rollup_sets(DIMENSIONS[::3])), average_order_value=6
        ),
        "monthly_frames": _on_clean(lambda df: calendar.monthly_frames(df, ["Product_Name"]), year_change_pct=6),
        "monthly_frames_total": _on_clean(calendar.monthly_frames, year_change_pct=6),
        "monthly_ranks": _on_clean(
            lambda df: calendar.monthly_ranks(df, "Product_Name"), percent_rank=8, share_pct=6, running_share_pct=6
        ),
        # differences and densities
        "difference_loaded": loaded_against_flat,
        "difference_planted": planted_differences,
        "kde_revenue_binned": _on_clean(lambda df: profile.density_binned(df, "Revenue"), x=4, y=4),
        "kde_profit_binned": _on_clean(lambda df: profile.density_binned(df, "Profit"), x=4, y=4),
        "forest_stump": forest_stump,
        # sketches and seasons
        "sketched_figures": sketched_figures,
        "sketch_errors": sketch_errors,
        "anomalies": _on_clean(lambda df: seasonal.anomalies(df, SEGMENT), trend=6, season=6, rest=6, score=6),
        "seasonal_forecast": _on_clean(lambda df: seasonal.seasonal_forecast(df, SEGMENT), forecast=2),
        "seasonal_holdout": _on_clean(lambda df: seasonal.holdout_rating(df, SEGMENT), rmse=2, mae=2),
        # forecasting
        "segment_monthly": _on_clean(forecast.segment_monthly),
        "lag_features": _on_clean(_lags),
        "label_encode": lambda s, d: result(forecast.label_encode(_landed_lags(s, d))),
        "train_test_split": _on_clean(
            lambda df: forecast.train_test_split(_lags(df)).select(
                "YearMonth", "Region", "Product_Category", "is_test"
            )
        ),
        "fit_linear": linear_coefficients,
        "fit_forest": forest_predictions,
        "regression_metrics": _on_clean(
            _naive_metrics, linear_rmse=4, linear_mae=4, linear_r2=8, rf_rmse=4, rf_mae=4, rf_r2=8
        ),
        "select_model": _on_clean(
            lambda df: forecast.select_model(_naive_metrics(df)).select("best_model_name")
        ),
        "future_months": _on_clean(lambda df: forecast.future_months(df, 12)),
        "forecast_seed": _on_clean(forecast.forecast_seed),
        "segment_seeds": _on_clean(forecast.segment_seeds),
        "predict_future": best_forecast,
        "predict_future_linear": linear_forecast,
        "forecast_all_segments": best_forecast_all,
        "forecast_all_segments_linear": linear_forecast_all,
        "train_and_save": trained_metrics,
        "load_or_train": loaded_or_trained,
        "model_save_load_linear": reloaded_linear,
        "fit_forest_properties": forest_properties,
        "train_and_save_linear": trained_linear_metrics,
        "load_or_train_linear": loaded_or_trained_linear,
        "dash_forecast_series_linear": linear_forecast_series,
        "quantity_decay": _on_clean(lambda df: forecast.quantity_decay(df, 12), Previous_Sales=6),
    }
