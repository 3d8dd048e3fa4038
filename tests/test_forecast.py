import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.operators import clean, dashboard, forecast, kpi
from salescope.operators.forecast import SalesForecaster


@pytest.fixture(scope="module")
def history(spark):
    """Thirty months of two regions and two categories, revenue in cents."""
    df = spark.sql(
        """
        SELECT concat('O', m, r, c) AS Order_ID, add_months(date'2022-01-15', m) AS Order_Date,
            concat('R', r) AS Region, concat('P', c) AS Product_Category,
            CAST(3 + (m * 7 + r * 5 + c * 3) % 11 AS DOUBLE) AS Quantity,
            CAST(100 + m * 3 + r * 40 + c * 15 + (m * m + r) % 13 AS DECIMAL(16,4)) AS Revenue
        FROM (SELECT explode(sequence(0, 29)) AS m), (SELECT explode(array(1, 2)) AS r),
            (SELECT explode(array(1, 2)) AS c)
        """
    )
    return clean.date_parts(df).persist()


@pytest.fixture(scope="module")
def model(history):
    return SalesForecaster.train(history)


def test_lags_take_the_row_before_in_the_segment(history):
    monthly = forecast.segment_monthly(history)
    lags = forecast.lag_features(monthly)
    assert monthly.count() == 120 and lags.count() == 116
    first = lags.where("Region = 'R1' AND Product_Category = 'P1'").orderBy("YearMonth").first()
    assert (first.YearMonth, first.Month) == ("2022-02", 2)


def test_labels_are_coded_in_alphabetical_order(history):
    coded = forecast.label_encode(forecast.segment_monthly(history))
    assert sorted({(r.Region, r.Product_Category) for r in coded.collect()}) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_unseen_label_is_an_error(model, history):
    rows = forecast.lag_features(forecast.segment_monthly(history)).withColumn("Region", F.lit("R9"))
    with pytest.raises(Exception, match="(?i)unseen label"):
        model.predict_rows(rows).collect()


def test_split_depends_on_the_row_alone(history):
    lags = forecast.lag_features(forecast.segment_monthly(history))
    one = forecast.train_test_split(lags).where("is_test").count()
    other = forecast.train_test_split(lags.repartition(9)).where("is_test").count()
    assert one == other and 10 <= one <= 40


def test_linear_model_is_least_squares(history):
    lags = forecast.lag_features(forecast.segment_monthly(history))
    encoder = forecast.label_encoder(forecast.CODES).fit(lags)
    rows = forecast.training_rows(lags, encoder).where("NOT is_test")
    data = [(r.features.toArray(), r.label) for r in rows.collect()]
    x = np.array([[*f, 1.0] for f, _ in data])
    expected = np.linalg.lstsq(x, np.array([y for _, y in data]), rcond=None)[0]
    stage = forecast.fit_linear(rows).stages[-1]
    assert [*stage.coefficients, stage.intercept] == pytest.approx(expected.tolist(), rel=1e-6)


def test_metrics_equal_their_definition(spark):
    y, p = np.array([1.0, 2.0, 4.0, 8.0]), np.array([1.5, 2.0, 3.0, 9.0])
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "label double, prediction double")
    row = forecast.regression_metrics(df, m="prediction").first()
    assert row.m_rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert row.m_mae == pytest.approx(np.mean(np.abs(y - p)))
    assert row.m_r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


@pytest.mark.parametrize("rf,name", [(1.0, "Random Forest"), (2.0, "Random Forest"), (2.1, "Linear Regression")])
def test_the_forest_wins_a_draw(spark, rf, name):
    df = spark.createDataFrame([(2.0, rf)], "linear_rmse double, rf_rmse double")
    assert forecast.select_model(df).first().best_model_name == name


def test_months_follow_the_last_month_of_all_data(history):
    months = [r.YearMonth for r in forecast.future_months(history, 8).orderBy("step").collect()]
    assert months == ["2024-07", "2024-08", "2024-09", "2024-10", "2024-11", "2024-12", "2025-01", "2025-02"]


def test_seed_is_the_last_segment_not_the_last_month(history):
    df = history.where("NOT (Region = 'R2' AND Product_Category = 'P2' AND YearMonth > '2023-01')")
    seed = forecast.forecast_seed(df).first()
    assert (seed.Region, seed.Product_Category, seed.YearMonth) == ("R2", "P2", "2023-01")
    assert str(seed.Last_Month) == "2024-06-01"


def test_forecast_feeds_predictions_back(model, history):
    seed = forecast.forecast_seed(history).first()
    revenue, sales = float(seed.Previous_Revenue), float(seed.Previous_Sales)
    stage = model.linear.stages[-1]
    expected = []
    for month in (7, 8, 9, 10):
        features = [month, 1, 1, revenue, sales]
        revenue = max(float(np.dot(stage.coefficients.toArray(), features)) + stage.intercept, 0.0)
        expected.append(round(revenue, 2))
        sales *= 0.95
    rows = model.predict_future(history, 4, model.linear).collect()
    assert [r.Predicted_Revenue for r in rows] == pytest.approx(expected)
    assert [r.YearMonth for r in rows] == ["2024-07", "2024-08", "2024-09", "2024-10"]


def test_single_forecast_is_the_last_segment_of_all(model, history):
    one = [tuple(r) for r in model.predict_future(history, 3).collect()]
    every = model.forecast_all_segments(history, 3)
    last = every.where("Region = 'R2' AND Product_Category = 'P2'").orderBy("YearMonth")
    assert [tuple(r)[2:] for r in last.collect()] == one
    assert every.count() == 12
    assert every.agg(F.min("Predicted_Revenue")).first()[0] >= 0


def test_saved_model_predicts_the_same(spark, model, history, tmp_path):
    path = str(tmp_path / "model")
    model.save(spark, path)
    loaded = forecast.load_or_train(history, path)
    assert loaded.metrics == model.metrics and loaded.best_model_name == model.best_model_name
    assert loaded.predict_future(history).collect() == model.predict_future(history).collect()


def test_missing_model_is_an_error_and_a_broken_one_is_replaced(spark, model, history, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        SalesForecaster.load(spark, path)
    monkeypatch.setattr(SalesForecaster, "train", classmethod(lambda cls, df: model))
    model.metrics_frame(spark).write.parquet(f"{path}/metrics")  # metrics without models
    assert forecast.load_or_train(history, path).best_model_name == model.best_model_name
    assert SalesForecaster.load(spark, path).metrics == model.metrics


def test_series_joins_past_and_future(model, history):
    series = dashboard.forecast_series(kpi.monthly_revenue(history), model.predict_future(history, 3))
    kinds = [r.kind for r in series.collect()]
    assert kinds == ["history"] * 30 + ["forecast"] * 3


def test_quantity_fades(history):
    rows = forecast.quantity_decay(history, 3).orderBy("step").collect()
    assert rows[2].Previous_Sales == pytest.approx(rows[0].Previous_Sales * 0.95**2)
