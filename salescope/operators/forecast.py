"""Monthly revenue forecasts per region and product category.

The heavy step is the aggregation to one row per month and segment. The models
train on that result with MLlib, and the forecast applies a model at most a dozen
times in a row to one row per segment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.functions.values import ratio
from salescope.operators.kpi import grouped, total
from salescope.sources.shared import land

# Model settings and forecast rules.
SEGMENT = ["Region", "Product_Category"]
FEATURES = ["Month", "Region", "Product_Category", "Previous_Revenue", "Previous_Sales"]
TREES = 100
DEPTH = 10
SEED = 42
BINS = 256
TEST_SHARE = 0.2
SALES_DECAY = 0.95
PERIODS = 6
LINEAR = "Linear Regression"
FOREST = "Random Forest"

CODES = {"Region": "_region_code", "Product_Category": "_category_code"}


# --- features --------------------------------------------------------------


def segment_monthly(df: DataFrame) -> DataFrame:
    """Revenue and quantity per month, region and category, and the month number."""
    return grouped(
        df, ["YearMonth", *SEGMENT], Revenue=total("Revenue"), Quantity=total("Quantity")
    ).withColumn("Month", F.substring("YearMonth", 6, 2).cast("int"))


def lag_features(monthly: DataFrame) -> DataFrame:
    """Revenue and quantity of the segment's row before; first rows are dropped."""
    before = Window.partitionBy(*SEGMENT).orderBy("YearMonth")
    return monthly.withColumns(
        {
            "Previous_Revenue": F.lag("Revenue").over(before),
            "Previous_Sales": F.lag("Quantity").over(before),
        }
    ).dropna(subset=["Previous_Revenue", "Previous_Sales"])


def label_encoder(columns: dict[str, str]) -> StringIndexer:
    """Codes 0, 1, … in alphabetical order; a label not seen in training is an error."""
    return StringIndexer(
        inputCols=list(columns),
        outputCols=list(columns.values()),
        stringOrderType="alphabetAsc",
        handleInvalid="error",
    )


def label_encode(df: DataFrame, columns: list[str] = SEGMENT) -> DataFrame:
    """The frame with its labels replaced by their codes."""
    codes = {c: f"_{c}_code" for c in columns}
    coded = label_encoder(codes).fit(df).transform(df)
    # The code must be a plain number to later stages, so its label metadata goes.
    return coded.withColumns(
        {c: F.col(code).cast("int").alias(c, metadata={}) for c, code in codes.items()}
    ).drop(*codes.values())


def train_test_split(df: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    """Adds ``is_test``, true for about a fifth of the rows.

    The choice hashes the row's month and segment. Unlike a random draw it does not
    depend on how rows are partitioned, and a row keeps its part as data is added.
    """
    limit = f"{int(share * 0xFFFF):04x}"
    digest = F.md5(F.concat_ws("|", "YearMonth", *SEGMENT))
    return df.withColumn("is_test", F.substring(digest, 1, 4) < F.lit(limit))


# --- models ----------------------------------------------------------------


def _vectors(coded: DataFrame) -> DataFrame:
    """Adds the feature vector of encoded rows; codes count as ordinary numbers in it."""
    columns = {f"_{c}": F.col(CODES.get(c, c)).cast("double") + F.lit(0.0) for c in FEATURES}
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return assembler.transform(coded.withColumns(columns)).drop(*columns)


def training_rows(monthly: DataFrame, encoder: StringIndexerModel) -> DataFrame:
    """Rows of (features, label, is_test) from lag features."""
    return _vectors(encoder.transform(train_test_split(monthly))).select(
        "features", F.col("Revenue").cast("double").alias("label"), "is_test"
    )


def fit_linear(rows: DataFrame) -> PipelineModel:
    """Least squares with an intercept, on rows of (features, label)."""
    stage = LinearRegression(solver="normal", regParam=0.0, standardization=False)
    return Pipeline(stages=[stage]).fit(rows)


def fit_forest(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, bootstrap: bool = True) -> PipelineModel:
    """A forest that tries all features at each split, on rows of (features, label).

    Without ``bootstrap`` each tree sees all rows once, so that one tree has no random part.
    """
    stage = RandomForestRegressor(
        numTrees=trees,
        maxDepth=depth,
        bootstrap=bootstrap,
        seed=SEED,
        featureSubsetStrategy="all",
        maxBins=BINS,
        maxMemoryInMB=1024,
        cacheNodeIds=True,
    )
    return Pipeline(stages=[stage]).fit(rows)


def _errors(label: str, prediction: str) -> dict[str, Column]:
    y = F.col(label).cast("double")
    error = y - F.col(prediction).cast("double")
    # Σ(y-ȳ)² as n times the variance, which needs no second pass for the mean.
    spread = F.var_pop(y) * F.count(y)
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r2": 1 - ratio(F.sum(error * error), spread),
    }


def regression_metrics(df: DataFrame, label: str = "label", **predictions: str) -> DataFrame:
    """Root mean squared error, mean absolute error and R² as one row.

    ``regression_metrics(df, linear="p1", rf="p2")`` rates two columns in one pass
    and names the results ``linear_rmse`` and so on.
    """
    return df.agg(
        *[
            value.alias(f"{name}_{metric}")
            for name, column in predictions.items()
            for metric, value in _errors(label, column).items()
        ]
    )


def select_model(metrics: DataFrame) -> DataFrame:
    """Adds the better model's name; on a draw the forest wins."""
    best = F.when(F.col("rf_rmse") <= F.col("linear_rmse"), FOREST).otherwise(LINEAR)
    return metrics.withColumn("best_model_name", best)


@dataclass
class SalesForecaster:
    """Both fitted models, the label encoder and the metrics of the test part."""

    encoder: StringIndexerModel
    linear: PipelineModel
    forest: PipelineModel
    metrics: dict[str, float]
    best_model_name: str

    @classmethod
    def train(cls, df: DataFrame) -> SalesForecaster:
        """Fits both models on four fifths of the segment months, rates them on the rest."""
        # Landed, so that the sales are aggregated once and not for every use below.
        monthly = land(lag_features(segment_monthly(df)), "lag_features")
        encoder = label_encoder(CODES).fit(monthly)
        # Few rows that the forest reads once per tree level: keep them at hand.
        rows = training_rows(monthly, encoder).persist()
        fitting, test = rows.where("NOT is_test"), rows.where("is_test")
        linear, forest = fit_linear(fitting), fit_forest(fitting)
        rated = forest.transform(
            linear.transform(test).withColumnRenamed("prediction", "by_linear")
        ).withColumnRenamed("prediction", "by_forest")
        metrics = regression_metrics(rated, linear="by_linear", rf="by_forest")
        found = select_model(metrics).first().asDict()
        rows.unpersist()
        name = found.pop("best_model_name")
        return cls(encoder, linear, forest, found, name)

    @property
    def best(self) -> PipelineModel:
        return self.forest if self.best_model_name == FOREST else self.linear

    def metrics_frame(self, spark: SparkSession) -> DataFrame:
        row = {**self.metrics, "best_model_name": self.best_model_name}
        return spark.createDataFrame([tuple(row.values())], list(row))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes models, encoder and metrics below ``path``, replacing what is there."""
        self.encoder.write().overwrite().save(f"{path}/encoder")
        self.linear.write().overwrite().save(f"{path}/linear")
        self.forest.write().overwrite().save(f"{path}/forest")
        self.metrics_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SalesForecaster:
        """Reads what :meth:`save` wrote. Raises FileNotFoundError if nothing is there."""
        metrics = read_metrics(spark, path)
        name = metrics.pop("best_model_name")
        return cls(
            StringIndexerModel.load(f"{path}/encoder"),
            PipelineModel.load(f"{path}/linear"),
            PipelineModel.load(f"{path}/forest"),
            metrics,
            name,
        )

    def predict_rows(self, df: DataFrame, model: Transformer | None = None) -> DataFrame:
        """Lag-feature rows with a ``prediction`` column."""
        rows = (model or self.best).transform(_vectors(self.encoder.transform(df)))
        return rows.drop("features", *CODES.values())

    def forecast(
        self, seeds: DataFrame, periods: int = PERIODS, model: Transformer | None = None
    ) -> DataFrame:
        """Predicted revenue of the months after ``Last_Month`` for each seed row.

        Each step feeds the prediction before rounding into the next one and lets the
        quantity fade by 5 %. All steps are one chain of projections over the seeds.
        """
        model = model or self.best
        kept = [*SEGMENT, *CODES.values(), "Last_Month"]
        state = self.encoder.transform(seeds).selectExpr(
            *kept,
            "CAST(Previous_Revenue AS DOUBLE) AS Previous_Revenue",
            "CAST(Previous_Sales AS DOUBLE) AS Previous_Sales",
            "CAST(array() AS array<double>) AS done",
        )
        for step in range(1, periods + 1):
            months = state.selectExpr("*", f"month(add_months(Last_Month, {step})) AS Month")
            state = model.transform(_vectors(months)).selectExpr(
                *kept,
                "greatest(prediction, 0D) AS Previous_Revenue",
                f"Previous_Sales * {SALES_DECAY}D AS Previous_Sales",
                "array_append(done, greatest(prediction, 0D)) AS done",
            )
        return state.selectExpr(*SEGMENT, "Last_Month", "posexplode(done) AS (pos, revenue)").selectExpr(
            *SEGMENT,
            "date_format(add_months(Last_Month, pos + 1), 'yyyy-MM') AS YearMonth",
            "round(revenue, 2) AS Predicted_Revenue",
        )

    def predict_future(
        self, df: DataFrame, periods: int = PERIODS, model: Transformer | None = None
    ) -> DataFrame:
        """Forecast from the last segment in sort order, by month."""
        return (
            self.forecast(forecast_seed(df), periods, model)
            .select("YearMonth", "Predicted_Revenue")
            .orderBy("YearMonth")
        )

    def forecast_all_segments(
        self, df: DataFrame, periods: int = PERIODS, model: Transformer | None = None
    ) -> DataFrame:
        """The same forecast for every segment at once."""
        return self.forecast(segment_seeds(df), periods, model)


def read_metrics(spark: SparkSession, path: str) -> dict:
    """The saved metrics and the name of the better model."""
    try:
        return spark.read.parquet(f"{path}/metrics").first().asDict()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no model at {path}") from error
        raise


# What Spark says of a model folder that is missing in part or is no model.
_UNREADABLE = r"PATH_NOT_FOUND|Input path does not exist|UNABLE_TO_INFER_SCHEMA|CANNOT_READ_FILE_FOOTER|is not a Parquet file|FileNotFoundException|UNRESOLVED_COLUMN|NoSuchElementException|RDD is empty|empty collection"


def train_and_save(df: DataFrame, path: str) -> SalesForecaster:
    forecaster = SalesForecaster.train(df)
    forecaster.save(df.sparkSession, path)
    return forecaster


def load_or_train(df: DataFrame, path: str) -> SalesForecaster:
    """The saved model if there is a readable one, else a new one, which is saved.

    A model counts as absent or unreadable if files of it are missing or are not what
    :meth:`SalesForecaster.save` writes. Any other failure, such as storage that cannot be
    reached, is raised, so that it never replaces a good model.
    """
    try:
        return SalesForecaster.load(df.sparkSession, path)
    except (FileNotFoundError, KeyError):
        return train_and_save(df, path)
    except (AnalysisException, Py4JJavaError) as error:
        if not re.search(_UNREADABLE, str(error)):
            raise
        return train_and_save(df, path)


# --- forecast inputs -------------------------------------------------------


def last_month(df: DataFrame) -> Column:
    """First day of the last month with data, as a scalar subquery."""
    return df.select(F.to_date(F.concat(F.max("YearMonth"), F.lit("-01")))).scalar()


def future_months(df: DataFrame, periods: int = PERIODS) -> DataFrame:
    """The months after the last one with data, as (step, YearMonth)."""
    steps = df.agg(F.max("YearMonth").alias("last")).select(
        F.to_date(F.concat("last", F.lit("-01"))).alias("last"),
        F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"),
    )
    return steps.select("step", F.date_format(F.add_months("last", F.col("step")), "yyyy-MM").alias("YearMonth"))


def segment_seeds(df: DataFrame) -> DataFrame:
    """Latest lag-feature row of each segment, with the last month of all data."""
    latest = F.max_by(F.struct("Previous_Revenue", "Previous_Sales", "YearMonth"), "YearMonth")
    return (
        lag_features(segment_monthly(df))
        .groupBy(*SEGMENT)
        .agg(latest.alias("latest"))
        .select(*SEGMENT, "latest.*", last_month(df).alias("Last_Month"))
    )


def forecast_seed(df: DataFrame) -> DataFrame:
    """Lag-feature row that is last by region, category and month."""
    order = [F.desc(c) for c in (*SEGMENT, "YearMonth")]
    return (
        lag_features(segment_monthly(df))
        .orderBy(*order)
        .limit(1)
        .select(
            *SEGMENT, "Previous_Revenue", "Previous_Sales", "YearMonth", last_month(df).alias("Last_Month")
        )
    )


def quantity_decay(df: DataFrame, periods: int = PERIODS) -> DataFrame:
    """The quantity that each step of the forecast assumes."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
    return forecast_seed(df).select("Last_Month", "Previous_Sales", steps).select(
        "step",
        F.date_format(F.add_months("Last_Month", F.col("step")), "yyyy-MM").alias("YearMonth"),
        (F.col("Previous_Sales") * F.pow(F.lit(SALES_DECAY), F.col("step") - 1)).alias("Previous_Sales"),
    )
