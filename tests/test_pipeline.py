import time
from pathlib import Path

import pytest

from salescope.operators import clean
from salescope.plans import pipeline, queries
from salescope.plans.pipeline import preprocess_pipeline
from salescope.schema import CLEAN_COLUMNS
from salescope.sources import shared
from salescope.sources.csv import save_sales_csv


def test_pipeline_from_files(spark, sales, tmp_path):
    path = str(tmp_path / "in")
    save_sales_csv(
        sales(
            {"Order_ID": "A", "Discount": None, "Revenue": "10.00"},
            {"Order_ID": "A", "Revenue": "99.00"},
            {"Order_ID": "B", "Order_Date": "bad"},
            {"Order_ID": "C", "Order_Date": "2024-02-01", "Revenue": "15.00"},
        ).coalesce(1),
        path,
    )
    cleaned, kpis = preprocess_pipeline(spark, path)
    assert set(CLEAN_COLUMNS) <= set(cleaned.columns)
    assert sorted(r.Order_ID for r in cleaned.collect()) == ["A", "C"]
    growth = [(r.YearMonth, r.Revenue_Growth_Pct) for r in kpis["monthly_revenue_growth"].collect()]
    assert growth == [("2024-01", None), ("2024-02", 50.0)]
    assert dict(cleaned.dtypes)["YearMonth"] == "string"


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        preprocess_pipeline(spark, str(tmp_path / "none"))


def test_a_key_with_a_third_of_all_rows(spark):
    """The hot key leaves one row per task before the shuffle, and results stay whole."""
    df = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'Unknown' ELSE concat('O', id) END AS Order_ID", "id AS _seq"
    )
    kept = clean.dedupe_keep_first(df)
    rows = {r.Order_ID: r["_seq"] for r in kept.collect()}
    assert len(rows) == 20001 and rows["Unknown"] == 0


def test_published_once_per_source(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).withColumnRenamed("id", "n")

    first = shared.publish(spark, "numbers", "here", build)
    assert shared.publish(spark, "numbers", "here", build) is first
    assert len(calls) == 1 and sorted(r.n for r in first.collect()) == [0, 1, 2]


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared.fresh_path(spark, "x").startswith(named.rstrip("/"))
    else:
        assert shared.shared_dir(spark) == shared.shared_dir(spark)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master, applicationId = "yarn", "app-without-folder"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_landed_tables_are_deleted(spark, sf_dir, tmp_path):
    kept = str(tmp_path / "clean")
    with shared.landing(spark):
        path = queries._csv_file(spark, sf_dir)
        before = set(shared._landed[spark.sparkContext.applicationId])
        cleaned, _ = preprocess_pipeline(spark, path, target=kept)
        assert set(shared._landed[spark.sparkContext.applicationId]) == before  # the typed copy is gone
        inside = shared.land(spark.range(3), "three")
        inside_path = shared._landed[spark.sparkContext.applicationId][-1]
        assert inside.count() == 3
    assert not Path(inside_path).exists()
    assert cleaned.count() > 0 and Path(kept).exists()
    # What was published inside is made anew when it is asked for again.
    assert queries.sales_raw(spark, sf_dir).count() > 0


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}


def test_a_landed_table_leaves_no_shuffle_files(spark):
    with shared.landing(spark):
        before = _shuffle_files(spark)
        df = shared.land(spark.range(1000).repartition(5, "id"), "dealt")
        for _ in range(50):  # they go in the background
            if not (left := _shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left and df.count() == 1000
    assert all(spark.conf.get(name, None) is None for name in shared.NO_LEFTOVERS)  # the session's own setting is as it was


def test_preprocessing_shuffles_by_key_and_by_month_in_turn(spark, sales, tmp_path, monkeypatch):
    rows = [{"Order_ID": f"O{k % 4}", "Order_Date": f"2024-0{1 + k % 4}-05"} for k in range(12)]
    save_sales_csv(sales(*rows).coalesce(1), str(tmp_path / "csv"))
    plans = {}

    def land(df, name, *args, **kwargs):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return shared.land(df, name, *args, **kwargs)

    monkeypatch.setattr(pipeline, "land", land)
    cleaned, _ = preprocess_pipeline(spark, str(tmp_path / "csv"), target=str(tmp_path / "clean"))
    assert "Window" in plans["sales_single"] and "Rebalance" not in plans["sales_single"]
    assert "Rebalance" in plans["sales_clean"] and "Window" not in plans["sales_clean"]
    found = cleaned.select("Order_ID", "Year", "Month", "YearMonth", "Quarter").collect()
    assert sorted(map(tuple, found)) == [(f"O{k}", 2024, k + 1, f"2024-0{k + 1}", 1 + k // 3) for k in range(4)]


def test_csv_files_of_a_query_go_with_it(spark, sf_dir):
    with shared.landing(spark):
        assert queries.preprocess_kpis(spark, sf_dir).count() == 1
        assert not [p for p in shared._landed[spark.sparkContext.applicationId] if "/sales_csv-" in p]
