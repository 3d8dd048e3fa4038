"""From CSV files to the cleaned table and its key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salescope.operators.clean import clean, date_parts
from salescope.operators.kpi import calculate_kpis
from salescope.sources.csv import load_sales_csv
from salescope.sources.shared import fresh_path, land, release


def preprocess_pipeline(
    spark: SparkSession, path: str, keys: list[str] | None = None, target: str | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Load, fill, deduplicate, date; returns the cleaned table and its key figures.

    Text is parsed once: the typed rows are landed, because the medians read some of
    their columns again. So are the rows without copies, and the typed ones are then released: the
    shuffles by key and by month are never on disk together. The cleaned table is written
    by month, as every key figure and every filter reads it: to ``target``, which is the
    caller's, or to the shared folder until the application ends.
    """
    typed, single = fresh_path(spark, "sales_raw"), fresh_path(spark, "sales_single")
    try:
        raw = land(load_sales_csv(spark, path), "sales_raw", path=typed, compression="zstd")
        rows = land(clean(raw, keys), "sales_single", path=single, compression="zstd")
        release(spark, typed)
        # The other parts of the date are made again behind the shuffle.
        moved = rows.drop("Year", "Month", "Quarter").hint("rebalance", "YearMonth")
        by_month = date_parts(moved).select(rows.columns)
        compression = "zstd" if target is None else None
        cleaned = land(by_month, "sales_clean", "YearMonth", path=target, rebalance=False, compression=compression)
    finally:
        release(spark, typed, single)
    return cleaned, calculate_kpis(cleaned)
