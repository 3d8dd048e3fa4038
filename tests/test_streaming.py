"""Streams against batches: late and repeated rows, restarts, repeated batches, rows after the watermark."""

import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from salescope.operators import clean, warehouse
from salescope.plans import streams
from salescope.plans.fixtures import sales_raw
from salescope.schema import SEQ
from salescope.sources import shared
from salescope.streaming import ingest
from salescope.streaming.tables import KeyedLog

MEDIANS = {"Quantity": 2.0, "Unit_Price": 10, "Revenue": 20, "Profit": 5}


@pytest.fixture
def arrive(sales, tmp_path):
    """Lets rows arrive as one more file."""

    def write(*rows):
        sales(*rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "arriving"))

    return write


@pytest.fixture
def lines(spark, sales, tmp_path):
    """The stream over what has arrived, one file in a batch."""
    schema = sales({}).schema
    return lambda: ingest.cleaned_lines(ingest.read_files(spark, str(tmp_path / "arriving"), schema, 1), MEDIANS)


def row(order, day, seq_of, **values):
    # The fixture numbers rows by their place; ties between copies are told by the revenue.
    return {"Order_ID": f"O{order}", "Order_Date": day, "Revenue": seq_of, "Customer_ID": f"C{order % 3}", **values}


def contents(star):
    return {
        name: sorted(map(str, (tuple(r) for r in df.select(columns).collect())))
        for name, columns in warehouse.STAR_COLUMNS.items()
        for df in [star[name]]
    }


def expected(spark, tmp_path):
    """The star of all that has arrived, as one batch."""
    rows = ingest.cleaned_lines(spark.read.parquet(str(tmp_path / "arriving")), MEDIANS)
    firsts = clean.dedupe_keep_first(rows, order=[SEQ, "Customer_ID", "Customer_Name", "Product_Category", "Product_Name", "Region", "Quantity", "Unit_Price", "Discount", "Revenue"])
    return contents(
        {
            "customers": warehouse.customer_rows(firsts),
            "products": warehouse.product_rows(firsts),
            "orders": warehouse.order_rows(firsts),
            "sales": warehouse.sales_rows(firsts),
        }
    )


def test_many_batches_give_what_one_gives(spark, arrive, lines, tmp_path):
    into = ingest.SalesIngest(spark, str(tmp_path / "star"))
    arrive(row(1, "2024-01-05", "10.00"), row(2, "2024-01-20", "11.00", Region=None, Quantity=None))
    arrive(row(1, "2024-01-05", "09.00"), row(3, "2024-01-02", "12.00", Product_Name="Kite"))  # a copy that is earlier; a late row
    arrive(row(2, "2024-01-20", "11.00", Region=None, Quantity=None), row(4, "bad date", "1.00"))
    assert into.run(lines()) == ingest.Arrived(3, 6, 0)
    first = contents(into.star())
    assert first == expected(spark, tmp_path)
    assert any("9.00" in r and "O1" in r for r in first["sales"])

    assert into.run(lines()) == ingest.Arrived(0, 0, 0)  # a restart without new files
    assert contents(into.star()) == first

    arrive(row(5, "2024-02-01", "13.00", Discount=None, Profit=None), row(3, "2024-01-02", "12.00", Product_Name="Kite"))
    assert into.run(lines()).rows == 2  # a restart goes on
    assert contents(into.star()) == expected(spark, tmp_path)
    ids = [r.product_id for r in into.star()["products"].collect()]
    assert sorted(ids) == [1, 2]


def test_a_batch_that_fails_midway_is_repeated(spark, arrive, lines, tmp_path, monkeypatch):
    into = ingest.SalesIngest(spark, str(tmp_path / "star"))
    arrive(row(1, "2024-01-05", "10.00"), row(2, "2024-01-06", "10.00"))
    into.run(lines())
    arrive(row(3, "2024-01-07", "10.00", Product_Name="Kite"))
    products = into.tables["products"]
    monkeypatch.setattr(products, "put", lambda *_: 1 / 0)  # lines and customers are written by then
    with pytest.raises(Exception, match="division by zero"):
        into.run(lines())
    monkeypatch.undo()
    into.run(lines())
    assert contents(into.star()) == expected(spark, tmp_path)


def test_rows_after_the_watermark_are_counted_and_caught_up(spark, arrive, lines, tmp_path):
    into = ingest.SalesIngest(spark, str(tmp_path / "star"))
    for k, day in enumerate(("2024-01-01", "2024-06-01", "2024-06-02", "2024-01-02")):
        arrive(row(k, day, "10.00", Product_Name=f"P{k}"))
    assert into.run(lines()).late_rows == 1
    assert len(contents(into.star())["sales"]) == 3
    into.catch_up(ingest.cleaned_lines(spark.read.parquet(str(tmp_path / "arriving")), MEDIANS))
    assert contents(into.star()) == expected(spark, tmp_path)
    assert sorted(r.product_id for r in into.star()["products"].collect()) == [1, 2, 3, 4]
    arrive(row(9, "2024-06-03", "10.00"))  # after the base table was made
    into.run(lines())
    assert contents(into.star()) == expected(spark, tmp_path)


def test_nothing_has_arrived(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing has arrived"):
        ingest.SalesIngest(spark, str(tmp_path / "star")).star()


def test_log_keeps_the_newest_row_of_each_key(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), ["k"])
    assert log.current() is None

    def put(batch, *rows):
        log.put(spark.createDataFrame(rows, "k string, v int"), batch)

    def rows():
        return sorted((tuple(r) for r in log.current().collect()), key=str)

    put(0, ("a", 1), (None, 2))
    put(1, ("a", 3), ("b", 4))
    put(1, ("a", 5), ("b", 6))  # the same batch again
    assert rows() == sorted([("a", 5), ("b", 6), (None, 2)], key=str)
    assert sorted(r.v for r in log.current(before=1).collect()) == [1, 2]
    log.compact()
    log.compact()
    assert rows() == sorted([("a", 5), ("b", 6), (None, 2)], key=str)
    put(2, (None, 7), ("c", 8))
    assert rows() == sorted([("a", 5), ("b", 6), (None, 7), ("c", 8)], key=str)
    log.compact(spark.createDataFrame([("c", 0), ("d", 9)], "k string, v int"))
    assert rows() == sorted([("a", 5), ("b", 6), (None, 7), ("c", 8), ("d", 9)], key=str)


def test_windows_come_once_when_they_are_closed(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, event_type string, value double"

    def arrive(*events):
        rows = [(i, start + timedelta(minutes=m), kind, v) for i, m, kind, v in events]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = ingest.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
        return ingest.run_windows(stream, str(tmp_path / "out"), "1 hour", "30 minutes")

    def windows():
        found = spark.read.parquet(str(tmp_path / "out" / "windows")).collect()
        return sorted(((r.window_start - start).seconds // 3600, r.event_type, r.events, float(r.value)) for r in found)

    arrive((1, 5, "a", 1.0), (2, 50, "b", 2.0), (2, 50, "b", 2.0))
    arrive((3, 70, "a", 4.0), (1, 5, "a", 1.0), (4, 45, "a", 0.5))  # a copy, and a late event
    run()
    assert windows() == []
    arrive((5, 95, "a", 8.0))
    run()
    assert windows() == [(0, "a", 2, 1.5), (0, "b", 1, 2.0)]
    arrive((6, 10, "a", 16.0), (7, 200, "b", 1.0))  # the first is too late
    assert run().late_rows == 1
    assert windows() == [(0, "a", 2, 1.5), (0, "b", 1, 2.0), (1, "a", 2, 12.0)]
    run()
    assert len(windows()) == 3


def test_deliveries_are_written_once_in_the_order_of_arrival(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"e{k}", start + timedelta(minutes=10 * k)) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id string, ts timestamp")
    before = list(shared._landed.get(spark.sparkContext.applicationId, []))
    seen, latest, arrived = set(), start, []
    for _ in streams.deliver(df, "event_id", "ts", str(tmp_path / "in")):
        new = set(map(str, Path(tmp_path / "in").glob("*.parquet"))) - seen
        seen |= new
        times = [r.ts for f in new for r in spark.read.parquet(f).collect()]
        assert all(t >= latest - timedelta(minutes=60) for t in times)  # an hour late at most
        latest = max([latest, *times])
        arrived += times
    assert shared._landed.get(spark.sparkContext.applicationId, []) == before  # nothing is stored beside
    counts = {t: arrived.count(t) for _, t in rows}
    assert set(counts.values()) == {1, 2} and len(arrived) == sum(counts.values())


def test_no_deliveries(spark, tmp_path):
    df = spark.createDataFrame([], "event_id string, ts timestamp")
    assert list(streams.deliver(df, "event_id", "ts", str(tmp_path / "in"))) == list(range(streams.STEPS))
    assert spark.read.parquet(str(tmp_path / "in")).count() == 0


def test_a_stream_leaves_no_shuffle_files_and_moves_only_columns_of_the_star(spark, arrive, lines, tmp_path):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).endswith(".data")}

    into = ingest.SalesIngest(spark, str(tmp_path / "star"))
    arrive(row(1, "2024-01-05", "10.00"), row(2, "2024-01-20", "11.00"))
    arrive(row(1, "2024-01-05", "09.00"))
    before = files()
    into.run(lines())
    for _ in range(300):  # they go in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    plan = into.star()["sales"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Customer_Name" not in plan.split("Relation")[0]
    base = into.tables["lines"]
    base.compact()
    assert sorted(base.current(columns=ingest.STAR_LINE).columns) == sorted(ingest.STAR_LINE)


def test_no_line_is_late_and_the_state_goes_when_all_has_arrived(spark, sf_dir):
    # Shares of unequal numbers of files, as large tables have.
    with shared.landing(spark), shared.settings(spark, {"spark.sql.files.maxRecordsPerFile": "200"}):
        star = streams.streamed_star(spark, sf_dir)
        left = [p for p in shared._landed[spark.sparkContext.applicationId] if "/sales_arriving-" in p]
        path = next(p for p in shared._landed[spark.sparkContext.applicationId] if "/streamed_star-" in p)
        assert not left and not Path(path, "checkpoint").exists()
        assert star["sales"].count() == sales_raw(spark, sf_dir).select("Order_ID").distinct().count()
