import pytest

from salescope.operators import clean
from salescope.schema import SALES, SEQ
from salescope.sources.csv import load_sales_csv, save_sales_csv

HEADER = ",".join(SALES.names)
LINE = "ORD-1,2024-01-05,C1,Ann,Toys,Ball,North,3,1.50,0.1,4.05,1.00,Online"


@pytest.fixture
def write(tmp_path):
    def put(name, *lines, header=HEADER):
        (tmp_path / name).write_text("\n".join([header, *lines]) + "\n")
        return str(tmp_path)

    return put


def test_missing_values_are_null(spark, write):
    path = write("a.csv", 'ORD-1,NA,C1,"Ann, B",Toys,Ball,N/A,NA,NaN,null,,n/a,Online')
    row = load_sales_csv(spark, path).first()
    assert row.Customer_Name == "Ann, B"
    assert [row.Order_Date, row.Region, row.Quantity, row.Unit_Price, row.Discount] == [None] * 5
    assert row.Revenue is None and row.Profit is None


def test_columns_are_found_by_name(spark, write):
    path = write("a.csv", "extra," + ",".join(reversed(LINE.split(","))), header="more," + ",".join(reversed(SALES.names)))
    row = load_sales_csv(spark, path).first()
    assert (row.Order_ID, row.Quantity, row.Sales_Channel) == ("ORD-1", 3, "Online")


def test_short_line_is_filled_up_and_long_line_stops_the_query(spark, write):
    path = write("a.csv", "ORD-2,2024-01-05,C2")
    assert load_sales_csv(spark, path).first().Quantity is None
    write("b.csv", LINE + ",more")
    with pytest.raises(Exception, match="too many fields"):
        load_sales_csv(spark, path).count()


def test_nothing_there_and_wrong_columns(spark, write, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_sales_csv(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="lacks the columns Order_ID"):
        load_sales_csv(spark, write("a.csv", "1", header="x"))


def test_input_order_spans_files_and_splits(spark, write):
    line = LINE.removeprefix("ORD-1")
    write("a.csv", *[f"ORD-{i}{line}" for i in range(200)])
    path = write("b.csv", *[f"ORD-{i}{line.replace('Ann', 'Late')}" for i in range(300)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = load_sales_csv(spark, path)
        assert df.rdd.getNumPartitions() > 5
        names = {r.Order_ID: r.Customer_Name for r in clean.dedupe_keep_first(df).collect()}
        order = [r.Order_ID for r in df.orderBy(SEQ).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert order == [f"ORD-{i}" for i in range(200)] + [f"ORD-{i}" for i in range(300)]
    assert [names[f"ORD-{i}"] for i in (0, 199, 200, 299)] == ["Ann", "Ann", "Late", "Late"]


def test_round_trip(spark, sales, tmp_path):
    df = sales({"Region": None, "Customer_Name": 'A "B", C'}, {"Order_ID": "B", "Discount": None})
    save_sales_csv(df, str(tmp_path / "deep" / "out"))
    back = load_sales_csv(spark, str(tmp_path / "deep" / "out"))
    key = SALES.names
    # By value: amounts come back with more decimals, quantities as DOUBLE.
    assert [tuple(r) for r in back.select(key).orderBy("Order_ID").collect()] == [
        tuple(r) for r in df.select(key).orderBy("Order_ID").collect()
    ]


def test_unreadable_number_stops_the_query(spark, write):
    path = write("a.csv", LINE.replace(",3,", ",x,"))
    with pytest.raises(Exception, match="Quantity is no number that fits: x"):
        load_sales_csv(spark, path).collect()


def test_whole_numbers_with_a_point_and_wide_amounts(spark, write):
    path = write(
        "a.csv",
        LINE.replace(",3,1.50,", ",2.0,10.005,"),
        LINE.replace(",3,", ",2.5,").replace("4.05", "12345678901.00").replace("1.00,Online", "29546115.9571,Online"),
    )
    rows = load_sales_csv(spark, path).orderBy(SEQ).collect()
    assert [r.Quantity for r in rows] == [2.0, 2.5]
    assert str(rows[0].Unit_Price) == "10.00500000"
    assert (float(rows[1].Revenue), float(rows[1].Profit)) == (12345678901.0, 29546115.9571)
    cleaned = clean.clean(load_sales_csv(spark, path)).collect()
    assert sorted(float(r.Revenue) for r in cleaned)[-1] in (4.05, 12345678901.0)


def test_quotes_line_breaks_and_spaces_come_back(spark, sales, tmp_path):
    texts = ['  Ann "A"  ', 'a, "b"', "two\nlines", " Online "]
    df = sales(*[{"Order_ID": str(i), "Customer_Name": t} for i, t in enumerate(texts)])
    path = str(tmp_path / "out")
    save_sales_csv(df, path)
    back = load_sales_csv(spark, path, multi_line=True)
    assert {r.Order_ID: r.Customer_Name for r in back.collect()} == dict(zip("0123", texts, strict=True))
    with pytest.raises(Exception, match="a quote is not closed"):
        load_sales_csv(spark, path).collect()


def test_doubled_quotes_are_one_quote(spark, write):
    path = write("a.csv", LINE.replace("Ann", '"Ann ""A"", Jr"'))
    assert load_sales_csv(spark, path).first().Customer_Name == 'Ann "A", Jr'


def test_equal_names_in_two_folders_are_told_apart(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.csv").write_text(f"{HEADER}\n{LINE.replace('Ann', folder)}\n")
    rows = load_sales_csv(spark, f"{tmp_path}/*").orderBy(SEQ).collect()
    assert [r.Customer_Name for r in rows] == ["x", "y"] and rows[0][SEQ].file != rows[1][SEQ].file
