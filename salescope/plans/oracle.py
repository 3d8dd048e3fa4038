"""The same queries as SQL for DuckDB, written independently of the operators.

Each text starts from the given tables. ``with_`` puts the common table expressions
in front that a query needs; amounts stay DECIMAL until the last SELECT.
"""

from __future__ import annotations

from salescope.plans.queries import CATEGORIES, CHANNELS, DATES, REGIONS

_REVENUE = """CAST(CAST(l_quantity AS DECIMAL(9,0)) * CAST(p_retailprice AS DECIMAL(10,2))
        * (CAST(1 AS DECIMAL(5,4)) - CAST(l_discount AS DECIMAL(5,4))) AS DECIMAL(12,2))"""
_PROFIT = f"""CAST({_REVENUE} * CAST(15 + (l_partkey * 31 + l_linenumber * 7) % 31 AS DECIMAL(4,0))
        * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2))"""
_SEQ = "l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"

_LINES = f"""lines AS (
    SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber) % 200 AS slot, {_SEQ},
        'ORD-' || l_orderkey AS Order_ID, CAST(o_orderdate AS DATE) AS Order_Date,
        'CUST-' || o_custkey AS Customer_ID, c_name AS Customer_Name,
        p_type AS Product_Category, p_type || ' ' || p_name AS Product_Name, r_name AS Region,
        CAST(l_quantity AS INTEGER) AS Quantity,
        CAST(p_retailprice AS DECIMAL(10,2)) AS Unit_Price,
        CAST(l_discount AS DECIMAL(5,4)) AS Discount,
        {_REVENUE} AS Revenue, {_PROFIT} AS Profit, o_orderpriority AS Sales_Channel
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN part ON l_partkey = p_partkey)"""

_RAW = """raw AS (
    SELECT * REPLACE (
        'ORD-' || l_orderkey || '-' || l_linenumber AS Order_ID,
        CASE WHEN slot <> 50 THEN Region END AS Region,
        CASE WHEN slot <> 150 THEN Quantity END AS Quantity,
        CASE WHEN slot <> 0 THEN Discount END AS Discount,
        CASE WHEN slot <> 100 THEN Profit END AS Profit)
    FROM lines)"""

_DERIVED = """derived AS (
    SELECT * REPLACE (
        coalesce(Discount, CAST(0 AS DECIMAL(5,4))) AS Discount,
        coalesce(CAST(Profit AS DECIMAL(16,4)),
            CAST(CAST(Revenue AS DECIMAL(16,4)) * CAST(0.30 AS DECIMAL(3,2)) AS DECIMAL(16,4))) AS Profit)
    FROM raw),
medians AS (
    SELECT median(CAST(Quantity AS DOUBLE)) AS mq, median(CAST(Unit_Price AS DOUBLE)) AS mu,
        median(CAST(Revenue AS DOUBLE)) AS mr, median(CAST(Profit AS DOUBLE)) AS mp
    FROM derived),
imputed AS (
    SELECT * EXCLUDE (mq, mu, mr, mp) REPLACE (
        coalesce(CAST(Quantity AS DOUBLE), mq) AS Quantity,
        coalesce(CAST(Unit_Price AS DECIMAL(16,4)), CAST(mu AS DECIMAL(16,4))) AS Unit_Price,
        coalesce(CAST(Revenue AS DECIMAL(16,4)), CAST(mr AS DECIMAL(16,4))) AS Revenue,
        coalesce(Profit, CAST(mp AS DECIMAL(16,4))) AS Profit)
    FROM derived, medians)"""

_CLEAN = f"""filled AS (
    SELECT * REPLACE (coalesce(Region, 'Unknown') AS Region) FROM imputed),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY Order_ID ORDER BY {_SEQ}) AS rank FROM filled),
clean AS (
    SELECT *, CAST(year(Order_Date) AS BIGINT) AS Year, CAST(month(Order_Date) AS BIGINT) AS Month,
        strftime(Order_Date, '%Y-%m') AS YearMonth, CAST(quarter(Order_Date) AS BIGINT) AS Quarter
    FROM ranked WHERE rank = 1)"""


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_SELECTED = f"""selected AS (
    SELECT * FROM clean
    WHERE Order_Date BETWEEN DATE '{DATES[0]}' AND DATE '{DATES[1]}'
        AND Region IN ({_in(REGIONS)}) AND Product_Category IN ({_in(CATEGORIES)})
        AND Sales_Channel IN ({_in(CHANNELS)}))"""

_SEGMENTS = """segments AS (
    SELECT YearMonth, Region, Product_Category, sum(Revenue) AS Revenue, sum(Quantity) AS Quantity,
        CAST(substr(YearMonth, 6, 2) AS BIGINT) AS Month
    FROM clean GROUP BY ALL),
lags AS (
    SELECT * FROM (
        SELECT *, lag(Revenue) OVER w AS Previous_Revenue, lag(Quantity) OVER w AS Previous_Sales
        FROM segments WINDOW w AS (PARTITION BY Region, Product_Category ORDER BY YearMonth))
    WHERE Previous_Revenue IS NOT NULL),
coded AS (
    SELECT *, dense_rank() OVER (ORDER BY Region) - 1 AS region_code,
        dense_rank() OVER (ORDER BY Product_Category) - 1 AS category_code,
        substr(md5(YearMonth || '|' || Region || '|' || Product_Category), 1, 4) < '3333' AS is_test
    FROM lags),
last_month AS (
    SELECT CAST(max(YearMonth) || '-01' AS DATE) AS last FROM clean)"""

_PRODUCT = """named AS (
    SELECT p_type || ' ' || p_name AS product_name, p_type, p_partkey, p_retailprice FROM part)"""

_STAR = """star_products AS (
    SELECT product_name, arg_min(p_type, p_partkey) AS product_category FROM named GROUP BY product_name),
star_customers AS (
    SELECT 'CUST-' || c_custkey AS customer_id, c_name AS customer_name FROM customer),
star_orders AS (
    SELECT 'ORD-' || o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
        'CUST-' || o_custkey AS customer_id, r_name AS region, o_orderpriority AS sales_channel
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey),
star_sales AS (
    SELECT 'ORD-' || l_orderkey AS order_id, product_name, CAST(l_quantity AS INTEGER) AS quantity,
        CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price, CAST(l_discount AS DECIMAL(5,4)) AS discount,
        """ + f"{_REVENUE} AS revenue, {_PROFIT} AS profit" + """
    FROM lineitem JOIN named ON l_partkey = p_partkey)"""

_RAW_PARTS = [_LINES, _RAW]
_CLEAN_PARTS = [*_RAW_PARTS, _DERIVED, _CLEAN]


def with_(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _raw(select: str) -> str:
    return with_(_RAW_PARTS, select)


def _clean(select: str) -> str:
    return with_(_CLEAN_PARTS, select)


def _selected(select: str) -> str:
    return with_([*_CLEAN_PARTS, _SELECTED], select)


def _segments(select: str) -> str:
    return with_([*_CLEAN_PARTS, _SEGMENTS], select)


def _dbl(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


_SALES_COLUMNS = (
    "Order_ID, CAST(Order_Date AS VARCHAR) AS Order_Date, Customer_ID, Customer_Name, Product_Category, "
    "Product_Name, Region, Quantity, CAST(Unit_Price AS DOUBLE) AS Unit_Price, "
    "CAST(Discount AS DOUBLE) AS Discount, CAST(Revenue AS DOUBLE) AS Revenue, "
    "CAST(Profit AS DOUBLE) AS Profit, Sales_Channel"
)
_RAW_COLUMNS = _SALES_COLUMNS.replace("Quantity,", "CAST(Quantity AS BIGINT) AS Quantity,")
_CLEAN_COLUMNS = _SALES_COLUMNS + ", Year, Month, YearMonth, Quarter"

_KPI = """SELECT CAST(coalesce(sum(Revenue), 0) AS DOUBLE) AS total_revenue,
    CAST(coalesce(sum(Profit), 0) AS DOUBLE) AS total_profit,
    count(DISTINCT Order_ID) AS total_orders, count(DISTINCT Customer_ID) AS total_customers,
    coalesce(CAST(sum(Revenue) AS DOUBLE) / nullif(count(DISTINCT Order_ID), 0), 0.0)::DOUBLE AS average_order_value
    FROM {source}"""

_NUMERIC = ["Quantity", "Unit_Price", "Discount", "Revenue", "Profit"]


def _money(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN format('${{:,.2f}}', CAST({x} AS DOUBLE)) END"


def _short(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    return (
        f"CASE WHEN {x} >= 1000000 THEN printf('$%.2fM', {x} / 1000000) "
        f"WHEN {x} >= 1000 THEN printf('$%.1fK', {x} / 1000) ELSE format('${{:,.2f}}', {x}) END"
    )


def _growth(source: str) -> str:
    return f"""SELECT YearMonth, sum(Revenue) AS Revenue,
        (CAST(sum(Revenue) AS DOUBLE) - CAST(lag(sum(Revenue)) OVER (ORDER BY YearMonth) AS DOUBLE))
        / nullif(CAST(lag(sum(Revenue)) OVER (ORDER BY YearMonth) AS DOUBLE), 0) * 100 AS Growth
    FROM {source} GROUP BY YearMonth"""


def _by(keys: str, order: str = "", limit: int | None = None, source: str = "clean", **sums: str) -> str:
    columns = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {name}" for name, c in sums.items())
    text = f"SELECT {keys}, {columns} FROM {source} GROUP BY {keys}"
    return text + (f" ORDER BY {order}" if order else "") + (f" LIMIT {limit}" if limit else "")


def _customers(limit: int | None = None) -> str:
    return """SELECT Customer_ID, CAST(sum(Revenue) AS DOUBLE) AS Total_Revenue,
        count(DISTINCT Order_ID) AS Order_Count,
        CAST(sum(Revenue) AS DOUBLE) / count(Revenue) AS Avg_Order_Value
    FROM clean GROUP BY Customer_ID ORDER BY Total_Revenue DESC, Customer_ID""" + (
        f" LIMIT {limit}" if limit else ""
    )


def _union(texts: list[str]) -> str:
    return "\nUNION ALL ".join(texts)


def _describe() -> str:
    fields = {"Order_Date": "(Order_Date - DATE '1970-01-01')"}
    fields |= {c: c for c in [*_NUMERIC, "Year", "Month", "Quarter"]}
    return _union(
        [
            f"""SELECT '{name}' AS column, count({x}) AS count,
            CAST(sum(CAST({x} AS DECIMAL(20,4))) AS DOUBLE) / count({x}) AS mean,
            {'CAST(NULL AS DOUBLE)' if name == 'Order_Date' else f'round(stddev_samp(CAST({x} AS DOUBLE)), 6)'} AS std,
            CAST(min({x}) AS DOUBLE) AS min, CAST(max({x}) AS DOUBLE) AS max,
            round(quantile_cont(CAST({x} AS DOUBLE), 0.25), 6) AS q25,
            round(quantile_cont(CAST({x} AS DOUBLE), 0.5), 6) AS q50,
            round(quantile_cont(CAST({x} AS DOUBLE), 0.75), 6) AS q75
            FROM clean"""
            for name, x in fields.items()
        ]
    )


def _histogram(column: str) -> str:
    return f"""SELECT CAST(i AS BIGINT) AS bin, round(lo + i * width, 6) AS bin_start,
        round(lo + (i + 1) * width, 6) AS bin_end, coalesce(n, 0) AS count
    FROM range(50) AS r(i)
        CROSS JOIN (SELECT min({column})::DOUBLE AS lo, (max({column})::DOUBLE - min({column})::DOUBLE) / 50 AS width FROM clean)
        LEFT JOIN (
            SELECT least(floor(({column}::DOUBLE - lo) / width), 49) AS bin, count(*) AS n
            FROM clean, (SELECT min({column})::DOUBLE AS lo,
                (max({column})::DOUBLE - min({column})::DOUBLE) / 50 AS width FROM clean)
            GROUP BY 1) AS h ON h.bin = i"""


def _density(column: str) -> str:
    return f"""SELECT CAST(i AS BIGINT) AS point, round(lo + i * (hi - lo) / 199, 4) AS x,
        round(sum(w * exp(-0.5 * ((lo + i * (hi - lo) / 199 - v) / h) ** 2))
            * ((hi - lo) / 50) / (h * sqrt(2 * pi())), 4) AS y
    FROM (SELECT {column}::DOUBLE AS v, count(*) AS w FROM clean GROUP BY 1)
        CROSS JOIN (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi,
            stddev_samp({column}::DOUBLE) * pow(count({column}), -0.2) AS h FROM clean)
        CROSS JOIN range(200) AS r(i)
    GROUP BY i, lo, hi, h"""


def _correlations() -> str:
    return _union(
        [
            f"SELECT '{a}' AS column, '{b}' AS other, "
            + (
                f"CASE WHEN min({a}) < max({a}) THEN 1.0::DOUBLE END"
                if a == b
                else f"round(corr({a}::DOUBLE, {b}::DOUBLE), 8)"
            )
            + " AS correlation FROM clean"
            for a in _NUMERIC
            for b in _NUMERIC
        ]
    )


def _nulls(columns: list[str], source: str) -> str:
    return _union(
        [
            f"SELECT '{c}' AS column, count(*) - count({c}) AS missing_count, "
            f"round((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS missing_pct FROM {source}"
            for c in columns
        ]
    )


_ALL = [
    "Order_ID", "Order_Date", "Customer_ID", "Customer_Name", "Product_Category", "Product_Name",
    "Region", "Quantity", "Unit_Price", "Discount", "Revenue", "Profit", "Sales_Channel",
]
_KINDS = dict.fromkeys(_ALL, "string") | {
    "Order_Date": "date",
    "Quantity": "int",
    "Unit_Price": "decimal(10,2)",
    "Discount": "decimal(5,4)",
    "Revenue": "decimal(12,2)",
    "Profit": "decimal(12,2)",
}

def _spoilt(column: str, at: int) -> str:
    return (
        f"CASE l_linenumber WHEN {at} THEN NULL WHEN {at + 1} THEN repeat({column}, 30) ELSE {column} END"
    )


_BROKEN = f"""b_customers AS (
    SELECT {_spoilt('Customer_ID', 5)} AS customer_id, {_spoilt('Customer_Name', 1)} AS customer_name FROM raw),
b_products AS (
    SELECT {_spoilt('Product_Name', 1)} AS product_name, {_spoilt('Product_Category', 3)} AS product_category,
        l_linenumber AS product_id FROM raw),
b_orders AS (
    SELECT {_spoilt('Order_ID', 1)} AS order_id, CASE WHEN l_linenumber <> 3 THEN Order_Date END AS order_date,
        {_spoilt('Customer_ID', 3)} AS customer_id, {_spoilt('Region', 5)} AS region,
        {_spoilt('Sales_Channel', 4)} AS sales_channel FROM raw
    UNION ALL
    SELECT Order_ID, Order_Date, Customer_ID, Region, Sales_Channel FROM raw WHERE l_linenumber = 3),
b_sales AS (
    SELECT {_spoilt('Order_ID', 2)} AS order_id, {_spoilt('Product_Name', 5)} AS product_name,
        CASE l_linenumber WHEN 1 THEN -Quantity WHEN 2 THEN Quantity::BIGINT * 1000000000 ELSE Quantity END AS quantity,
        CASE l_linenumber WHEN 1 THEN -Unit_Price WHEN 2 THEN Unit_Price::DECIMAL(20,2) * 100000000
            WHEN 3 THEN NULL ELSE Unit_Price END AS unit_price,
        CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 12 ELSE Discount::DECIMAL(10,4) END AS discount,
        CASE l_linenumber WHEN 5 THEN NULL WHEN 3 THEN Revenue::DECIMAL(25,2) * 1000000000 ELSE Revenue END AS revenue,
        CASE l_linenumber WHEN 4 THEN Profit::DECIMAL(25,2) * 1000000000 ELSE Profit END AS profit,
        l_linenumber AS sale_id FROM raw)"""


def _violations() -> str:
    texts = {
        "customers": {"customer_id": 20, "customer_name": 100},
        "products": {"product_name": 100, "product_category": 50},
        "orders": {"order_id": 20, "customer_id": 20, "region": 50, "sales_channel": 50},
        "sales": {"order_id": 20, "product_name": 100},
    }
    types = {
        "quantity": "int",
        "unit_price": "decimal(10,2)",
        "discount": "decimal(5,4)",
        "revenue": "decimal(12,2)",
        "profit": "decimal(12,2)",
    }

    def rule(table: str, name: str, test: str) -> str:
        return f"SELECT '{table}' AS table, '{name}' AS rule, count(*) FILTER (WHERE {test}) AS violations FROM b_{table}"

    def unique(table: str, key: str) -> str:
        return f"SELECT '{table}', 'unique {key}', count({key}) - count(DISTINCT {key}) FROM b_{table}"

    def reference(table: str, key: str, target: str) -> str:
        known = f"SELECT {key} FROM b_{target} WHERE {key} IS NOT NULL"
        return rule(table, f"references {target} {key}", f"{key} IS NOT NULL AND {key} NOT IN ({known})")

    found = []
    for table, lengths in texts.items():
        required = [*lengths, *({"orders": ["order_date"], "sales": types}.get(table, []))]
        found += [rule(table, f"not null {c}", f"{c} IS NULL") for c in required]
        found += [rule(table, f"length {c} <= {n}", f"length({c}) > {n}") for c, n in lengths.items()]
    found += [
        rule("sales", f"type {c} {kind}", f"{c} IS NOT NULL AND TRY_CAST({c} AS {kind}) IS NULL")
        for c, kind in types.items()
    ]
    found += [
        rule("sales", "check quantity > 0", "TRY_CAST(quantity AS INT) <= 0"),
        rule("sales", "check unit_price >= 0", "TRY_CAST(unit_price AS DECIMAL(10,2)) < 0"),
        rule("sales", "check discount in [0, 1]", "TRY_CAST(discount AS DECIMAL(5,4)) NOT BETWEEN 0 AND 1"),
        unique("customers", "customer_id"),
        unique("products", "product_name"),
        unique("products", "product_id"),
        unique("orders", "order_id"),
        unique("sales", "sale_id"),
        reference("orders", "customer_id", "customers"),
        reference("sales", "order_id", "orders"),
        reference("sales", "product_name", "products"),
    ]
    return _union(found)


_FIRST_PRODUCT = f"""first_products AS (
    SELECT product_name, product_category FROM (
        SELECT Product_Name AS product_name, Product_Category AS product_category,
            row_number() OVER (PARTITION BY Product_Name ORDER BY {_SEQ}, Order_ID) AS rank FROM lines)
    WHERE rank = 1)"""
_FIRST_ORDER = f"""first_orders AS (
    SELECT * FROM (
        SELECT Order_ID AS order_id, CAST(Order_Date AS VARCHAR) AS order_date, Customer_ID AS customer_id,
            Region AS region, Sales_Channel AS sales_channel,
            row_number() OVER (PARTITION BY Order_ID ORDER BY {_SEQ}) AS rank FROM lines)
    WHERE rank = 1)"""


def _ids(key: str) -> str:
    return f"row_number() OVER (ORDER BY substr(md5({key}), 1, 4), {key})"


# --- least squares ---------------------------------------------------------

_X = ["Month", "Region", "Product_Category", "Previous_Revenue", "Previous_Sales"]


def _ols() -> list[str]:
    """CTEs ending in ``fit``: one row with the coefficients c1..c5 and the intercept c0.

    Solves the correlation form of the normal equations by elimination, one CTE per
    eliminated column.
    """
    k = len(_X)
    source = """x AS (
    SELECT CAST(Month AS DOUBLE) AS x1, CAST(region_code AS DOUBLE) AS x2, CAST(category_code AS DOUBLE) AS x3,
        CAST(Previous_Revenue AS DOUBLE) AS x4, CAST(Previous_Sales AS DOUBLE) AS x5,
        CAST(Revenue AS DOUBLE) AS x6
    FROM coded WHERE NOT is_test)"""
    cells = [
        f"{'1.0' if i == j else f'corr(x{i}, x{j})'} AS a{i}{j}"
        for i in range(1, k + 1)
        for j in range(1, k + 2)
    ]
    moments = [f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(1, k + 2)]
    steps = [source, f"e0 AS (SELECT {', '.join(cells + moments)} FROM x)"]
    for p in range(1, k + 1):
        changed = []
        for i in range(1, k + 1):
            for j in range(1, k + 2):
                scaled = f"a{p}{j} / a{p}{p}"
                changed.append(f"{scaled if i == p else f'a{i}{j} - a{i}{p} * {scaled}'} AS a{i}{j}")
        steps.append(f"e{p} AS (SELECT * REPLACE ({', '.join(changed)}) FROM e{p - 1})")
    slopes = [f"a{i}{k + 1} * s{k + 1} / s{i} AS c{i}" for i in range(1, k + 1)]
    steps.append(f"slopes AS (SELECT *, {', '.join(slopes)} FROM e{k})")
    level = " - ".join([f"m{k + 1}", *[f"c{i} * m{i}" for i in range(1, k + 1)]])
    steps.append(f"fit AS (SELECT *, {level} AS c0 FROM slopes)")
    return steps


def _linear_forecast(seeds: str, periods: int) -> list[str]:
    """CTEs ending in ``steps``: the recursive forecast of the least-squares model."""
    predict = (
        "greatest(c0 + c1 * month(last + to_months(CAST({step} AS INTEGER))) + c2 * region_code "
        "+ c3 * category_code + c4 * {revenue} + c5 * {sales}, 0.0)"
    )
    first = predict.format(step="1", revenue="Previous_Revenue::DOUBLE", sales="Previous_Sales::DOUBLE")
    later = predict.format(step="(step + 1)", revenue="predicted", sales="sales")
    return [
        seeds,
        f"""steps AS (
    SELECT Region, Product_Category, region_code, category_code, 1 AS step,
        {first} AS predicted, Previous_Sales::DOUBLE * 0.95::DOUBLE AS sales
    FROM seeds, fit, last_month
    UNION ALL
    SELECT Region, Product_Category, region_code, category_code, step + 1,
        {later}, sales * 0.95::DOUBLE
    FROM steps, fit, last_month WHERE step < {periods})""",
    ]


_LAST_SEED = """seeds AS (
    SELECT * FROM coded ORDER BY Region DESC, Product_Category DESC, YearMonth DESC LIMIT 1)"""
_ALL_SEEDS = """seeds AS (
    SELECT * FROM coded
    QUALIFY row_number() OVER (PARTITION BY Region, Product_Category ORDER BY YearMonth DESC) = 1)"""


def _forecast(seeds: str, periods: int, columns: str) -> str:
    parts = [*_CLEAN_PARTS, _SEGMENTS, *_ols(), *_linear_forecast(seeds, periods)]
    return with_(parts, f"""SELECT {columns}
        strftime(last + to_months(CAST(step AS INTEGER)), '%Y-%m') AS YearMonth,
        round(round(predicted, 2), 1) AS Predicted_Revenue FROM steps, last_month""").replace(
        "WITH ", "WITH RECURSIVE ", 1
    )


_FITTED = (
    "(c0 + c1 * Month + c2 * region_code + c3 * category_code + c4 * Previous_Revenue::DOUBLE + c5 * Previous_Sales::DOUBLE)"
)


def _linear_metrics() -> str:
    """Error measures of the least-squares model on the test part."""
    error = f"(Revenue::DOUBLE - {_FITTED})"
    return f"""SELECT round(sqrt(avg({error} ** 2)), 2) AS linear_rmse, round(avg(abs({error})), 2) AS linear_mae,
        round(1 - sum({error} ** 2) / sum((Revenue::DOUBLE - mean) ** 2), 6) AS linear_r2
    FROM (SELECT * FROM coded WHERE is_test), fit, (SELECT avg(Revenue::DOUBLE) AS mean FROM coded WHERE is_test)"""


def _forecast_series() -> str:
    """Monthly revenue, then the forecast of the least-squares model."""
    parts = [*_CLEAN_PARTS, _SEGMENTS, *_ols(), *_linear_forecast(_LAST_SEED, 6)]
    return with_(parts, """SELECT YearMonth, round(CAST(sum(Revenue) AS DOUBLE), 1) AS Revenue, 'history' AS kind
        FROM clean GROUP BY YearMonth
    UNION ALL
    SELECT strftime(last + to_months(CAST(step AS INTEGER)), '%Y-%m'), round(round(predicted, 2), 1), 'forecast'
        FROM steps, last_month""").replace("WITH ", "WITH RECURSIVE ", 1)


def _naive_metrics() -> str:
    def rate(prefix: str, prediction: str) -> str:
        error = f"(Revenue::DOUBLE - {prediction})"
        return f"""sqrt(avg({error} ** 2)) AS {prefix}_rmse, avg(abs({error})) AS {prefix}_mae,
        1 - sum({error} ** 2) / sum((Revenue::DOUBLE - mean) ** 2) AS {prefix}_r2"""

    return f"""SELECT {rate('linear', 'Previous_Revenue::DOUBLE')},
        {rate('rf', '(Previous_Sales * 900)::DOUBLE')}
    FROM lags, (SELECT avg(Revenue::DOUBLE) AS mean FROM lags)"""


_SUMMARY = """SELECT region, product_category, CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR) AS month,
    CAST(sum(revenue) AS DOUBLE) AS total_revenue, CAST(sum(profit) AS DOUBLE) AS total_profit,
    count(DISTINCT order_id) AS order_count
FROM star_sales JOIN star_orders USING (order_id) JOIN star_products USING (product_name)
GROUP BY 1, 2, 3"""
_SUMMARY_VIEW = f"""SELECT order_id, CAST(order_date AS VARCHAR) AS order_date, customer_id, customer_name,
    product_category, product_name, region, CAST(quantity AS BIGINT) AS quantity,
    {_dbl('unit_price', 'discount', 'revenue', 'profit')}, sales_channel
FROM star_sales JOIN star_orders USING (order_id) JOIN star_customers USING (customer_id)
    JOIN star_products USING (product_name)"""


_STREAMED = """SELECT Order_ID AS order_id, CAST(Order_Date AS VARCHAR) AS order_date, Customer_ID AS customer_id,
    Customer_Name AS customer_name, Product_Category AS product_category, Product_Name AS product_name, Region AS region,
    CAST(trunc(Quantity) AS BIGINT) AS quantity, CAST(CAST(Unit_Price AS DECIMAL(10,2)) AS DOUBLE) AS unit_price,
    CAST(Discount AS DOUBLE) AS discount, CAST(CAST(Revenue AS DECIMAL(12,2)) AS DOUBLE) AS revenue,
    CAST(CAST(Profit AS DECIMAL(12,2)) AS DOUBLE) AS profit, Sales_Channel AS sales_channel
FROM clean"""

_EVENT_WINDOWS = """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, strftime(w + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M') AS window_end,
    event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM (SELECT DISTINCT event_id, ts, event_type, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM events)
WHERE w + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 3 HOUR FROM events)
GROUP BY w, event_type"""

_RATES = """rates AS (
    SELECT region AS Region, order_date AS rate_date, CAST(0.5 + sum(c_custkey) % 10000 * 0.0001 AS DECIMAL(9,4)) AS rate
    FROM star_orders JOIN customer ON customer_id = 'CUST-' || c_custkey WHERE c_custkey % 10 = 0 GROUP BY ALL)"""

_PROMOTIONS = """promotions AS (
    SELECT l_partkey AS part, l_orderkey AS promotion, CAST(l_shipdate AS DATE) AS valid_from,
        CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) + CAST(
            CASE l_orderkey % 10 WHEN 0 THEN 700 WHEN 1 THEN 0 ELSE l_quantity END AS INTEGER) END AS valid_to
    FROM lineitem WHERE l_linenumber = 1)"""


def _rates_asof(matched: str) -> str:
    """Sales and the rate that ``matched``, a join, finds for them."""
    select = (
        "SELECT Order_ID, c.Region, CAST(Order_Date AS VARCHAR) AS Order_Date, CAST(r.rate_date AS VARCHAR) AS rate_date, "
        f"CAST(r.rate AS DOUBLE) AS rate, CAST(Revenue * r.rate AS DOUBLE) AS Converted FROM clean AS c {matched}"
    )
    return with_([*_CLEAN_PARTS, _PRODUCT, _STAR, _RATES], select)


def _cube(grouping: str, dims: str) -> str:
    return with_(
        [_LINES, "dated AS (SELECT *, strftime(Order_Date, '%Y-%m') AS YearMonth FROM lines)"],
        f"""SELECT GROUPING({dims}) AS level, {dims}, CAST(sum(Revenue) AS DOUBLE) AS total_revenue,
            CAST(sum(Profit) AS DOUBLE) AS total_profit, count(DISTINCT Order_ID) AS total_orders,
            count(DISTINCT Customer_ID) AS total_customers,
            round(CAST(sum(Revenue) AS DOUBLE) / count(DISTINCT Order_ID), 6) AS average_order_value
        FROM dated GROUP BY {grouping}({dims})""",
    )


def _frames(keys: str) -> str:
    """Frames by comparing months with months, without windows."""
    own, same = (f", {keys}", f"AND b.{keys} = a.{keys}") if keys else ("", "")

    def back(expression: str, first: int, last: int = 0) -> str:
        return f"(SELECT {expression} FROM months AS b WHERE b.m BETWEEN a.m - {first} AND a.m - {last} {same})"

    select = f"""SELECT YearMonth{own}, CAST(v AS DOUBLE) AS Revenue, CAST({back('sum(v)', 2)} AS DOUBLE) AS trailing_3,
        {back('count(*)', 2)} AS present_3, CAST({back('sum(v)', 11)} AS DOUBLE) AS trailing_12, {back('count(*)', 11)} AS present_12,
        CAST((SELECT sum(v) FROM months AS b WHERE b.m // 12 = a.m // 12 AND b.m <= a.m {same}) AS DOUBLE) AS year_to_date,
        CAST({back('sum(v)', 1, 1)} AS DOUBLE) AS month_ago, CAST({back('sum(v)', 12, 12)} AS DOUBLE) AS year_ago,
        round(100 * (v - {back('CAST(sum(v) AS DOUBLE)', 12, 12)}) / nullif({back('CAST(sum(v) AS DOUBLE)', 12, 12)}, 0), 6) AS year_change_pct
    FROM months AS a"""
    months = f"months AS (SELECT YearMonth{own}, sum(Revenue) AS v, any_value(Year) * 12 + any_value(Month) - 1 AS m FROM clean GROUP BY ALL)"
    return with_([*_CLEAN_PARTS, months], select)


_RANKS = """SELECT YearMonth, Product_Name, CAST(v AS DOUBLE) AS Revenue, rank() OVER best AS rank, dense_rank() OVER best AS dense_rank,
    round(percent_rank() OVER best, 8) AS percent_rank, ntile(4) OVER named AS tile, round(100 * CAST(v AS DOUBLE) / sum(v) OVER month, 6) AS share_pct,
    round(100 * CAST(sum(v) OVER (named ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(v) OVER month, 6) AS running_share_pct,
    CAST(max(v) OVER month - v AS DOUBLE) AS behind_best
FROM (SELECT YearMonth, Product_Name, sum(Revenue) AS v FROM clean GROUP BY ALL)
WINDOW month AS (PARTITION BY YearMonth), best AS (PARTITION BY YearMonth ORDER BY v DESC),
    named AS (PARTITION BY YearMonth ORDER BY v DESC, Product_Name)"""


_SOME = f"YearMonth BETWEEN '1996-03' AND '1999-06' AND Product_Category IN ({_in(CATEGORIES)})"


def _counted(where: str, by: str) -> list[str]:
    """CTEs ending in ``distinct_estimates``, from the rows themselves."""
    own = f"{by}, " if by else ""
    return [
        f"""hashed AS (SELECT {own}"column", md5(v) AS h FROM (
            SELECT {own}unnest(['Customer_ID', 'Product_Name', 'Order_ID']) AS "column", unnest([Customer_ID, Product_Name, Order_ID]) AS v
            FROM clean WHERE {where}))""",
        f"""registers AS (SELECT {own}"column", substr(h, 1, 3) AS register,
            max(CASE WHEN run = 0 THEN 53 ELSE 53 - length(bin(run)) END) AS zeros
            FROM (SELECT *, CAST('0x' || substr(h, 4, 13) AS BIGINT) AS run FROM hashed) GROUP BY ALL)""",
        f"""distinct_estimates AS (SELECT {own}"column",
                CASE WHEN raw <= 10240 AND n < 4096 THEN 4096 * ln(4096.0::DOUBLE / (4096 - n)) ELSE raw END AS estimate
            FROM (SELECT {own}"column", count(*) AS n,
                    0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / (sum(pow(2.0::DOUBLE, -zeros)) + 4096 - count(*)) AS raw
                FROM registers GROUP BY ALL))""",
    ]


def _bucketed(where: str, by: str, probs: str) -> list[str]:
    """CTEs ending in ``quantile_estimates``, from the rows themselves."""
    own = f"{by}, " if by else ""
    return [
        f"""amounts AS (SELECT {own}unnest(['Revenue', 'Profit']) AS "column", CAST(unnest([Revenue, Profit]) * 10000 AS BIGINT) AS a
            FROM clean WHERE {where})""",
        f"""bucketed AS (SELECT {own}"column", CASE WHEN a < 0 THEN -1 ELSE 1 END AS sign, greatest(length(bin(abs(a))) - 8, 0) AS k,
                abs(a) >> greatest(length(bin(abs(a))) - 8, 0) AS top, count(*) AS n FROM amounts GROUP BY ALL)""",
        f"""placed AS (SELECT *, sum(n) OVER (w ORDER BY sign * (128 * k + top)) AS upto, sum(n) OVER w AS total
            FROM bucketed WINDOW w AS (PARTITION BY {own}"column"))""",
        f"""quantile_estimates AS (SELECT {own}"column", prob,
                sign * (top * pow(2.0::DOUBLE, k) + (pow(2.0::DOUBLE, k) - 1) / 2) / 10000 AS estimate
            FROM placed, (SELECT unnest({probs}) AS prob)
            WHERE upto - n < greatest(ceil(prob * total), 1) AND greatest(ceil(prob * total), 1) <= upto)""",
    ]


def _sketched() -> str:
    parts = [*_CLEAN_PARTS, *_counted(_SOME, "Region"), *_bucketed(_SOME, "Region", "[0.1::DOUBLE, 0.5, 0.9, 0.99]")]
    return with_(
        parts,
        'SELECT Region, "column", round(estimate, 6) AS estimate, CAST(NULL AS DOUBLE) AS prob FROM distinct_estimates '
        'UNION ALL SELECT Region, "column", round(estimate, 6), prob FROM quantile_estimates',
    )


def _sketch_errors() -> str:
    parts = [*_CLEAN_PARTS, *_counted("true", ""), *_bucketed("true", "", "[0.1::DOUBLE, 0.5, 0.9]")]
    exact = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS DOUBLE) AS exact FROM clean"
        for c in ("Customer_ID", "Product_Name", "Order_ID")
    )
    cuts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS prob, quantile_cont({c}::DOUBLE, {p}) AS exact FROM clean"
        for c in ("Revenue", "Profit")
        for p in (0.1, 0.5, 0.9)
    )
    return with_(
        parts,
        f"""SELECT "column", round(estimate, 6) AS estimate, round(exact, 6) AS exact, CAST(NULL AS DOUBLE) AS prob, true AS within
        FROM distinct_estimates JOIN ({exact}) USING ("column")
        UNION ALL SELECT "column", round(estimate, 6), round(exact, 6), prob, true
        FROM quantile_estimates JOIN ({cuts}) USING ("column", prob)""",
    )


_MONTHS = """months AS (
    SELECT Region, Product_Category, YearMonth, any_value(Year) * 12 + any_value(Month) - 1 AS m, CAST(sum(Revenue) AS DOUBLE) AS v
    FROM clean GROUP BY ALL)"""

_ANOMALIES = """SELECT Region, Product_Category, YearMonth, v AS Revenue, round(t2, 6) + 0.0 AS trend, round(s2, 6) + 0.0 AS season, round(v - t2 - s2, 6) + 0.0 AS rest,
    round(off / nullif(1.4826 * mad, 0), 6) + 0.0 AS score, coalesce(abs(off / nullif(1.4826 * mad, 0)) > 3.5, false) AS stands_out
FROM (SELECT *, median(abs(off)) OVER (PARTITION BY Region, Product_Category) AS mad FROM (
    SELECT *, v - t2 - s2 - median(v - t2 - s2) OVER (PARTITION BY Region, Product_Category) AS off FROM (
        SELECT *, median(v - t2) OVER (PARTITION BY Region, Product_Category, m % 12) AS s2 FROM (
            SELECT *, median(v - s1) OVER near AS t2 FROM (
                SELECT *, median(v - t1) OVER (PARTITION BY Region, Product_Category, m % 12) AS s1 FROM (
                    SELECT *, median(v) OVER near AS t1 FROM months
                    WINDOW near AS (PARTITION BY Region, Product_Category ORDER BY m RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING)))
            WINDOW near AS (PARTITION BY Region, Product_Category ORDER BY m RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING)))))"""


def _smoothing(without: int) -> list[str]:
    """CTEs ending in ``fitted``: the smoothing of all months but the last ones, as a recursion per month."""
    return [
        _MONTHS,
        """dense AS MATERIALIZED (
            SELECT Region, Product_Category, m - low AS i, coalesce(v, 0.0::DOUBLE) AS x, high - low + 1 AS n
            FROM (SELECT Region, Product_Category, low, high, unnest(range(low, high + 1)) AS m
                FROM (SELECT DISTINCT Region, Product_Category FROM months), (SELECT min(m) AS low, max(m) AS high FROM months))
                LEFT JOIN months USING (Region, Product_Category, m))""",
        """firsts AS (
            SELECT Region, Product_Category, list(x ORDER BY i) AS f, sum(x ORDER BY i) / 12 AS level FROM dense WHERE i < 12 GROUP BY ALL)""",
        f"""fold AS (
            SELECT Region, Product_Category, a, b, c, nth, 0::BIGINT AS i, level, 0.0::DOUBLE AS trend,
                list_transform(f, lambda x: x - level) AS season, 0.0::DOUBLE AS error
            FROM firsts, (SELECT a, b, c, row_number() OVER (ORDER BY a, b, c) AS nth
                FROM (SELECT unnest([0.1::DOUBLE, 0.3, 0.6]) AS a), (SELECT unnest([0.0::DOUBLE, 0.1]) AS b),
                    (SELECT unnest([0.1::DOUBLE, 0.4]) AS c))
            UNION ALL
            SELECT Region, Product_Category, a, b, c, nth, i + 1, l, b * (l - level) + (1 - b) * trend,
                list_append(season[2:], c * (x - l) + (1 - c) * season[1]),
                error + CASE WHEN i < 12 THEN 0 ELSE pow(x - level - trend - season[1], 2) END
            FROM (SELECT fold.*, x, a * (x - season[1]) + (1 - a) * (level + trend) AS l
                FROM fold JOIN dense USING (Region, Product_Category, i) WHERE i < n - {without}))""",
        f"""fitted AS (
            SELECT * FROM fold WHERE i = (SELECT max(n) - {without} FROM dense)
            QUALIFY row_number() OVER (PARTITION BY Region, Product_Category ORDER BY error, nth) = 1)""",
    ]


def _recursive(parts: list[str], select: str) -> str:
    return with_(parts, select).replace("WITH ", "WITH RECURSIVE ", 1)


def _seasonal_forecast() -> str:
    return _recursive(
        [*_CLEAN_PARTS, *_smoothing(0)],
        """SELECT Region, Product_Category, CAST(h AS BIGINT) AS step,
            strftime(make_date(CAST((last + h) // 12 AS INT), CAST((last + h) % 12 + 1 AS INT), 1), '%Y-%m') AS YearMonth,
            round(level + h * trend + season[(h - 1) % 12 + 1], 2) AS forecast, a, b, c
        FROM fitted, range(1, 13) AS r(h), (SELECT max(m) AS last FROM months)""",
    )


def _seasonal_holdout() -> str:
    return _recursive(
        [*_CLEAN_PARTS, *_smoothing(6)],
        """SELECT model, count(*) AS n, round(sqrt(avg(off * off)), 2) AS rmse, round(avg(abs(off)), 2) AS mae FROM (
            SELECT unnest(['smoothing', 'year_before']) AS model,
                unnest([level + h * trend + season[(h - 1) % 12 + 1] - now.x, old.x - now.x]) AS off
            FROM (SELECT f.*, h FROM fitted AS f, range(1, 7) AS r(h)) AS fitted
                JOIN dense AS now ON now.Region = fitted.Region AND now.Product_Category = fitted.Product_Category AND now.i = now.n - 7 + h
                JOIN dense AS old ON old.Region = fitted.Region AND old.Product_Category = fitted.Product_Category AND old.i = now.i - 12)
        GROUP BY model""",
    )


def _density_binned(column: str) -> str:
    return f"""SELECT * FROM (WITH curve AS (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi,
        stddev_samp({column}::DOUBLE) * pow(count({column}), -0.2) AS h FROM clean),
    cells AS (SELECT floor(pos) AS k, count(*) AS n, sum(pos - floor(pos)) AS r
        FROM (SELECT ({column}::DOUBLE - lo) * 16 / h AS pos FROM clean, curve) GROUP BY 1),
    ends AS (SELECT k, sum(w) AS w FROM (SELECT k, n - r AS w FROM cells UNION ALL SELECT k + 1, r FROM cells) GROUP BY k)
    SELECT CAST(i AS BIGINT) AS point, round(lo + i * (hi - lo) / 199, 4) AS x,
        round(sum(w * exp(-0.5 * ((lo + i * (hi - lo) / 199 - lo - k * h / 16) / h) ** 2)) * ((hi - lo) / 50) / (h * sqrt(2 * pi())), 4) AS y
    FROM ends, curve, range(200) AS r(i) GROUP BY i, lo, hi, h)"""


_PLANTED = """mine AS (SELECT Order_ID, Product_Name, Region, Quantity, Revenue, l_suppkey, l_orderkey % 211 AS slot FROM lines),
changed AS (
    SELECT Order_ID, Product_Name, CASE WHEN slot <> 3 THEN Region END AS Region, Quantity,
        CAST(Revenue + CASE WHEN slot = 2 THEN 0.01 ELSE 0 END AS DECIMAL(12,2)) AS Revenue, l_suppkey, slot
    FROM mine WHERE slot <> 1),
doubled AS (SELECT * EXCLUDE (slot) FROM changed UNION ALL SELECT * EXCLUDE (slot) FROM changed WHERE slot = 4),
off AS (
    SELECT * EXCLUDE (side), sum(side) AS copies
    FROM (SELECT * EXCLUDE (slot), 1 AS side FROM mine UNION ALL SELECT *, -1 FROM doubled) GROUP BY ALL HAVING sum(side) <> 0)"""

_STUMP = """steps AS (
    SELECT YearMonth, Region, Product_Category, CAST(Revenue AS DOUBLE) AS y,
        [Month, region_code, category_code, least(200, trunc(Previous_Revenue / 50000)), least(200, trunc(Previous_Sales / 40))]::DOUBLE[] AS x
    FROM coded),
sums AS (
    SELECT f, x[f] AS v, sum(count(*)) OVER w AS n, sum(sum(y)) OVER w AS s, sum(count(*)) OVER (PARTITION BY f) AS total, sum(sum(y)) OVER (PARTITION BY f) AS whole
    FROM steps, range(1, 6) AS r(f) GROUP BY f, x[f] WINDOW w AS (PARTITION BY f ORDER BY x[f])),
best AS (SELECT *, s / n AS low, (whole - s) / (total - n) AS high FROM sums WHERE n < total ORDER BY s * s / n + (whole - s) * (whole - s) / (total - n) DESC, f LIMIT 1)"""


def oracle() -> dict[str, str]:
    segment_keys = "YearMonth, Region, Product_Category"
    star = [_PRODUCT, _STAR]
    ambiguous = [_PRODUCT.replace("p_type || ' ' || p_name", "p_name"), _STAR]
    customers = "SELECT DISTINCT Customer_ID AS customer_id, Customer_Name AS customer_name FROM lines"
    sales_lines = f"""SELECT Order_ID AS order_id, Product_Name AS product_name,
        CAST(Quantity AS BIGINT) AS quantity, CAST(Unit_Price AS DOUBLE) AS unit_price,
        CAST(Discount AS DOUBLE) AS discount, CAST(Revenue AS DOUBLE) AS revenue,
        CAST(Profit AS DOUBLE) AS profit FROM lines"""
    tiers = """customers AS (
        SELECT Customer_ID, sum(Revenue) AS Revenue FROM selected GROUP BY 1),
    cuts AS (SELECT quantile_cont(Revenue::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM customers)"""
    segment_table = f"{_dbl('Revenue')}, Quantity, Month"
    lag_table = segment_table + ", CAST(Previous_Revenue AS DOUBLE) AS Previous_Revenue, Previous_Sales"
    return {
        # files
        "load_sales_csv": _raw(f"SELECT {_RAW_COLUMNS.replace('BIGINT', 'DOUBLE')} FROM raw"),
        "csv_round_trip": _clean(f"SELECT {_SALES_COLUMNS} FROM clean"),
        "save_sales_csv": _clean(
            "SELECT Order_ID, CAST(Order_Date AS VARCHAR) AS Order_Date, Customer_ID, Customer_Name, "
            "Product_Category, Product_Name, Region, "
            + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _NUMERIC)
            + ", Sales_Channel FROM clean"
        ),
        "read_summary_sql": with_(star, _SUMMARY),
        # cleaning
        "fill_discount": _raw(
            "SELECT Order_ID, CAST(Revenue AS DOUBLE) AS Revenue, coalesce(CAST(Discount AS DOUBLE), 0.0) AS Discount FROM raw"
        ),
        "derive_profit": with_(
            [*_RAW_PARTS, _DERIVED], f"SELECT Order_ID, {_dbl('Revenue', 'Profit')} FROM derived"
        ),
        "impute_median": with_(
            [*_RAW_PARTS, _DERIVED],
            f"SELECT Order_ID, Quantity, {_dbl('Unit_Price', 'Discount', 'Revenue', 'Profit')} FROM imputed",
        ),
        "fill_unknown": _raw(
            "SELECT Order_ID, CAST(Order_Date AS VARCHAR) AS Order_Date, Product_Name, "
            "coalesce(Region, 'Unknown') AS Region, Sales_Channel FROM raw"
        ),
        "dedupe_keep_first": _raw(
            f"""SELECT {_RAW_COLUMNS} FROM raw
            QUALIFY row_number() OVER (PARTITION BY Order_ID ORDER BY {_SEQ}) = 1"""
        ),
        "coerce_dates": _raw("SELECT Order_ID, CAST(Order_Date AS VARCHAR) AS Order_Date FROM raw"),
        "coerce_timestamps": _raw("SELECT Order_ID, CAST(Order_Date AS VARCHAR) AS Order_Date FROM raw"),
        "date_parts": _raw(
            "SELECT Order_ID, CAST(Order_Date AS VARCHAR) AS Order_Date, CAST(year(Order_Date) AS BIGINT) AS Year, "
            "CAST(month(Order_Date) AS BIGINT) AS Month, strftime(Order_Date, '%Y-%m') AS YearMonth, "
            "CAST(quarter(Order_Date) AS BIGINT) AS Quarter FROM raw"
        ),
        "preprocess": _clean(f"SELECT {_CLEAN_COLUMNS} FROM clean"),
        "preprocess_kpis": _clean(_KPI.format(source="clean")),
        "line_revenue": with_(
            [_LINES],
            f"SELECT Order_ID, CAST(Quantity AS BIGINT) AS Quantity, {_dbl('Unit_Price', 'Discount', 'Revenue')} FROM lines",
        ),
        "line_profit": with_(
            [_LINES],
            "SELECT Order_ID, CAST(Revenue AS DOUBLE) AS Revenue, "
            "CAST(CAST(Revenue * CAST(0.3 AS DECIMAL(5,4)) AS DECIMAL(12,2)) AS DOUBLE) AS Profit FROM lines",
        ),
        # filters
        "filter_date_range": _clean(
            "SELECT Order_ID, CAST(Order_Date AS VARCHAR) AS Order_Date, CAST(Revenue AS DOUBLE) AS Revenue "
            f"FROM clean WHERE Order_Date BETWEEN DATE '{DATES[0]}' AND DATE '{DATES[1]}'"
        ),
        "filter_region": _clean(
            f"SELECT Order_ID, Region, {_dbl('Revenue')} FROM clean WHERE Region IN ({_in(REGIONS)})"
        ),
        "filter_category": _clean(
            f"SELECT Order_ID, Product_Category, {_dbl('Revenue')} FROM clean "
            f"WHERE Product_Category IN ({_in(CATEGORIES)})"
        ),
        "filter_channel": _clean(
            f"SELECT Order_ID, Sales_Channel, {_dbl('Revenue')} FROM clean WHERE Sales_Channel IN ({_in(CHANNELS)})"
        ),
        "filter_combined": _selected(f"SELECT {_SALES_COLUMNS} FROM selected"),
        "date_bounds": _clean(
            "SELECT CAST(min(Order_Date) AS VARCHAR) AS min_date, CAST(max(Order_Date) AS VARCHAR) AS max_date FROM clean"
        ),
        "filter_options": _clean(
            _union(
                [
                    f"SELECT DISTINCT '{c}' AS dimension, {c} AS value FROM clean"
                    for c in ("Region", "Product_Category", "Sales_Channel")
                ]
            )
        ),
        "is_empty": _selected("SELECT count(*) = 0 AS is_empty FROM selected"),
        "select_rename": _clean(
            'SELECT YearMonth AS Month, CAST(Revenue AS DOUBLE) AS "Revenue ($)", Order_ID AS "Order" FROM clean'
        ),
        "drop_null_subset": _raw(
            "SELECT Order_ID, Region, CAST(Quantity AS BIGINT) AS Quantity FROM raw "
            "WHERE Region IS NOT NULL AND Quantity IS NOT NULL"
        ),
        # key figures
        "total_revenue": _clean("SELECT CAST(sum(Revenue) AS DOUBLE) AS total_revenue FROM clean"),
        "total_profit": _clean("SELECT CAST(sum(Profit) AS DOUBLE) AS total_profit FROM clean"),
        "total_orders": _clean("SELECT count(DISTINCT Order_ID) AS total_orders FROM clean"),
        "total_customers": _clean("SELECT count(DISTINCT Customer_ID) AS total_customers FROM clean"),
        "average_order_value": _clean(
            "SELECT CAST(sum(Revenue) AS DOUBLE) / count(DISTINCT Order_ID) AS average_order_value FROM clean"
        ),
        "kpi_scalars": _clean(_KPI.format(source="clean")),
        "monthly_revenue": _clean(_by("YearMonth", "YearMonth", Revenue="Revenue")),
        "monthly_revenue_growth": _clean(
            "SELECT YearMonth, CAST(Revenue AS DOUBLE) AS Revenue, round(Growth, 6) AS Revenue_Growth_Pct "
            f"FROM ({_growth('clean')})"
        ),
        "top_selling_products": _clean(_by("Product_Name", Revenue="Revenue", Quantity="Quantity")),
        "best_performing_regions": _clean(_by("Region", Revenue="Revenue", Profit="Profit")),
        "kpi_empty": _clean(_KPI.format(source="clean WHERE Order_Date < DATE '1981-01-01'")),
        # profile
        "row_count": _clean("SELECT count(*) AS rows, 17::BIGINT AS columns FROM clean"),
        "head": _clean(f"SELECT {_CLEAN_COLUMNS} FROM clean ORDER BY {_SEQ}, Order_ID LIMIT 10"),
        "column_info": _raw(
            _union(
                [
                    f"SELECT '{c}' AS column, '{_KINDS[c]}' AS dtype, count({c}) AS non_null FROM raw"
                    for c in _ALL
                ]
            )
        ),
        "nunique_per_column": _clean(
            _union(
                [
                    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_unique FROM clean"
                    for c in [*_ALL, "Year", "Month", "YearMonth", "Quarter"]
                ]
            )
        ),
        "missing_report": _raw(f"SELECT * FROM ({_nulls(_ALL, 'raw')}) WHERE missing_count > 0"),
        "missing_series": _raw(_nulls(_ALL, "raw")),
        "any_missing": _raw(
            "SELECT count(*) > 0 AS any_missing FROM raw WHERE Region IS NULL OR Quantity IS NULL "
            "OR Discount IS NULL OR Profit IS NULL"
        ),
        "describe": _clean(_describe()),
        "histogram_revenue": _clean(_histogram("Revenue")),
        "kde_revenue": _clean(_density("Revenue")),
        "histogram_profit": _clean(_histogram("Profit")),
        "kde_profit": _clean(_density("Profit")),
        "revenue_by_region_sorted": _clean(_by("Region", Revenue="Revenue")),
        "profit_margin": _clean(
            f"SELECT Order_ID, {_dbl('Revenue', 'Profit')}, "
            "round(CAST(Profit AS DOUBLE) / nullif(CAST(Revenue AS DOUBLE), 0) * 100, 2) AS Profit_Margin FROM clean"
        ),
        "profit_by_category": _clean(_by("Product_Category", Profit="Profit")),
        "top10_products": _clean(
            _by("Product_Name", "Revenue DESC, Product_Name", 10, Revenue="Revenue", Quantity="Quantity")
        ),
        "customer_stats": _clean(_customers()),
        "top10_customers": _clean(_customers(10)),
        "top15_customers": _clean(_customers(15)),
        "revenue_by_channel_asc": _clean(_by("Sales_Channel", Revenue="Revenue")),
        "correlation_matrix": _clean(_correlations()),
        "correlation_with_revenue": _clean(
            f"""SELECT "column", correlation FROM ({_correlations()}) WHERE other = 'Revenue'"""
        ),
        # dashboard
        "dash_monthly_trend": _selected(_by("YearMonth", source="selected", Revenue="Revenue")),
        "dash_revenue_by_region": _selected(_by("Region", source="selected", Revenue="Revenue")),
        "dash_revenue_by_category": _selected(
            "SELECT Product_Category, CAST(sum(Revenue) AS DOUBLE) AS Revenue, "
            "round(CAST(sum(Revenue) AS DOUBLE) / (SELECT CAST(sum(Revenue) AS DOUBLE) FROM selected) * 100, 6) "
            "AS Share_Pct FROM selected GROUP BY 1"
        ),
        "dash_top_products": _selected(
            _by("Product_Name", "Revenue DESC, Product_Name", 10, "selected", Revenue="Revenue", Quantity="Quantity")
        ),
        "dash_product_profitability": _selected(
            "SELECT Product_Name, Product_Category, CAST(sum(Revenue) AS DOUBLE) AS Revenue, "
            "CAST(sum(Profit) AS DOUBLE) AS Profit, "
            "round(CAST(sum(Profit) AS DOUBLE) / CAST(sum(Revenue) AS DOUBLE) * 100, 6) AS Margin_Pct "
            "FROM selected GROUP BY 1, 2"
        ),
        "dash_customer_segmentation": with_(
            [*_CLEAN_PARTS, _SELECTED, tiers],
            """SELECT CASE WHEN Revenue::DOUBLE <= q[1] THEN 'Low' WHEN Revenue::DOUBLE <= q[2] THEN 'Medium'
                WHEN Revenue::DOUBLE <= q[3] THEN 'High' ELSE 'Top' END AS Segment,
            count(*) AS Customers, CAST(sum(Revenue) AS DOUBLE) AS Revenue,
            CAST(sum(Revenue) AS DOUBLE) / count(*) AS Avg_Revenue FROM customers, cuts GROUP BY 1""",
        ),
        "dash_channel_performance": _selected(
            "SELECT Sales_Channel, CAST(sum(Revenue) AS DOUBLE) AS Revenue, CAST(sum(Profit) AS DOUBLE) AS Profit, "
            "count(DISTINCT Order_ID) AS Orders FROM selected GROUP BY 1"
        ),
        "format_kpi_cards": _selected(
            f"""SELECT unnest([
                {{'title': 'Total Revenue', 'text': {_short('total_revenue')}}},
                {{'title': 'Total Profit', 'text': {_short('total_profit')}}},
                {{'title': 'Total Orders', 'text': format('{{:,}}', total_orders)}},
                {{'title': 'Average Order Value', 'text': {_short('average_order_value')}}},
                {{'title': 'Total Unique Customers', 'text': format('{{:,}}', total_customers)}}], recursive := true)
            FROM ({_KPI.format(source='selected')})"""
        ),
        "format_currency": _clean(
            f"SELECT Product_Name, {_short('sum(Revenue)')} AS Revenue FROM clean GROUP BY Product_Name"
        ),
        "growth_table": _selected(
            f"SELECT YearMonth, {_money('Revenue')} AS Revenue, "
            "CASE WHEN Growth IS NULL THEN 'N/A' ELSE printf('%.1f%%', Growth) END AS Revenue_Growth_Pct "
            f"FROM ({_growth('selected')})"
        ),
        "top_products_table": _selected(
            f"SELECT Product_Name, {_money('Revenue')} AS Revenue, Quantity FROM ("
            + _by("Product_Name", "Revenue DESC, Product_Name", 15, "selected", Revenue="Revenue", Quantity="Quantity")
            + ")"
        ),
        "regions_table": _selected(
            f"SELECT Region, {_money('sum(Revenue)')} AS Revenue, {_money('sum(Profit)')} AS Profit "
            "FROM selected GROUP BY Region"
        ),
        # warehouse
        "sales_summary_view": with_(star, _SUMMARY_VIEW),
        "sales_summary_view_ambiguous": with_(ambiguous, _SUMMARY_VIEW),
        "sales_summary_monthly": with_(star, _SUMMARY),
        "load_customers": with_([_LINES], customers),
        "load_products": with_(
            [_LINES, _FIRST_PRODUCT],
            f"SELECT {_ids('product_name')} AS product_id, product_name, product_category FROM first_products",
        ),
        "load_orders": with_([_LINES, _FIRST_ORDER], "SELECT * EXCLUDE (rank) FROM first_orders"),
        "load_sales": with_([_LINES], f"{sales_lines} UNION ALL {sales_lines}"),
        "validate_constraints": with_([*_RAW_PARTS, _BROKEN], _violations()),
        "surrogate_ids": with_(
            [_LINES],
            f"""SELECT 'products' AS table, key, {_ids('key')} AS id FROM (SELECT DISTINCT Product_Name AS key FROM lines)
            UNION ALL
            SELECT 'orders' AS table, key, {_ids('key')} AS id FROM (SELECT DISTINCT Order_ID AS key FROM lines)""",
        ),
        "insert_defaults": _raw(
            "SELECT Order_ID AS order_id, Product_Name AS product_name, "
            "coalesce(CAST(Discount AS DOUBLE), 0.0) AS discount, true AS has_created_at FROM raw"
        ),
        "load_all": with_(
            [_LINES],
            "SELECT 'customers' AS table, count(DISTINCT Customer_ID) AS rows FROM lines "
            "UNION ALL SELECT 'products', count(DISTINCT Product_Name) FROM lines "
            "UNION ALL SELECT 'orders', count(DISTINCT Order_ID) FROM lines "
            "UNION ALL SELECT 'sales', count(*) FROM lines",
        ),
        # forecasting
        "segment_monthly": _segments(f"SELECT {segment_keys}, {segment_table} FROM segments"),
        "lag_features": _segments(f"SELECT {segment_keys}, {lag_table} FROM lags"),
        "label_encode": _segments(
            f"SELECT YearMonth, region_code AS Region, category_code AS Product_Category, {lag_table} FROM coded"
        ),
        "train_test_split": _segments(f"SELECT {segment_keys}, is_test FROM coded"),
        "fit_linear": with_(
            [*_CLEAN_PARTS, _SEGMENTS, *_ols()],
            _union(
                [
                    f"SELECT '{term}' AS term, round(c{i}, 4) AS coefficient FROM fit"
                    for i, term in enumerate(["Intercept", *_X])
                ]
            ),
        ),
        "regression_metrics": _segments(
            "SELECT round(linear_rmse, 4) AS linear_rmse, round(linear_mae, 4) AS linear_mae, "
            "round(linear_r2, 8) AS linear_r2, round(rf_rmse, 4) AS rf_rmse, round(rf_mae, 4) AS rf_mae, "
            f"round(rf_r2, 8) AS rf_r2 FROM ({_naive_metrics()})"
        ),
        "select_model": _segments(
            "SELECT CASE WHEN rf_rmse <= linear_rmse THEN 'Random Forest' ELSE 'Linear Regression' END "
            f"AS best_model_name FROM ({_naive_metrics()})"
        ),
        "future_months": _segments(
            "SELECT i AS step, strftime(last + to_months(CAST(i AS INTEGER)), '%Y-%m') AS YearMonth "
            "FROM last_month, range(1, 13) AS r(i)"
        ),
        "forecast_seed": with_(
            [*_CLEAN_PARTS, _SEGMENTS, _LAST_SEED],
            "SELECT Region, Product_Category, CAST(Previous_Revenue AS DOUBLE) AS Previous_Revenue, Previous_Sales, "
            "YearMonth, CAST(last AS VARCHAR) AS Last_Month FROM seeds, last_month",
        ),
        "segment_seeds": with_(
            [*_CLEAN_PARTS, _SEGMENTS, _ALL_SEEDS],
            "SELECT Region, Product_Category, CAST(Previous_Revenue AS DOUBLE) AS Previous_Revenue, Previous_Sales, "
            "YearMonth, CAST(last AS VARCHAR) AS Last_Month FROM seeds, last_month",
        ),
        "predict_future_linear": _forecast(_LAST_SEED, 12, ""),
        "forecast_all_segments_linear": _forecast(_ALL_SEEDS, 6, "Region, Product_Category,"),
        "model_save_load_linear": with_(
            [*_CLEAN_PARTS, _SEGMENTS, *_ols()],
            f"SELECT YearMonth, Region, Product_Category, round({_FITTED}, 1) AS prediction, "
            "0.0::DOUBLE AS linear_difference, 0.0::DOUBLE AS forest_difference FROM coded, fit",
        ),
        "fit_forest_properties": _segments(
            "SELECT YearMonth, Region, Product_Category, CAST(Revenue AS DOUBLE) AS Revenue, "
            "true AS in_range, true AS better_than_naive FROM coded WHERE is_test"
        ),
        "train_and_save_linear": with_([*_CLEAN_PARTS, _SEGMENTS, *_ols()], _linear_metrics()),
        "load_or_train_linear": with_(
            [*_CLEAN_PARTS, _SEGMENTS, *_ols()],
            "SELECT branch, m.* FROM (VALUES ('absent'), ('present')) AS b(branch), "
            f"({_linear_metrics()}) AS m",
        ),
        "dash_forecast_series_linear": _forecast_series(),
        # streaming
        "stream_star": _clean(_STREAMED),
        "stream_event_windows": _EVENT_WINDOWS,
        # joins on time
        "asof_exchange_rate": _rates_asof("ASOF LEFT JOIN rates AS r ON c.Region = r.Region AND c.Order_Date >= r.rate_date"),
        "asof_next_rate": _rates_asof(
            "LEFT JOIN rates AS r ON c.Region = r.Region AND r.rate_date = (SELECT min(rate_date) FROM rates AS x "
            "WHERE x.Region = c.Region AND x.rate_date > c.Order_Date AND x.rate_date <= c.Order_Date + 20)"
        ),
        "asof_last_view": """WITH views AS (SELECT * FROM events WHERE event_type = 'view')
            SELECT e.event_id, e.user_id, CASE WHEN near THEN v.event_id END AS view_id, CASE WHEN near THEN v.value END AS view_value
            FROM (SELECT * FROM events WHERE event_type = 'purchase') AS e
                ASOF LEFT JOIN views AS v ON e.user_id = v.user_id AND e.ts >= v.ts,
                LATERAL (SELECT e.ts <= v.ts + INTERVAL 1 HOUR AS near)""",
        "interval_join_promotions": "WITH " + _PROMOTIONS + """
            SELECT part, l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day,
                promotion, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to
            FROM lineitem JOIN promotions ON l_partkey = part AND CAST(l_shipdate AS DATE) >= valid_from
                AND (valid_to IS NULL OR CAST(l_shipdate AS DATE) < valid_to)
            WHERE l_linenumber > 1""",
        "overlap_join_promotions": "WITH " + _PROMOTIONS + """
            SELECT a.part, a.promotion, b.promotion AS other, CAST(a.valid_from AS VARCHAR) AS valid_from, CAST(b.valid_from AS VARCHAR) AS other_from
            FROM promotions AS a JOIN promotions AS b ON a.part = b.part AND a.promotion < b.promotion
                AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to AND a.valid_from < a.valid_to AND b.valid_from < b.valid_to""",
        # cubes and calendars
        "kpi_cube": _cube("CUBE", "Region, Product_Category, Sales_Channel, YearMonth"),
        "kpi_rollup": _cube("ROLLUP", "Region, YearMonth"),
        "monthly_frames": _frames("Product_Name"),
        "monthly_frames_total": _frames(""),
        "monthly_ranks": _clean(_RANKS),
        # differences and densities
        "difference_loaded": with_(
            [_LINES],
            "SELECT Order_ID AS order_id, CAST(Order_Date AS VARCHAR) AS order_date, Customer_Name AS customer_name, Product_Name AS product_name, "
            "Region AS region, CAST(Quantity AS BIGINT) AS quantity, CAST(Unit_Price AS DOUBLE) AS unit_price, CAST(Discount AS DOUBLE) AS discount, "
            "CAST(Revenue AS DOUBLE) AS revenue, CAST(Profit AS DOUBLE) AS profit, 0::BIGINT AS copies, 'none' AS kind FROM lines WHERE l_orderkey IS NULL",
        ),
        "difference_planted": with_(
            [_LINES, _PLANTED],
            """SELECT Order_ID, Product_Name, Region, CAST(Quantity AS BIGINT) AS Quantity, CAST(Revenue AS DOUBLE) AS Revenue, l_suppkey,
                CAST(copies AS BIGINT) AS copies,
                CASE WHEN max(copies) OVER k > 0 AND min(copies) OVER k < 0 THEN 'changed' WHEN max(copies) OVER k > 0 THEN 'removed' ELSE 'added' END AS kind
            FROM off WINDOW k AS (PARTITION BY Order_ID)""",
        ),
        "kde_revenue_binned": _clean(_density_binned("Revenue")),
        "kde_profit_binned": _clean(_density_binned("Profit")),
        "forest_stump": with_(
            [*_CLEAN_PARTS, _SEGMENTS, _STUMP],
            "SELECT YearMonth, Region, Product_Category, round(CASE WHEN x[f] <= v THEN low ELSE high END, 2) AS prediction FROM steps, best",
        ),
        # sketches and seasons
        "sketched_figures": _sketched(),
        "sketch_errors": _sketch_errors(),
        "anomalies": with_([*_CLEAN_PARTS, _MONTHS], _ANOMALIES),
        "seasonal_forecast": _seasonal_forecast(),
        "seasonal_holdout": _seasonal_holdout(),
        "quantity_decay": with_(
            [*_CLEAN_PARTS, _SEGMENTS, _LAST_SEED],
            "SELECT i AS step, strftime(last + to_months(CAST(i AS INTEGER)), '%Y-%m') AS YearMonth, "
            "round(Previous_Sales * pow(0.95, i - 1), 6) AS Previous_Sales "
            "FROM seeds, last_month, range(1, 13) AS r(i)",
        ),
    }
