"""The flat sales table as CSV files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.functions.values import na_to_null
from salescope.schema import SALES, SALES_FILE, SEQ

_CORRUPT = "_corrupt_record"


#: Quotes inside a quoted field are doubled, on both sides.
_DIALECT = {"quote": '"', "escape": '"'}


def load_sales_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rows of the CSV files at ``path``, typed, with their input position.

    Columns are found by the names in the header and all have a fixed type, so no
    pass over the data is spent on guessing. Every text for a missing value becomes
    NULL; text keeps its outer spaces. Amounts have 22 digits before the point and 8 after
    it, and further decimals, such as floating noise, are rounded. A number that cannot be
    read stops the query, so that it is never taken for a missing one. A line with too few
    fields is filled up with NULL; one with too many stops the query.

    Quoted fields may hold line breaks with ``multi_line``, which keeps Spark from
    splitting files. Without it such a field stops the query. ``_seq`` orders rows by
    file, block and position, as row numbers alone do not follow the files.

    Raises FileNotFoundError if nothing is at ``path``.
    """
    try:
        names = spark.read.options(header=True, multiLine=multi_line, **_DIALECT).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no sales data at {path}") from error
        raise
    absent = [c for c in SALES.names if c not in names]
    if absent:
        raise ValueError(f"sales data at {path} lacks the columns {', '.join(absent)}")

    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = (
        spark.read.schema(T.StructType(text.fields + [T.StructField(_CORRUPT, T.StringType())]))
        .options(
            header=True, enforceSchema=False, multiLine=multi_line, columnNameOfCorruptRecord=_CORRUPT, **_DIALECT
        )
        .csv(path)
    )
    # A malformed line is parsed again with one more field, to see if it was too long.
    # The message names all columns, because lines are only checked when all are read.
    wider = T.StructType(text.fields + [T.StructField("_more", T.StringType())])
    reparsed = F.from_csv(
        F.col(_CORRUPT), ", ".join(f"`{f.name}` STRING" for f in wider), {"multiLine": "true", **_DIALECT}
    )
    malformed = F.when(reparsed["_more"].isNotNull(), "too many fields after:").when(
        # Part of a field that goes on in another line has one of its quotes there.
        F.regexp_count(_CORRUPT, F.lit('"')) % 2 != 0,
        "a quote is not closed in its line:",
    )
    message = F.concat_ws(" ", malformed, *names, _CORRUPT)
    valid = F.when(
        F.col(_CORRUPT).isNotNull() & malformed.isNotNull(), F.raise_error(message).cast("boolean")
    ).otherwise(True)

    def typed(field: T.StructField) -> Column:
        value = na_to_null(F.col(field.name))
        if not isinstance(field.dataType, T.StringType):
            problem = F.concat_ws(" ", F.lit(f"{field.name} is no number that fits:"), value)
            number = value.try_cast(field.dataType)
            unread = value.isNotNull() & number.isNull()
            value = F.when(unread, F.raise_error(problem).cast(field.dataType)).otherwise(number)
        return value.alias(field.name)

    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.withColumn(SEQ, position).where(valid).select(*[typed(f) for f in SALES_FILE], SEQ)


def save_sales_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """The sales columns as CSV files with a header, NULL as an empty field.

    Text is written as it is, outer spaces and line breaks too. Files with ``compression``, such
    as ``gzip``, are read as they are; each of them by one task.
    """
    (
        df.select(SALES.names)
        .write.mode("overwrite")
        .options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **_DIALECT)
        .csv(path, compression=compression)
    )
