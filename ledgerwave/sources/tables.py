"""Reading sales tables: column checks, date parsing, numeric coercion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T


def read_table(source, spark: SparkSession | None = None, schema=None, format: str | None = None) -> DataFrame:
    """A DataFrame as it is, or a path: of `format` ("parquet", "csv", "orc", "json", ...), by default Parquet
    where it ends in .parquet, else CSV.

    CSV has a header, and its columns stay strings unless a schema is given (no inference pass)."""
    if isinstance(source, DataFrame):
        return source
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = str(source)
    format = format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)


def require_columns(df: DataFrame, date_col: str, value_col: str) -> None:
    for role, name in (("date_col", date_col), ("value_col", value_col)):
        if name not in df.columns:
            raise ValueError(f"{role} '{name}' not found in columns: {df.columns}")


# Date spellings that are tried in this order when no format is given.
DATE_FORMATS = ("yyyy/M/d", "M/d/yyyy", "yyyyMMdd", "d-MMM-yyyy", "MMM d, yyyy")


def _parsed_date(df: DataFrame, name: str, date_format: str | None) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        raw = F.trim(F.col(name))
        if date_format:
            return F.try_to_timestamp(raw, F.lit(date_format)).cast("date")
        tries = [F.try_to_timestamp(raw, F.lit(f)) for f in DATE_FORMATS]
        return F.coalesce(F.try_to_timestamp(raw), *tries).cast("date")
    return F.col(name).cast("date")


def _parsed_value(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    number = F.trim(F.col(name)).try_cast("double") if isinstance(kind, T.StringType) else F.col(name).cast("double")
    return F.when(~F.isnan(number), number)


# Spellings of a missing cell.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _missing_text(raw: Column) -> Column:
    return F.trim(raw).isin(*MISSING)


def checked_rows(df: DataFrame, date_col: str, value_col: str, others: list[str] = (), date_format: str | None = None) -> DataFrame:
    """`(others…, ds, y, bad_date, bad_value)`: parsed cells, and the text of those that cannot be read, else null.
    Missing values are no bad cells.  Nothing is counted and nothing fails, so it takes no pass of its own."""
    require_columns(df, date_col, value_col)
    ds, y = _parsed_date(df, date_col, date_format), _parsed_value(df, value_col)
    none = F.lit(None).cast("string")
    raw_d, raw_v = F.col(date_col), F.col(value_col)
    bad_d, bad_v = none, none
    if isinstance(df.schema[date_col].dataType, T.StringType):
        bad_d = F.when(raw_d.isNotNull() & ds.isNull(), raw_d)
    if isinstance(df.schema[value_col].dataType, T.StringType):
        bad_v = F.when(raw_v.isNotNull() & ~_missing_text(raw_v) & y.isNull(), raw_v)
    return df.select(*others, ds.alias("ds"), y.alias("y"), bad_d.alias("bad_date"), bad_v.alias("bad_value"))


@dataclass(frozen=True)
class TypedTable:
    rows: DataFrame  # others…, ds, y
    bad_rows: DataFrame  # others…, ds, y, bad_date, bad_value
    bad_dates: int
    bad_values: int


def write_typed(df: DataFrame, path: str, date_col: str, value_col: str, others: list[str] = (),
                date_format: str | None = None) -> TypedTable:
    """Write parsed rows as Parquet in one pass over the input: rows with a cell that cannot be read go to a folder of
    their own, and the cells are counted while they are written."""
    checked = checked_rows(df, date_col, value_col, others, date_format)
    seen = Observation()
    watched = checked.observe(seen, F.count("bad_date").alias("dates"), F.count("bad_value").alias("values"))
    is_bad = F.col("bad_date").isNotNull() | F.col("bad_value").isNotNull()
    watched.withColumn("is_bad", is_bad.cast("int")).write.partitionBy("is_bad").parquet(path)
    written = df.sparkSession.read.schema(f"{checked.schema.toDDL()}, is_bad int").parquet(path)
    counts = seen.get
    return TypedTable(written.where("is_bad = 0").select(*others, "ds", "y"),
                      written.where("is_bad = 1").drop("is_bad"), counts["dates"], counts["values"])


def typed_rows(
    df: DataFrame, date_col: str, value_col: str, others: list[str] = (), validate: bool = True,
    date_format: str | None = None,
) -> DataFrame:
    """`(others…, ds, y)` with parsed types; NaN and blank values become NULL.

    `validate=True` counts unreadable cells of text columns in one aggregate and
    raises before anything else runs.  `validate=False` saves that pass: an
    unreadable cell then fails the job that meets it."""
    checked = checked_rows(df, date_col, value_col, others, date_format)
    is_text = [isinstance(df.schema[c].dataType, T.StringType) for c in (date_col, value_col)]
    if validate and any(is_text):
        bad = checked.agg(F.count("bad_date").alias("d"), F.count("bad_value").alias("v")).first()
        if bad.d:
            raise ValueError(f"Cannot parse '{date_col}' as dates: {bad.d} bad value(s)")
        if bad.v:
            raise TypeError(f"'{value_col}' cannot be coerced to numeric: {bad.v} bad value(s)")
    ds, y = F.col("ds"), F.col("y")
    if not validate and is_text[0]:
        ds = F.when(F.col("bad_date").isNotNull(), F.raise_error(F.concat(F.lit(f"bad date in {date_col}: "), "bad_date"))).otherwise(ds)
    if not validate and is_text[1]:
        y = F.when(F.col("bad_value").isNotNull(), F.raise_error(F.concat(F.lit(f"bad number in {value_col}: "), "bad_value"))).otherwise(y)
    return checked.select(*others, ds.alias("ds"), y.alias("y"))
