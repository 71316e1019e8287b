"""Readers of text, CSV and JSON files, extracts of databases, and table helpers."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import camel

#: Column types of source databases and the types they are kept as.
TYPES = {
    "tinyint": "int",
    "smallint": "int",
    "mediumint": "int",
    "int": "int",
    "integer": "int",
    "bigint": "bigint",
    "float": "double",
    "double": "double",
    "decimal": "decimal",
    "char": "string",
    "varchar": "string",
    "text": "string",
    "json": "string",
    "year": "string",
    "binary": "binary",
    "varbinary": "binary",
    "blob": "binary",
    "date": "date",
    "datetime": "timestamp",
    "timestamp": "timestamp",
}


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a schema spares the pass over the data that inferring takes."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def csv_counted(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, int]:
    """csv_table() and its number of rows."""
    df = csv_table(spark, path, schema)
    return df, df.count()


def head_rows(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first n rows, in an order if one is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def append_rows(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    """Append the rows with these columns in this order."""
    df.select(*columns).write.mode("append").format(fmt).save(path)


def stamped(df: DataFrame, name: str = "etl_time") -> DataFrame:
    """df with the time of this load; it differs with every run."""
    return df.withColumn(name, F.current_timestamp())


def extract(spark: SparkSession, url: str, table: str, *, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database; split (column, least, greatest, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split:
        column, low, high, parts = split
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def full_day(df: DataFrame, day: date) -> DataFrame:
    """All rows, in the partition of one day."""
    return df.withColumn("ds", F.lit(day.strftime("%Y%m%d")))


def changed_on(df: DataFrame, created: str, day: date) -> DataFrame:
    """Rows created on a day, with ds from that time.

    The day is a range of times, which reaches the scan or the database as a filter.
    """
    start = F.lit(day).cast("timestamp")
    rows = df.where((F.col(created) >= start) & (F.col(created) < start + F.expr("interval 1 day")))
    return rows.withColumn("ds", F.date_format(created, "yyyyMMdd"))


def warehouse_type(source_type: str) -> str:
    """varchar(20) to string, bigint unsigned to decimal(20,0), decimal(10,2) as it is; unknown types are kept as text."""
    name, _, rest = source_type.strip().lower().partition("(")
    word, *more = name.split()
    if word == "bigint" and "unsigned" in (*more, *rest.replace(")", " ").split()):
        return "decimal(20,0)"
    kept = TYPES.get(word, "string")
    return f"decimal({rest.partition(')')[0]})" if kept == "decimal" and rest else kept


def typed(df: DataFrame, source_types: dict[str, str]) -> DataFrame:
    """df with columns cast by their types in the source."""
    return df.select(*[F.col(c).cast(warehouse_type(source_types[c])).alias(c) if c in source_types else F.col(c) for c in df.columns])


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines with a random row_id, and the malformed lines (line). Blank lines go.

    Fields that the schema calls string keep a nested object as JSON text. The
    row_id differs with every run.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("row"))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return read.where(~bad).select(F.expr("uuid()").alias("row_id"), "row.*").drop("_bad"), read.where(bad).select(F.col("value").alias("line"))


def region_codes(spark: SparkSession, path: str) -> DataFrame:
    """(code, origin, province, city, area) of lines `code province,city,area`; missing levels are null."""
    lines = spark.read.option("sep", " ").schema("code string, origin string").csv(path)
    levels = F.split("origin", ",", 3)
    return lines.select("code", "origin", *[F.get(levels, F.lit(k)).alias(name) for k, name in enumerate(("province", "city", "area"))])


def _clean(df: DataFrame, pattern: str, by: str) -> DataFrame:
    return df.select(*[F.regexp_replace(c, pattern, by).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def renamed_csv(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """The columns that `names` lists, by their new names; line breaks in texts become spaces."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return _clean(df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]), r"[\r\n]+", " ")


def platform_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """CSV files of several platforms in one table with `platform`; line breaks and tabs go from texts."""
    parts = [spark.read.option("header", True).option("multiLine", True).csv(path).withColumn("platform", F.lit(name)) for name, path in paths.items()]
    return _clean(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), r"[\r\n\t]", "")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): the different non-empty lines of text files, trimmed."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\r\t]", " ")).alias("word")).where("word <> ''").distinct()


def camel_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel(c) for c in df.columns])


def renamed_with(df: DataFrame, old: str, new: str, added: str, value: Column) -> DataFrame:
    """A column by a new name, and another one right after it."""
    both = {old: [F.col(old).alias(new), value.alias(added)]}
    return df.select(*[c for name in df.columns for c in both.get(name, [F.col(name)])])


def temporary(df: DataFrame, name: str, *, reused: bool = False) -> DataFrame:
    """df as a temporary view; cached if it is used several times."""
    df = df.cache() if reused else df
    df.createOrReplaceTempView(name)
    return df
