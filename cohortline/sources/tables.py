"""Reading and writing named tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortline.functions.columns import decimal_comma, named

#: Folder of the manifests; its name hides it from readers of tables.
MANIFESTS = "_published"


def _files(spark: SparkSession, path: str) -> tuple:
    """The Hadoop path and the file system that it lies in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    place, files = _files(spark, f"{folder}/{MANIFESTS}")
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def published_folder(spark: SparkSession, folder: str) -> str:
    """The folder of the run that the newest manifest names; ``folder`` itself if there is none."""
    found = _manifests(spark, folder)
    return f"{folder}/{found[-1].split('-', 1)[1]}" if found else folder


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables ``folder/name`` by name, of the newest published run if there are any."""
    place = published_folder(spark, folder)
    return {name: spark.read.parquet(f"{place}/{name}") for name in names}


def publish_tables(
    tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None
) -> None:
    """Write the tables to a new run below ``folder`` and make it the one that readers see.

    The manifest is one empty file, whose name holds a number and the run: creating it is a
    single step. If a table fails, its run is removed and the earlier one stays. Older runs are
    left to readers that still use them.
    """
    spark = next(iter(tables.values())).sparkSession
    run = f"run-{uuid.uuid4().hex}"
    try:
        write_tables(tables, f"{folder}/{run}", partition_by)
    except Exception:
        place, files = _files(spark, f"{folder}/{run}")
        files.delete(place, True)
        raise
    found = _manifests(spark, folder)
    number = int(found[-1].split("-", 1)[0]) + 1 if found else 1
    place, files = _files(spark, f"{folder}/{MANIFESTS}/{number:08d}-{run}")
    if not files.createNewFile(place):
        raise RuntimeError(f"{place} exists: another run was published at the same time")


def write_tables(
    tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None
) -> None:
    """Write each table to ``folder/name`` as Parquet; column labels are kept."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        for_table = (partition_by or {}).get(name)
        if for_table:
            writer = writer.partitionBy(*for_table)
        writer.parquet(f"{folder}/{name}")


def read_sheet(
    spark: SparkSession, path: str, schema: T.StructType, null_value: str | None = None
) -> DataFrame:
    """A spreadsheet exported to CSV, with an optional text that stands for null."""
    reader = spark.read.schema(schema).option("header", True)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.csv(path)


def read_semicolon_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with ``;`` between fields and a decimal comma in numbers."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(as_text).option("header", True).option("sep", ";").csv(path)
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    return raw.select(
        *[
            (
                decimal_comma(named(f.name)).cast(f.dataType)
                if isinstance(f.dataType, fractional)
                else F.trim(named(f.name)).cast(f.dataType)
            ).alias(f.name)
            for f in schema.fields
        ]
    )


def write_demo(tables: dict[str, DataFrame], folder: str) -> None:
    """Write small tables as CSV with a header, for showing to people."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
