"""Column lists, labels and text clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def named(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c.removeprefix(prefix) for c in with_prefix(df, prefix)})


def move_first(df: DataFrame, *front: str) -> DataFrame:
    rest = [c for c in df.columns if c not in front]
    return df.select(*[named(c) for c in (*front, *rest)])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def any_non_null(*names: str) -> Column:
    """True where at least one of the columns holds a value."""
    return reduce(lambda a, b: a | b, [named(n).isNotNull() for n in names])


def with_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Attach a readable label to columns as metadata; kept by Parquet."""
    for name, label in labels.items():
        if name in df.columns:
            df = df.withMetadata(name, {"label": label})
    return df


def label_of(df: DataFrame, name: str) -> str | None:
    return df.schema[name].metadata.get("label")


def sentinel_to_null(df: DataFrame, sentinel: float, columns: list[str] | None = None) -> DataFrame:
    """Replace a reserved number by null in the numeric columns."""
    chosen = numeric_columns(df) if columns is None else columns
    return df.withColumns(
        {c: F.nullif(named(c), F.lit(sentinel).cast(df.schema[c].dataType)) for c in chosen}
    )


def ascii_text(column: Column) -> Column:
    """Blank every byte outside ASCII, then halve runs of spaces in one pass.

    A character of two, three or four UTF-8 bytes becomes as many spaces.
    """
    column = F.regexp_replace(column, r"[\x{0080}-\x{07FF}]", "  ")
    column = F.regexp_replace(column, r"[\x{0800}-\x{FFFF}]", "   ")
    column = F.regexp_replace(column, r"[\x{10000}-\x{10FFFF}]", "    ")
    return F.regexp_replace(column, "  ", " ")


def decimal_comma(column: Column) -> Column:
    """Read a number written with a decimal comma."""
    return F.regexp_replace(F.trim(column), ",", ".").cast("double")


def numeric_minimum(df: DataFrame) -> DataFrame:
    """Smallest value of every numeric column, skipping missing values; one row."""
    return df.agg(*[F.min(named(c)).alias(c) for c in numeric_columns(df)])


def label_table(df: DataFrame) -> DataFrame:
    """(column, label, rows): the readable label of every labelled column, and how many values it has."""
    labelled = {f.name: f.metadata["label"] for f in df.schema.fields if f.metadata.get("label")}
    counts = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("label"), F.count(named(c)).alias("rows"))
        for c, t in labelled.items()
    ]
    if not counts:
        return df.sparkSession.createDataFrame([], "column string, label string, rows long")
    return df.agg(F.array(*counts).alias("held")).select(F.inline("held"))
