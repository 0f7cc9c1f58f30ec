"""Results as JSON documents and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(x: Column, digits: int = 12) -> Column:
    """A double with so many decimals, as text; null for null and for what is not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.format_string(f"%.{digits}f", x))


def json_result(rows: DataFrame, digits: int = 12) -> DataFrame:
    """One column ``document``: each row as JSON, doubles with ``digits`` decimals, nulls written out."""
    parts = []
    for f in rows.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        value = fixed(c, digits) if kind in ("double", "float") else c.cast("string") if kind in ("int", "bigint", "smallint", "tinyint", "boolean") else F.get(F.split(F.to_json(F.array(c.cast("string"))), r"^\[|\]$"), F.lit(1))
        parts.append(F.concat(F.lit(f'"{f.name}":'), F.coalesce(value, F.lit("null"))))
    return rows.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("document"))


def write_csv(rows: DataFrame, path: str, digits: int = 9) -> None:
    """A folder of CSV files with headers, doubles with ``digits`` decimals; fails where there is one."""
    doubles = {f.name for f in rows.schema if f.dataType.simpleString() == "double"}
    rows.select(*[fixed(F.col(f"`{c}`"), digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in rows.columns]).write.mode("errorifexists").option("header", True).csv(path)
