"""Properties that aren't known when a query is planned: a VARIANT column, in which each row has names and types of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """Properties from a JSON object as text; null where it is none."""
    return F.try_parse_json(text)


def _path(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"no property can be named {name!r}")
    return f"$['{name}']"


def value(properties: Column, name: str, kind: str) -> Column:
    """A property as a type of Spark; null where it is absent or can't be one."""
    return F.try_variant_get(properties, _path(name), kind)


def has(properties: Column, name: str) -> Column:
    """Whether a row has the property, be it null; null without properties."""
    return F.when(properties.isNotNull(), F.try_variant_get(properties, _path(name), "variant").isNotNull())


def unfolded(df: DataFrame, properties: str, pattern: str | None = None) -> DataFrame:
    """df's other columns with name, type and text of each property of each row, or of those whose name the pattern finds. Rows without one have none."""
    each = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(properties).outer()))
    found = each if pattern is None else each.where(F.col("key").rlike(pattern))
    return found.select(*(c for c in df.columns if c != properties), F.col("key").alias("name"), F.schema_of_variant("value").alias("type"), F.try_variant_get("value", "$", "string").alias("text"))
