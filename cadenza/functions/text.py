"""Text helpers: typed property lists, base64, colours, key=value profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_list(text: Column, kind: str = "string") -> Column:
    """A colon-separated list; elements that don't parse are null."""
    return F.transform(F.split(text, ":"), lambda x: x.try_cast(kind))


def parse_bool(text: Column) -> Column:
    """True if the text holds 'true'."""
    return F.contains(F.lower(text), F.lit("true"))


def to_base64(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def from_base64(text: Column) -> Column:
    return F.decode(F.unbase64(text), "UTF-8")


def to_yuv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Studio-range Y'CbCr (BT.601) of 8-bit R'G'B', truncated."""
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x).cast("int")))
    return {
        "y": clip(16 + (65.738 * r + 129.057 * g + 25.064 * b) / 256),
        "u": clip(128 + (-37.945 * r - 74.494 * g + 112.439 * b) / 256),
        "v": clip(128 + (112.439 * r - 94.154 * g - 18.285 * b) / 256),
    }


def arrange_rgb(pf: str, r: Column, g: Column, b: Column, a: Column, bits: int = 8) -> Column:
    """The samples of a pixel in the order and depth that the format's name says (a8r8g8b8, r16g16b16, ...), from values of so many bits."""
    own = {"r": r, "g": g, "b": b, "a": a}
    parts = re.findall(r"([rgba])([0-9]+)", pf)
    if len(parts) < 3 or not {"r", "g", "b"} <= {name for name, _ in parts}:
        raise ValueError(pf)
    top = 2 ** int(parts[0][1]) - 1
    return F.array(*(F.floor(own[name].cast("long") * top / (2**bits - 1)).cast("int") for name, _ in parts))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """key and value of each key=value line; blank lines and those from # on are left out."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    return lines.select(F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_extract("line", "=(.*)$", 1)).alias("value"))
