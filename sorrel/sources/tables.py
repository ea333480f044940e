"""Reading tables: columns are pruned and filters pushed by Spark; a completeness gate fails closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_state(df: DataFrame, expected: int | None) -> str:
    """ready, empty or failed: a read is ready only if it has exactly the rows that its source reports."""
    n = df.count()
    return "failed" if expected is None or n != expected else "ready" if n else "empty"


def content_range_total(header: str | None) -> int | None:
    """The total of a Content-Range header such as 0-24/25; null if it's unknown or malformed."""
    import re

    m = re.fullmatch(r"\s*(?:\d+-\d+|\*)/(\d+)\s*", header or "")
    return int(m[1]) if m else None


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """RFC 4180 CSV with a header, quoted cells over several lines, all columns as text; refuses a file without a required column."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.where(F.coalesce(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.lit(True)) for c in df.columns], F.lit(False)))


def parse_feed(bodies: DataFrame, body: str, schema: str) -> DataFrame:
    """Rows of JSON feeds, an array or an object with ``rows``; rows without an id are skipped, unreadable bodies give none."""
    as_list = F.from_json(body, f"array<{schema}>")
    as_object = F.from_json(body, f"struct<rows:array<{schema}>>")["rows"]
    keep = [c for c in bodies.columns if c != body]
    rows = F.explode(F.coalesce(F.when(F.ltrim(body).startswith("["), as_list), as_object))
    return bodies.select(*keep, rows.alias("row")).select(*keep, "row.*").where("id IS NOT NULL")


def parse_params(text_column: str):
    """k=v;k=v as a map; pieces without = are dropped."""
    parts = F.filter(F.transform(F.split(text_column, ";"), lambda x: F.trim(x)), lambda p: p.contains("="))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))), F.trim(F.regexp_replace(p, r"^[^=]*=", "")))))
