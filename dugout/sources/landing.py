"""Raw inputs: landed pitch files, single games, external season stats."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "orc")


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of: {', '.join(FORMATS)}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            raise ValueError("a CSV source needs a schema")
    if fmt == "parquet" and schema is None:
        reader = reader.option("mergeSchema", "true")
    return reader.load(path)


def in_dates(raw: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Rows of a date range.

    Dates compare in the column's own type, so the filter reaches the scan; where
    files lie in season folders, those outside the range are not listed.
    """
    as_text = isinstance(raw.schema["game_date"].dataType, T.StringType)

    def value(day: date):
        return F.lit(day.isoformat() if as_text else day)

    in_folders = "season" in raw.columns
    if start is not None:
        raw = raw.filter(F.col("game_date") >= value(start))
        raw = raw.filter(F.col("season") >= start.year) if in_folders else raw
    if end is not None:
        # Before the next day, so that a time of day on the last one is kept.
        raw = raw.filter(F.col("game_date") < value(end + timedelta(days=1)))
        raw = raw.filter(F.col("season") <= end.year) if in_folders else raw
    return raw


def read_pitches(
    spark: SparkSession,
    path: str,
    start: date | None = None,
    end: date | None = None,
    *,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Raw pitch rows of a date range."""
    return in_dates(_read(spark, path, fmt, schema), start, end)


def read_game(
    spark: SparkSession, path: str, game_pk: int, *, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Raw pitch rows of one game."""
    return _read(spark, path, fmt, schema).filter(F.col("game_pk") == game_pk)


def read_season_stats(
    spark: SparkSession, path: str, season: int, *, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """External stat rows of a season; all rows where the source has no season."""
    stats = _read(spark, path, fmt, schema)
    if "Season" not in stats.columns:
        return stats
    return stats.filter(F.coalesce(F.col("Season"), F.lit(season)) == season)
