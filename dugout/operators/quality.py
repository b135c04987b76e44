"""Coverage and validation checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.functions import vocab
from dugout.operators.appearances import beside

REFERENCE_SEASON = 2025
# Games known for whole seasons: season, regular, postseason, then by round F, D, L, W.
KNOWN_SEASONS = (
    (2020, 898, None, None, None, None, None),
    (2025, 2430, 47, 11, 18, 11, 7),
)
TOLERANCE = 2
THIN_DATE_GAMES = 10


def season_games(pitches: DataFrame) -> DataFrame:
    """Regular and postseason games per season."""
    per_type = (
        pitches.filter(F.col("game_type").isin(*vocab.SUPPORTED_GAME_TYPES))
        .groupBy("season", "game_type")
        .agg(F.count_distinct("game_pk").alias("games"))
    )

    def of(*types: str) -> Column:
        games = F.sum(F.when(F.col("game_type").isin(*types), F.col("games")))
        return F.coalesce(games, F.lit(0).cast("bigint"))

    return per_type.groupBy("season").agg(
        of("R").alias("regular_games"),
        of(*vocab.POSTSEASON_GAME_TYPES).alias("postseason_total"),
        *[of(t).alias(f"postseason_{t.lower()}") for t in vocab.POSTSEASON_GAME_TYPES],
    )


def known_expectations(spark) -> DataFrame:
    """Games that known seasons should hold."""
    names = ("regular_games", "postseason_total", "postseason_f", "postseason_d", "postseason_l", "postseason_w")
    columns = ", ".join(f"expected_{name} int" for name in names)
    return spark.createDataFrame(list(KNOWN_SEASONS), f"season int, {columns}")


def season_report(pitches: DataFrame, derived: dict[str, DataFrame], expectations: DataFrame | None = None) -> DataFrame:
    """One row per season: games by type, expectations, rows of every derived table."""
    counts = [
        table.groupBy("season").agg(F.count(F.lit(1)).alias(f"{name}_rows")) for name, table in derived.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [season_games(pitches), *counts])
    zero = F.lit(0).cast("bigint")
    report = stacked.groupBy("season").agg(
        *[F.coalesce(F.max(c), zero).alias(c) for c in stacked.columns if c != "season"]
    )
    if expectations is not None:
        report = report.join(expectations, "season", "left")
    return report.withColumn("reference_season", F.col("season") == REFERENCE_SEASON).orderBy("season")


def history_coverage(pitches: DataFrame, status: DataFrame, current_year: int) -> DataFrame:
    """Per season: expected, loaded, completed, and so missing or incomplete."""
    spark = pitches.sparkSession
    expected = spark.range(vocab.FIRST_SEASON, current_year + 1).select(F.col("id").cast("int").alias("season"))
    flags = ("expected", "loaded", "completed")

    def flagged(df: DataFrame, flag: str) -> DataFrame:
        return df.select("season").distinct().select("season", *[F.lit(f == flag).alias(f) for f in flags])

    seen = (
        flagged(expected, "expected")
        .unionByName(flagged(pitches.filter("season IS NOT NULL"), "loaded"))
        .unionByName(flagged(status.filter("completed"), "completed"))
        .groupBy("season")
        .agg(*[F.bool_or(f).alias(f) for f in flags])
    )
    return seen.select(
        "*",
        (F.col("expected") & ~F.col("completed")).alias("missing"),
        (F.col("loaded") & ~F.col("completed")).alias("incomplete"),
    ).orderBy("season")


def history_complete(coverage: DataFrame) -> DataFrame:
    """Season lists by state, and whether nothing is missing, as one row."""

    def listed(flag: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col(flag), F.col("season")))).alias(f"{flag}_seasons")

    return coverage.agg(
        *[listed(f) for f in ("expected", "loaded", "completed", "missing", "incomplete")],
        (F.count_if("missing") == 0).alias("history_complete"),
    )


def player_coverage(players: DataFrame) -> DataFrame:
    named = F.col("full_name").isNotNull()
    return players.agg(
        F.count(F.lit(1)).alias("total_players"),
        F.count_if(named).alias("named_players"),
        F.count_if(~named).alias("unnamed_players"),
        F.count_if(F.col("team").isNotNull()).alias("team_players"),
        (F.count_if(~named) == 0).alias("name_complete"),
    )


def game_count_verdict(
    pitches: DataFrame, expected: Column | None = None, partial_season: int | None = None
) -> DataFrame:
    """PASS, CLOSE (off by up to two), FAIL or PARTIAL per season.

    ``expected`` is the schedule size as an expression over ``season``.
    """
    target = vocab.season_games(F.col("season")) if expected is None else expected
    delta = F.col("delta")
    verdict = F.when(delta == 0, "PASS").when(F.abs(delta) <= TOLERANCE, "CLOSE").otherwise("FAIL")
    if partial_season is not None:
        verdict = F.when(F.col("season") == partial_season, "PARTIAL").otherwise(verdict)
    return (
        season_games(pitches)
        .select("season", "regular_games", "postseason_total", target.cast("bigint").alias("expected_games"))
        .withColumn("delta", F.col("regular_games") - F.col("expected_games"))
        .withColumn("verdict", verdict)
        .orderBy("season")
    )


def thin_dates(
    pitches: DataFrame,
    expected: Column | None = None,
    partial_season: int | None = None,
    fewer_than: int = THIN_DATE_GAMES,
) -> DataFrame:
    """Dates with few regular games, in full-schedule seasons whose count is off."""
    off = (
        game_count_verdict(pitches, expected, partial_season)
        .filter((F.col("delta") != 0) & (F.col("verdict") != "PARTIAL") & (F.col("season") != vocab.SHORT_SEASON))
        .select("season")
    )
    return (
        pitches.filter("game_type = 'R'")
        .groupBy("season", "game_date")
        .agg(F.count_distinct("game_pk").alias("games"), F.count_distinct("pitcher_team").alias("teams"))
        .filter(F.col("games") < fewer_than)
        .join(off, "season", "left_semi")
        .orderBy("season", "games", "game_date")
    )


def missing_games(schedule: DataFrame, pitches: DataFrame) -> DataFrame:
    """Scheduled games no pitch belongs to."""
    return schedule.join(pitches.select("game_pk"), "game_pk", "left_anti")


def empty_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table by name, with a warning on the empty ones."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    stacked = reduce(DataFrame.unionByName, counted)
    warning = F.when(F.col("row_count") == 0, F.concat(F.lit("WARNING: "), "table_name", F.lit(" is empty")))
    return stacked.withColumn("warning", warning).orderBy("table_name")


def status(pitches: DataFrame, players: DataFrame, backfill: DataFrame, current_year: int) -> DataFrame:
    """Date span, rows, season lists and name coverage as one row."""
    span = pitches.agg(
        F.min("game_date").alias("earliest_game_date"),
        F.max("game_date").alias("latest_game_date"),
        F.count(F.lit(1)).alias("pitches"),
    )
    coverage = history_complete(history_coverage(pitches, backfill, current_year))
    readable = coverage.select(
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in coverage.columns if c.endswith("_seasons")],
        "history_complete",
    )
    return beside(span, readable, player_coverage(players))
