"""Cleaning of raw pitch frames and building of the base dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from dugout.functions import keys, vocab
from dugout.schemas import GAMES, PITCHES, conform

AT_BAT_KEY = ("game_pk", "at_bat_number")
PITCH_KEY = ("game_pk", "at_bat_number", "pitch_number")


def clean_pitches(raw: DataFrame) -> DataFrame:
    """Raw feed rows with keys, base state, season and model column names.

    Every column of the feed is kept; ``PITCHES`` projection is the sink's job.
    """
    named = raw.withColumnsRenamed({"pitcher": "pitcher_id", "batter": "batter_id"})
    if "inning_half" not in named.columns and "inning_topbot" in named.columns:
        named = named.withColumnRenamed("inning_topbot", "inning_half")
    game_date = F.to_date("game_date")
    return named.withColumns(
        {
            "pitch_id": keys.joined_key(*[F.col(c) for c in PITCH_KEY]),
            "at_bat_id": keys.joined_key(*[F.col(c) for c in AT_BAT_KEY]),
            "base_state": keys.base_state(F.col("on_1b"), F.col("on_2b"), F.col("on_3b")),
            "game_date": game_date,
            "season": F.year(game_date),
        }
    )


def supported_games(df: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Regular-season and postseason rows; all rows when there is no game type.

    ``seen`` gets ``kept`` and ``removed``, counted on the way in whatever action
    runs the result, so they cost no job.
    """
    supported = F.col("game_type").isin(*vocab.SUPPORTED_GAME_TYPES) if "game_type" in df.columns else F.lit(True)
    supported = F.coalesce(supported, F.lit(False))
    if seen is not None:
        df = df.observe(seen, F.count_if(supported).alias("kept"), F.count_if(~supported).alias("removed"))
    return df.filter(supported)


def dedupe_pitches(df: DataFrame, order_by: list[Column] | None = None) -> DataFrame:
    """One row per pitch, the first under a declared order.

    The rank filter becomes a group limit before the shuffle, so a pitch that was
    delivered many times leaves each input partition at most once.
    """
    order = order_by or [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c not in PITCH_KEY]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*PITCH_KEY).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def repeated_keys(df: DataFrame) -> DataFrame:
    """Pitch keys that come more than once; only keys are shuffled."""
    return df.groupBy(*PITCH_KEY).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").drop("_times")


def dedupe_few(df: DataFrame, repeated: DataFrame) -> DataFrame:
    """``dedupe_pitches`` where few keys are repeated: only rows of those keys, which must fit a broadcast, are shuffled."""
    few = repeated.select(*[F.col(c).alias(f"_{c}") for c in PITCH_KEY])
    same = F.lit(True)
    for c in PITCH_KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    once = df.join(F.broadcast(few), same, "left_anti")
    return once.unionByName(dedupe_pitches(df.join(F.broadcast(few), same, "left_semi")))


def cleaned_pitches(raw: DataFrame) -> DataFrame:
    """Raw rows in the form of the pitch table, repeats among them."""
    return conform(supported_games(clean_pitches(raw)), PITCHES)


def prepare_pitches(raw: DataFrame) -> DataFrame:
    """Raw rows to the pitch table: clean, keep supported games, drop repeats."""
    return dedupe_pitches(cleaned_pitches(raw))


def player_stubs(pitches: DataFrame) -> DataFrame:
    """Every id seen pitching or batting, once, from one scan."""
    return (
        pitches.select(F.explode(F.array("pitcher_id", "batter_id")).alias("player_id"))
        .filter("player_id IS NOT NULL")
        .distinct()
    )


def games_dim(cleaned: DataFrame) -> DataFrame:
    """One row per game; values that vary within a game resolve to the largest."""
    values = [c for c in ("game_date", "home_team", "away_team", "game_type") if c in cleaned.columns]
    games = cleaned.groupBy("game_pk").agg(*[F.max(c).alias(c) for c in values])
    return conform(games.withColumn("season", F.year("game_date")), GAMES)


def upsert(existing: DataFrame, updates: DataFrame, keys_: list[str]) -> DataFrame:
    """Rows of ``updates`` replace rows with the same key."""
    kept = existing.join(updates.select(*keys_), keys_, "left_anti")
    return kept.select(*existing.columns).unionByName(updates, allowMissingColumns=True)


def insert_ignore(existing: DataFrame, updates: DataFrame, keys_: list[str]) -> DataFrame:
    """Rows of ``updates`` are added only where their key is new."""
    added = updates.join(existing.select(*keys_), keys_, "left_anti")
    return existing.unionByName(added.select(*updates.columns), allowMissingColumns=True)
