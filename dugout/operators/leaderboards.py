"""Leaderboards, activity lists, player search, freshness."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions import numbers
from dugout.functions.numbers import mean
from dugout.operators import appearances as ap
from dugout.operators.filters import ALL_TIME, Window, filter_pitches
from dugout.operators.pitchers import pitch_measures
from dugout.operators.players import name_players, player_appearances, role_columns


def _ranked(lines: DataFrame, players: DataFrame, min_pa: int, limit: int) -> DataFrame:
    kept = lines.filter(F.col("pa") >= min_pa)
    return name_players(kept, players, "batter").orderBy(F.desc("xwoba"), "batter_id").limit(limit)


def batting_leaderboard(
    at_bats: DataFrame, players: DataFrame, season: int, limit: int = 10, min_pa: int = 100, game_types=None
) -> DataFrame:
    """Batters of a season by expected wOBA."""
    measures = ap.result_rates()
    lines = (
        at_bats.filter(filter_pitches(Window(season=season), game_types=game_types))
        .groupBy("batter_id")
        .agg(
            numbers.rows().alias("pa"),
            measures["xwoba"].alias("xwoba"),
            mean(F.col("woba_value")).alias("woba"),
            *ap.named(measures, "k_pct", "bb_pct", "hr_pct", avg="hit_pct"),
        )
    )
    return _ranked(lines, players, min_pa, limit)


def _state_line(rows: DataFrame) -> DataFrame:
    measures = ap.result_rates()
    return rows.groupBy("batter_id").agg(
        numbers.rows().alias("pa"), *ap.named(measures, "xwoba", "k_pct", "bb_pct", avg="hit_pct")
    )


def batting_leaderboard_state(
    pitches: DataFrame,
    at_bats: DataFrame,
    players: DataFrame,
    scope: Window = ALL_TIME,
    *,
    balls: int | None = None,
    strikes: int | None = None,
    outs: int | None = None,
    stand: str | None = None,
    p_throws: str | None = None,
    game_types=None,
    limit: int = 10,
    min_pa: int = 10,
) -> DataFrame:
    """Batters by expected wOBA in a situation.

    With a count, appearances that reached it count for whoever batted then;
    without one, the situation is that at the start of the appearance.
    """
    hands = {"stand": stand, "p_throws": p_throws, "game_types": game_types}
    if balls is None or strikes is None:
        chosen = filter_pitches(scope, outs=outs, outs_col="outs_at_start", **hands)
        return _ranked(_state_line(at_bats.filter(chosen)), players, min_pa, limit)
    reached = pitches.filter(filter_pitches(scope, balls=balls, strikes=strikes, outs=outs, **hands))
    return _ranked(_state_line(ap.of_pitches(at_bats, reached, "batter_id")), players, min_pa, limit)


def _stuff(pitches: DataFrame, players: DataFrame, csw: str, min_pitches: int) -> DataFrame:
    lines = (
        pitches.filter("pitch_type IS NOT NULL")
        .groupBy("pitcher_id", "pitch_type")
        .agg(
            *ap.named(
                pitch_measures(), "pitches", "avg_velo", "avg_spin", "avg_h_break", "avg_v_break", "whiff_pct",
                csw_pct=csw,
            )
        )
        .filter(F.col("pitches") >= min_pitches)
    )
    return name_players(lines, players, "pitcher").orderBy(F.desc("whiff_pct"), "pitcher_id", "pitch_type")


def stuff_proxy(
    pitches: DataFrame,
    players: DataFrame,
    season: int,
    pitch_type: str | None = None,
    min_pitches: int = 100,
    game_types=None,
) -> DataFrame:
    """Pitchers' pitches by whiff rate; here CSW counts called strikes only."""
    chosen = filter_pitches(Window(season=season), pitch_type=pitch_type, game_types=game_types)
    return _stuff(pitches.filter(chosen), players, "called_strike_pct", min_pitches)


def stuff_leaderboard_window(
    pitches: DataFrame,
    players: DataFrame,
    scope: Window = ALL_TIME,
    *,
    pitch_type: str | None = None,
    min_pitches: int = 20,
    game_types=None,
    limit: int = 10,
) -> DataFrame:
    """The same over any window, with called strikes plus swings in CSW."""
    chosen = filter_pitches(scope, pitch_type=pitch_type, game_types=game_types)
    return _stuff(pitches.filter(chosen), players, "csw_pct", min_pitches).limit(limit)


def player_activity(
    pitches: DataFrame, at_bats: DataFrame, games: DataFrame, players: DataFrame, role: str
) -> DataFrame:
    """Id, name, team and activity of every player of a role.

    Batters count plate appearances; pitchers count pitches, from the same pass
    that finds their team.
    """
    player, _, _ = role_columns(role)
    seen = player_appearances(pitches, games, role).withColumnRenamed("player_id", player)
    if role == "batter":
        batted = at_bats.groupBy(player).agg(numbers.rows().alias("activity"))
        activity = batted.join(seen.drop("pitches"), player, "left")
    else:
        activity = seen.withColumnRenamed("pitches", "activity")
    stored = players.select(F.col("player_id").alias(player), F.col("team").alias("stored_team"))
    return (
        name_players(activity, players, role, "name")
        .join(stored, player, "left")
        .select(
            F.col(player).alias("id"),
            "name",
            F.coalesce(F.nullif("stored_team", F.lit("")), "latest_team").alias("team"),
            "activity",
        )
    )


def most_active(activity: DataFrame, limit: int = 200) -> DataFrame:
    return activity.orderBy(F.desc("activity"), "name", "id").limit(limit)


def player_search(activity: DataFrame, term: str, limit: int = 25) -> DataFrame:
    """Players whose name or team contains the term, or whose id is the term."""
    term = term.strip()
    needle = F.lit(term.lower())
    name = F.lower("name")
    found = (
        F.contains(name, needle)
        | F.contains(F.lower(F.coalesce("team", F.lit(""))), needle)
        | (F.col("id").cast("string") == term)
    )
    return (
        activity.filter(found)
        .orderBy(F.when(F.startswith(name, needle), 0).otherwise(1), F.desc("activity"), "name", "id")
        .limit(limit)
    )


def freshness(pitches: DataFrame, season: int, as_of: date) -> DataFrame:
    """Latest loaded date of a season and how many days behind a given day it is."""
    latest = pitches.filter(F.col("season") == season).agg(F.max("game_date").alias("latest_game_date"))
    stale = F.datediff(F.lit(as_of), F.col("latest_game_date"))
    return latest.select(
        F.lit(season).alias("season"),
        "latest_game_date",
        F.lit(as_of).alias("today"),
        stale.alias("days_stale"),
        F.coalesce(stale == 0, F.lit(False)).alias("up_to_date"),
    )
