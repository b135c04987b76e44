"""Pitcher and league pitching reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.functions import numbers, vocab
from dugout.functions.numbers import mean, rate, ratio, rnd
from dugout.operators import appearances as ap
from dugout.operators.counts import count_label, zone_values
from dugout.operators.filters import ALL_TIME, Window, filter_pitches
from dugout.operators.players import with_derived_teams


def pitch_measures() -> dict[str, Column]:
    d = F.col("description")
    return {
        "pitches": numbers.rows(),
        "g": F.count_distinct("game_pk"),
        "pitchers": F.count_distinct("pitcher_id"),
        "avg_velo": mean(F.col("release_speed"), 1),
        "avg_spin": mean(F.col("release_spin_rate"), 0),
        "avg_h_break": mean(F.abs("pfx_x"), 2),
        "avg_v_break": mean(F.col("pfx_z"), 2),
        "whiff_pct": rate(vocab.is_whiff(d)),
        "csw_pct": rate(vocab.is_csw_wide(d)),
        "called_strike_pct": rate(vocab.is_called_strike(d)),
    }


def usage_by_count(pitches: DataFrame, *measures: str) -> DataFrame:
    """Pitch mix per count: pitches, share within the count, and measures."""
    columns = pitch_measures()
    mix = (
        pitches.filter("pitch_type IS NOT NULL")
        .groupBy("balls", "strikes", "pitch_type")
        .agg(*ap.named(columns, "pitches", *measures))
    )
    in_count = F.sum("pitches").over(W.partitionBy("balls", "strikes"))
    return mix.withColumn("usage_pct", rnd(ratio(F.col("pitches"), in_count)))


def pitcher_count_profile(
    pitches: DataFrame, pitcher_id: int, scope: Window = ALL_TIME, game_types=None
) -> DataFrame:
    """Pitch mix of one pitcher in every count, and who the count favours."""
    chosen = pitches.filter(filter_pitches(scope, pitcher_id=pitcher_id, game_types=game_types))
    favours = (
        F.when(F.col("strikes") > F.col("balls"), "pitcher_count")
        .when(F.col("balls") > F.col("strikes"), "hitter_count")
        .otherwise("even")
    )
    return (
        usage_by_count(chosen, "avg_velo", "avg_spin", "whiff_pct")
        .select(
            "balls", "strikes", count_label().alias("count"), favours.alias("count_type"), "pitches", "pitch_type",
            "usage_pct", "avg_velo", "avg_spin", "whiff_pct",
        )
        .orderBy("balls", "strikes", F.desc("pitches"), "pitch_type")
    )


def pitcher_pitches(
    pitches: DataFrame,
    games: DataFrame,
    pitcher_id: int,
    scope: Window = ALL_TIME,
    *,
    game_types=None,
    team: str | None = None,
) -> DataFrame:
    """Pitches of one pitcher in scope, with derived teams, optionally of one team."""
    chosen = with_derived_teams(pitches.filter(filter_pitches(scope, pitcher_id=pitcher_id, game_types=game_types)), games)
    return chosen.filter(F.col("derived_pitcher_team") == team) if team else chosen


def _allowed(at_bats: DataFrame, pitches: DataFrame) -> DataFrame:
    faced = ap.of_pitches(at_bats, pitches, "pitcher_id")
    measures = ap.result_rates()
    return faced.agg(*ap.named(measures, "k_pct", "bb_pct", xwoba_allowed="xwoba"))


def pitcher_summary(chosen: DataFrame, at_bats: DataFrame) -> DataFrame:
    """One-row summary of ``pitcher_pitches``."""
    thrown = chosen.agg(
        *ap.named(pitch_measures(), "pitches", "g", "avg_velo", "avg_spin", "whiff_pct", "csw_pct"),
        ap.joined_team_list(F.col("derived_pitcher_team")).alias("team_display"),
    )
    return ap.beside(thrown, _allowed(at_bats, chosen))


def pitcher_seasons(
    pitches: DataFrame, games: DataFrame, pitcher_id: int, *, game_types=None, team: str | None = None
) -> DataFrame:
    """Season by team lines of one pitcher, over all seasons whatever the window."""
    return (
        pitcher_pitches(pitches, games, pitcher_id, game_types=game_types, team=team)
        .groupBy("season", F.col("derived_pitcher_team").alias("team"))
        .agg(*ap.named(pitch_measures(), "g", "pitches", "avg_velo", "avg_spin", "whiff_pct"))
        .orderBy(F.desc("season"), F.asc_nulls_last("team"))
    )


def pitcher_counts(chosen: DataFrame) -> DataFrame:
    """Pitch mix per count of any set of pitches."""
    return (
        usage_by_count(chosen, "avg_velo", "whiff_pct")
        .select("balls", "strikes", "pitch_type", "pitches", "usage_pct", "avg_velo", "whiff_pct")
        .orderBy("balls", "strikes", F.desc("usage_pct"), "pitch_type")
    )


def pitcher_zones(chosen: DataFrame) -> DataFrame:
    return zone_values(chosen, numbers.rows(), "pitches")


def league_pitching_summary(chosen: DataFrame, at_bats: DataFrame) -> DataFrame:
    """One-row pitching summary of the league."""
    d = F.col("description")
    thrown = chosen.agg(
        *ap.named(pitch_measures(), "pitches", "pitchers", "avg_velo", "avg_spin", "whiff_pct"),
        rate(vocab.is_csw_wide(d)).alias("csw_pct"),
    )
    return ap.beside(thrown, _allowed(at_bats, chosen))


def league_pitching_seasons(chosen: DataFrame) -> DataFrame:
    return (
        chosen.groupBy("season")
        .agg(*ap.named(pitch_measures(), "pitches", "avg_velo", "avg_spin", "whiff_pct"))
        .orderBy(F.desc("season"))
    )
