"""Batter reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions import numbers, vocab
from dugout.functions.numbers import rate, ratio, rnd
from dugout.operators import appearances as ap
from dugout.operators.counts import count_results, zone_values
from dugout.operators.filters import ALL_TIME, Window, filter_pitches
from dugout.operators.players import role_columns, with_derived_teams

SPLITS = ("base_state", "outs_at_start", "final_count", "p_throws", "stand")


def situational_splits(
    at_bats: DataFrame,
    player_id: int,
    role: str = "batter",
    split_by: str = "base_state",
    scope: Window = ALL_TIME,
    game_types=None,
) -> DataFrame:
    """Results of one player by a situation column."""
    if split_by not in SPLITS:
        raise ValueError(f"split_by must be one of: {', '.join(SPLITS)}")
    player, _, _ = role_columns(role)
    chosen = filter_pitches(scope, game_types=game_types, **{player: player_id})
    measures = ap.result_rates()
    return (
        at_bats.filter(chosen)
        .groupBy(F.col(split_by).alias("split_value"))
        .agg(
            numbers.rows().alias("pa"),
            measures["xwoba"].alias("xwoba"),
            numbers.mean(F.col("woba_value")).alias("woba"),
            *ap.named(measures, "k_pct", "bb_pct", "hr_pct"),
        )
        .orderBy(F.desc("pa"), F.asc_nulls_last("split_value"))
    )


def batter_pitches(
    pitches: DataFrame,
    games: DataFrame,
    batter_id: int,
    scope: Window = ALL_TIME,
    *,
    game_types=None,
    team: str | None = None,
) -> DataFrame:
    """Pitches one batter saw in scope, with derived teams, optionally for one team."""
    chosen = with_derived_teams(pitches.filter(filter_pitches(scope, batter_id=batter_id, game_types=game_types)), games)
    return chosen.filter(F.col("derived_batter_team") == team) if team else chosen


def appearances_with_team(chosen: DataFrame, at_bats: DataFrame) -> DataFrame:
    """At-bat rows of the chosen pitches with the batting team of the appearance."""
    teams = chosen.groupBy(*ap.APPEARANCE).agg(F.max("derived_batter_team").alias("batter_team"))
    return at_bats.join(teams, list(ap.APPEARANCE))


def _slash(counts: dict, on_base_of) -> list:
    """Average, on-base over a given denominator, slugging."""
    return [
        rnd(ratio(counts["hits"], counts["at_bats"])).alias("avg"),
        rnd(ratio(counts["hits"] + counts["walks"], on_base_of)).alias("obp"),
        rnd(ratio(counts["total_bases"], counts["at_bats"])).alias("slg"),
    ]


def batter_summary(chosen: DataFrame, at_bats: DataFrame) -> DataFrame:
    """One-row batting line; on-base counts events other than hit-by-pitch."""
    counts, rates = ap.event_counts(), ap.result_rates()
    return appearances_with_team(chosen, at_bats).agg(
        numbers.rows().alias("pa"),
        F.count_distinct("game_pk").alias("g"),
        *ap.named(counts, "at_bats", "hits", "doubles", "triples", "hr", "walks", "strikeouts", "sac_fly", "total_bases"),
        *ap.named(rates, "xwoba", "k_pct", "bb_pct"),
        *_slash(counts, counts["not_hit_by_pitch"]),
        ap.joined_team_list(F.col("batter_team")).alias("team_display"),
    )


def batter_seasons(chosen: DataFrame, at_bats: DataFrame) -> DataFrame:
    """Batting lines by season and team."""
    counts, rates = ap.event_counts(), ap.result_rates()
    return (
        appearances_with_team(chosen, at_bats)
        .groupBy("season", F.col("batter_team").alias("team"))
        .agg(
            F.count_distinct("game_pk").alias("g"),
            numbers.rows().alias("pa"),
            *ap.named(counts, "doubles", "triples", "hr", ab="at_bats", h="hits", bb="walks", so="strikeouts"),
            rates["xwoba"].alias("xwoba"),
            *_slash(counts, counts["not_hit_by_pitch"]),
        )
        .orderBy(F.desc("season"), F.asc_nulls_last("team"))
    )


def batter_counts(chosen: DataFrame, at_bats: DataFrame) -> DataFrame:
    return count_results(chosen, at_bats)


def batter_zone_contact(chosen: DataFrame) -> DataFrame:
    """Whole-number contact percentage per strike zone."""
    touched = vocab.is_contact(F.col("bb_type"), F.col("description"))
    share = ratio(F.count_if(touched), numbers.rows())
    return zone_values(chosen, rnd(share * 100, 0).cast("int"), "contact_rate")


def batter_stat_line(at_bats: DataFrame, where=None) -> DataFrame:
    """Totals and rates of any set of at-bats, as one row."""
    chosen = at_bats if where is None else at_bats.filter(where)
    counts, rates = ap.event_counts(), ap.result_rates()
    return chosen.agg(
        numbers.rows().alias("pa"),
        *ap.named(rates, "xwoba", "k_pct", "bb_pct"),
        *ap.named(counts, "hr", "hits", "walks", "at_bats", "total_bases"),
    )
