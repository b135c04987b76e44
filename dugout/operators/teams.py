"""Team reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions import numbers, vocab
from dugout.functions.numbers import ratio, rnd
from dugout.operators import appearances as ap
from dugout.operators.batters import appearances_with_team
from dugout.operators.filters import ALL_TIME, Window, filter_pitches
from dugout.operators.pitchers import pitch_measures
from dugout.operators.players import name_players, with_derived_teams

ROSTER = 25


def teams(games: DataFrame) -> DataFrame:
    """Every team code that played, sorted."""
    return (
        games.select(F.explode(F.array("home_team", "away_team")).alias("team"))
        .filter("team IS NOT NULL AND team <> ''")
        .distinct()
        .orderBy("team")
    )


def scoped_pitches(pitches: DataFrame, games: DataFrame, scope: Window = ALL_TIME, game_types=None) -> DataFrame:
    return with_derived_teams(pitches.filter(filter_pitches(scope, game_types=game_types)), games)


def team_summary(scoped: DataFrame, at_bats: DataFrame, team: str) -> DataFrame:
    """Batting and pitching of one team as one row; on-base counts every appearance.

    Pitches fold to one row per appearance that knows which side the team was on,
    so one scan and one join serve both halves of the line.
    """
    batting, pitching = F.col("derived_batter_team") == team, F.col("derived_pitcher_team") == team
    on_either_side = scoped.filter(batting | pitching)
    speed = F.when(pitching, F.col("release_speed"))
    sides = on_either_side.groupBy(*ap.APPEARANCE).agg(
        F.bool_or(batting).alias("batted"),
        F.bool_or(pitching).alias("threw"),
        F.count_if(pitching).alias("thrown"),
        F.count_if(pitching & vocab.is_whiff(F.col("description"))).alias("whiffs"),
        F.sum(speed).alias("speed_sum"),
        F.count(speed).alias("speed_n"),
    )
    results = at_bats.select(*ap.APPEARANCE, "final_event", "xwoba", F.lit(True).alias("rolled_up"))
    joined = sides.join(results, list(ap.APPEARANCE), "left")
    batted, threw = F.col("batted") & F.col("rolled_up"), F.col("threw") & F.col("rolled_up")
    lines = joined.withColumns(
        {"bat_event": F.when(batted, F.col("final_event")), "threw_event": F.when(threw, F.col("final_event"))}
    )
    counts = ap.event_counts("bat_event")
    pa, faced = F.count_if(batted), F.count_if(threw)
    threw_event = F.col("threw_event")
    summary = lines.agg(
        F.count_distinct("game_pk").alias("games"),
        pa.alias("pa"),
        *ap.named(counts, "at_bats", "hits", "hr", "walks", "strikeouts"),
        rnd(ratio(counts["hits"], counts["at_bats"])).alias("avg"),
        rnd(ratio(counts["hits"] + counts["walks"], pa)).alias("obp"),
        rnd(ratio(counts["total_bases"], counts["at_bats"])).alias("slg"),
        numbers.mean(F.when(batted, F.col("xwoba"))).alias("xwoba"),
        F.sum("thrown").alias("pitches"),
        rnd(ratio(F.sum("speed_sum"), F.sum("speed_n")), 1).alias("avg_velo"),
        rnd(ratio(F.sum("whiffs"), F.sum("thrown"))).alias("whiff_pct"),
        numbers.mean(F.when(threw, F.col("xwoba"))).alias("xwoba_allowed"),
        rnd(ratio(F.count_if(vocab.is_strikeout(threw_event)), faced)).alias("k_pct_allowed"),
        rnd(ratio(F.count_if(vocab.is_walk(threw_event)), faced)).alias("bb_pct_allowed"),
    )
    staff = scoped.filter(pitching).agg(F.count_distinct("pitcher_id").alias("pitchers"))
    return ap.beside(summary, staff).select(F.lit(team).alias("team"), "*")


def team_batting(
    scoped: DataFrame, at_bats: DataFrame, players: DataFrame, team: str, at_bats_where=None, limit: int = ROSTER
) -> DataFrame:
    """The team's most used batters."""
    counts, rates = ap.event_counts(), ap.result_rates()
    kept = at_bats if at_bats_where is None else at_bats.filter(at_bats_where)
    lines = (
        appearances_with_team(scoped.filter(F.col("derived_batter_team") == team), kept)
        .groupBy("batter_id")
        .agg(
            F.count_distinct("game_pk").alias("g"),
            numbers.rows().alias("pa"),
            *ap.named(
                counts, "doubles", "triples", "hr", ab_count="at_bats", h="hits", bb="walks", so="strikeouts"
            ),
            rnd(ratio(counts["hits"], counts["at_bats"])).alias("avg"),
            rnd(ratio(counts["hits"] + counts["walks"], numbers.rows())).alias("obp"),
            rnd(ratio(counts["total_bases"], counts["at_bats"])).alias("slg"),
            rates["xwoba"].alias("xwoba"),
        )
    )
    return name_players(lines, players, "batter").orderBy(F.desc("pa"), "batter_name", "batter_id").limit(limit)


def team_pitching(
    scoped: DataFrame, at_bats: DataFrame, players: DataFrame, team: str, limit: int = ROSTER
) -> DataFrame:
    """The team's most used pitchers with the results of the appearances they threw in."""
    thrown = scoped.filter(F.col("derived_pitcher_team") == team)
    lines = thrown.groupBy("pitcher_id").agg(
        *ap.named(pitch_measures(), "g", "pitches", "avg_velo", "avg_spin", "whiff_pct")
    )
    allowed = (
        ap.of_pitches(at_bats, thrown, "pitcher_id")
        .groupBy("pitcher_id")
        .agg(*ap.named(ap.result_rates(), "k_pct", "bb_pct", xwoba_allowed="xwoba"))
    )
    return (
        name_players(lines.join(allowed, "pitcher_id", "left"), players, "pitcher")
        .orderBy(F.desc("pitches"), "pitcher_name", "pitcher_id")
        .limit(limit)
    )
