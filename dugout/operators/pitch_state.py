"""Rates read off the materialised summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.functions.numbers import mean, ratio, rnd
from dugout.operators.filters import filter_pitch_state


def _share_of(total: str, parts: dict[str, str]) -> list[Column]:
    return [rnd(ratio(F.sum(part), F.sum(total))).alias(name) for name, part in parts.items()]


def _weighted(value: str) -> Column:
    """Mean weighted by pitches, over groups that have a value."""
    weight = F.when(F.col(value).isNotNull(), F.col("pitches"))
    return rnd(ratio(F.sum(F.col(value) * weight), F.sum(weight)))


def state_rates(summary: DataFrame, where: Column, min_pitches: int = 1) -> DataFrame:
    """Outcome rates per pitch type over the chosen groups of a state summary.

    ``plate_appearances`` adds up over pitch types, so an appearance counts once
    per type it saw.  ``avg_*`` weigh every group alike; ``weighted_*`` weigh by
    pitches.
    """
    return (
        summary.filter(where)
        .groupBy("pitch_type")
        .agg(
            F.max("pitch_name").alias("pitch_name"),
            F.sum("pitches").alias("pitches"),
            F.sum("plate_appearances").alias("plate_appearances"),
            *_share_of(
                "pitches",
                {
                    "ball_pct": "ball_events",
                    "called_strike_pct": "called_strikes",
                    "whiff_pct": "whiffs",
                    "foul_pct": "fouls",
                    "in_play_pct": "balls_in_play",
                    "hit_event_pct": "hit_events",
                },
            ),
            *_share_of("plate_appearances", {"walk_rate": "walk_events", "strikeout_rate": "strikeout_events"}),
            mean(F.col("avg_woba_value")).alias("avg_woba_value"),
            mean(F.col("avg_xwoba")).alias("avg_xwoba"),
            _weighted("avg_woba_value").alias("weighted_woba_value"),
            _weighted("avg_xwoba").alias("weighted_xwoba"),
        )
        .filter(F.col("pitches") >= min_pitches)
    )


def _with_usage(rates: DataFrame) -> DataFrame:
    # One row per pitch type is left here, so a single window group is a few rows.
    total = F.sum("pitches").over(W.partitionBy())
    return rates.withColumn("usage_pct", rnd(ratio(F.col("pitches"), total)))


def _by_volume(rates: DataFrame, volume: str = "pitches", tie: str = "pitch_type") -> DataFrame:
    return rates.orderBy(F.desc(volume), F.asc_nulls_last(tie))


def pitch_state_league(summary: DataFrame, min_pitches: int = 1, **state) -> DataFrame:
    """League outcome rates and usage per pitch type in a state."""
    return _by_volume(_with_usage(state_rates(summary, filter_pitch_state(**state), min_pitches)))


def pitch_state_player(
    summary: DataFrame, player_id: int, perspective: str, min_pitches: int = 1, **state
) -> DataFrame:
    """The same for one player, as batter or pitcher."""
    where = filter_pitch_state(player_id=player_id, perspective=perspective, **state)
    return _by_volume(_with_usage(state_rates(summary, where, min_pitches)))


def outcome_by_pitch(summary: DataFrame, min_pitches: int = 1, **state) -> DataFrame:
    """Expected outcomes of each pitch type thrown in a state."""
    return _by_volume(state_rates(summary, filter_pitch_state(**state), min_pitches).drop("plate_appearances"))


def next_pitch(
    transitions: DataFrame,
    balls: int,
    strikes: int,
    prev_pitch_type: str,
    perspective: str = "pitcher",
    min_transitions: int = 1,
    **state,
) -> DataFrame:
    """Probability and outcome rates of the next pitch given count and last pitch."""
    where = filter_pitch_state(
        balls=balls, strikes=strikes, prev_pitch_type=prev_pitch_type, perspective=perspective, **state
    )
    found = (
        transitions.filter(where)
        .groupBy("next_pitch_type")
        .agg(
            F.sum("transitions").alias("transitions"),
            *_share_of(
                "transitions",
                {
                    "whiff_pct": "next_pitch_whiffs",
                    "called_strike_pct": "next_pitch_called_strikes",
                    "ball_pct": "next_pitch_balls",
                    "in_play_pct": "next_pitch_in_play",
                    "hit_event_pct": "next_pitch_hits",
                    "walk_event_pct": "next_pitch_walks",
                    "strikeout_event_pct": "next_pitch_strikeouts",
                },
            ),
        )
        .filter(F.col("transitions") >= min_transitions)
    )
    total = F.sum("transitions").over(W.partitionBy())
    return _by_volume(
        found.withColumn("probability", rnd(ratio(F.col("transitions"), total))), "transitions", "next_pitch_type"
    )
