"""Event and description vocabularies, and the predicates over them.

The value sets are fixed values of the data model: they must match the source
feed for results to be right, so they are stated here once, in plain order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
HIT_EVENTS = ("single", "double", "triple", "home_run")
WALK_EVENTS = ("walk", "intent_walk")
STRIKEOUT_EVENTS = ("strikeout", "strikeout_double_play")
AB_EXCLUDED_EVENTS = ("walk", "intent_walk", "hit_by_pitch", "sac_fly", "sac_bunt", "catcher_interf")
BALL_DESCRIPTIONS = ("ball", "blocked_ball", "hit_by_pitch", "pitchout")
STRIKE_DESCRIPTIONS = ("called_strike", "swinging_strike", "swinging_strike_blocked", "foul_tip", "missed_bunt")
FOUL_DESCRIPTIONS = ("foul", "foul_bunt", "foul_pitchout")
WHIFF_WIDE = ("swinging_strike", "swinging_strike_blocked", "foul_tip", "missed_bunt")
WHIFF_NARROW = ("swinging_strike", "swinging_strike_blocked")
CSW_WIDE = ("called_strike", "swinging_strike", "swinging_strike_blocked", "foul", "foul_tip")
CONTACT_DESCRIPTIONS = ("foul", "foul_tip", "hit_into_play")
REGULAR_GAME_TYPES = ("R",)
POSTSEASON_GAME_TYPES = ("F", "D", "L", "W")
SUPPORTED_GAME_TYPES = REGULAR_GAME_TYPES + POSTSEASON_GAME_TYPES
FIRST_SEASON = 2015
SHORT_SEASON = 2020
FULL_SEASON_GAMES = 2430
SHORT_SEASON_GAMES = 898
PITCH_TYPE_LABELS = {
    "FF": "4-Seam Fastball",
    "FT": "2-Seam Fastball",
    "SI": "Sinker",
    "FC": "Cutter",
    "FS": "Splitter",
    "FO": "Forkball",
    "FA": "Fastball",
    "SL": "Slider",
    "ST": "Sweeper",
    "SV": "Slurve",
    "CU": "Curveball",
    "KC": "Knuckle Curve",
    "CS": "Slow Curve",
    "CH": "Changeup",
    "SC": "Screwball",
    "EP": "Eephus",
    "KN": "Knuckleball",
}
# --------------------------------------------------------------------------


def is_hit(event: Column) -> Column:
    return event.isin(*HIT_EVENTS)


def is_walk(event: Column) -> Column:
    return event.isin(*WALK_EVENTS)


def is_strikeout(event: Column) -> Column:
    return event.isin(*STRIKEOUT_EVENTS)


def is_home_run(event: Column) -> Column:
    return event == "home_run"


def is_at_bat(event: Column) -> Column:
    """Event that counts as an official at-bat; a NULL event does not."""
    return ~event.isin(*AB_EXCLUDED_EVENTS)


def total_bases(event: Column) -> Column:
    return (
        F.when(event == "single", 1)
        .when(event == "double", 2)
        .when(event == "triple", 3)
        .when(event == "home_run", 4)
        .otherwise(0)
    )


def is_ball(description: Column) -> Column:
    return description.isin(*BALL_DESCRIPTIONS)


def is_called_strike(description: Column) -> Column:
    return description == "called_strike"


def is_foul(description: Column) -> Column:
    return description.isin(*FOUL_DESCRIPTIONS)


def is_whiff_wide(description: Column) -> Column:
    """Missed swings including foul tips and missed bunts (the summaries' rule)."""
    return description.isin(*WHIFF_WIDE)


def is_whiff(description: Column) -> Column:
    """Missed swings in the narrow sense (the query library's rule)."""
    return description.isin(*WHIFF_NARROW)


def is_swing(description: Column) -> Column:
    return description.contains("swing") | (description == "foul")


def is_csw_wide(description: Column) -> Column:
    return description.isin(*CSW_WIDE)


def is_in_play(description: Column, pitch_result: Column) -> Column:
    return (description == "hit_into_play") | (pitch_result == "X")


def is_contact(bb_type: Column, description: Column) -> Column:
    return bb_type.isNotNull() | description.isin(*CONTACT_DESCRIPTIONS)


def outcome(description: Column) -> Column:
    """Ball / strike / foul class of a pitch; NULL for anything else."""
    return (
        F.when(is_ball(description), "ball")
        .when(description.isin(*STRIKE_DESCRIPTIONS), "strike")
        .when(is_foul(description), "foul")
    )


def season_games(season: Column) -> Column:
    """Regular-season games a full schedule holds."""
    return F.when(season == SHORT_SEASON, SHORT_SEASON_GAMES).otherwise(FULL_SEASON_GAMES)
