"""Materialised pitch-state and pitch-transition summaries.

Every summary is a fold of tallies: counts and sums that add up over dates.  A
plate appearance is counted on the date of its first pitch, which makes even the
number of appearances additive.  Tallies can therefore be kept per date and
replaced for some dates only; ``fold`` turns any number of dates into the summary.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.functions import keys, vocab
from dugout.operators.rollup import next_pitches
from dugout.schemas import LEAGUE_PITCH_STATE, PITCH_TRANSITIONS, PLAYER_PITCH_STATE, conform, tally_schema

STATE = ("game_type", "balls", "strikes", "outs_when_up", "stand", "p_throws")

#: What a pitch counts for, a bit each.
_EVENTS = (
    "ball_events", "called_strikes", "whiffs", "fouls", "balls_in_play", "hit_events", "walk_events", "strikeout_events",
)
_SUMS = {"woba": "woba_value", "xwoba": "estimated_woba_using_speedangle"}
STATE_TALLIES = ("pitches", "plate_appearances", *_EVENTS, *(f"{name}_{part}" for name in _SUMS for part in ("sum", "n")))
_NEXT = {
    "next_pitch_whiffs": "whiffs", "next_pitch_called_strikes": "called_strikes", "next_pitch_balls": "ball_events",
    "next_pitch_in_play": "balls_in_play", "next_pitch_hits": "hit_events", "next_pitch_walks": "walk_events",
    "next_pitch_strikeouts": "strikeout_events",
}
#: Parts that the rows of a group are dealt into.
PARTS = 16
TRANSITION_TALLIES = ("transitions", *_NEXT)


def _kinds() -> Column:
    """The events a pitch counts for as bits, so that it shuffles as one number."""
    description, event = F.col("description"), F.col("events")
    tests = (
        vocab.is_ball(description), vocab.is_called_strike(description), vocab.is_whiff_wide(description), vocab.is_foul(description),
        vocab.is_in_play(description, F.col("type")), vocab.is_hit(event), vocab.is_walk(event), vocab.is_strikeout(event),
    )
    bits = F.lit(0)
    for i, test in enumerate(tests):
        bits = bits.bitwiseOR(F.when(test, 1 << i).otherwise(0))
    return bits.alias("kinds")


def _has(event: str, kinds: str = "kinds") -> Column:
    return F.col(kinds).bitwiseAND(F.lit(1 << _EVENTS.index(event))) != 0


def _dealt(rows: DataFrame) -> DataFrame:
    """Pitches dealt by state and pitch type, which every group of a state summary holds, and part of it, by appearance."""
    part = F.pmod(F.hash("game_pk", "at_bat_number"), F.lit(PARTS))
    return rows.withColumn("_part", part).repartition("season", *STATE, "pitch_type", "_part")


def _grouped(rows: DataFrame, by: list[str], place: dict[str, Column] | None) -> GroupedData:
    """Rows by group; with ``place``, which a group tells, the groups of a place are whole in one task."""
    return rows.withColumns(place).repartition(*place).groupBy(*by, *place) if place else rows.groupBy(*by)


def _state_tallies(
    rows: DataFrame, dims: list[str], labels: list[str], merged: list[str], place: dict[str, Column] | None = None
) -> DataFrame:
    """Tallies per group and label.

    The first pitch of an appearance within its group, whatever the date, is marked
    in a window, so that appearances are a plain count.  Rows come dealt by state and
    part of it, by appearance, which spreads a frequent group.  Labels ride along as
    grouping columns, since text in an aggregation buffer would force sorting all rows;
    those that are ``merged`` to the largest find the rows in the window's order, by group, and
    need no sort, so that every row is shuffled and sorted once and only combined ones again.
    """
    group = [c for c in dims if c != "game_date"]
    met = Window.partitionBy(*group, "_part", "game_pk", "at_bat_number").orderBy("game_date" if "game_date" in dims else "at_bat_number")
    marked = rows.withColumn("_opens", F.row_number().over(met) == 1)
    if place:
        marked = marked.drop("_part", "game_pk", "at_bat_number")
    return _grouped(marked, [*dims, *labels], place).agg(
        *[F.max(label).alias(label) for label in merged],
        F.count(F.lit(1)).alias("pitches"),
        F.count_if("_opens").alias("plate_appearances"),
        *[F.count_if(_has(event)).alias(event) for event in _EVENTS],
        *[measure.alias(f"{name}_{part}") for name, c in _SUMS.items() for part, measure in (("sum", F.sum(c)), ("n", F.count(c)))],
    )


def _both_perspectives(df: DataFrame, extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Each row once for its batter and once for its pitcher, from one scan."""
    extra = extra or {}
    views = [
        F.struct(
            F.lit(role).alias("perspective"),
            F.col(f"{role}_id").alias("player_id"),
            *[F.col(pair[i]).alias(name) for name, pair in extra.items()],
        )
        for i, role in enumerate(("batter", "pitcher"))
    ]
    others = [c for c in df.columns if c not in {"batter_id", "pitcher_id"} | {p for pair in extra.values() for p in pair}]
    return (
        df.select(*others, F.explode(F.array(*views)).alias("_view"))
        .select(*others, "_view.*")
        .filter("player_id IS NOT NULL")
    )


def _league_rows(pitches: DataFrame) -> DataFrame:
    return _dealt(
        pitches.select("season", "game_date", *STATE, "pitch_type", "pitch_name", "game_pk", "at_bat_number", *_SUMS.values(), _kinds())
    )


def _player_rows(pitches: DataFrame) -> DataFrame:
    needed = pitches.select(
        "season", "game_date", *STATE, "pitch_type", "pitch_name", "game_pk", "at_bat_number", *_SUMS.values(), "batter_id",
        "pitcher_id", "batter_team", "pitcher_team", _kinds(),
    )
    # Dealt before they are seen from both sides, pitches are shuffled once.
    return _both_perspectives(_dealt(needed), {"team": ("batter_team", "pitcher_team")})


def _transition_rows(pitches: DataFrame) -> DataFrame:
    """Pairs of pitches; the following one is taken before pitches of unknown type are dropped, so such a one breaks the pair."""
    needed = pitches.select(
        "season", "game_date", *STATE, "game_pk", "at_bat_number", "pitch_number", "batter_id", "pitcher_id",
        F.col("pitch_type").alias("prev_pitch_type"), _kinds(),
    )
    stepped = next_pitches(needed, {"next_pitch_type": ("prev_pitch_type", 1), "next_kinds": ("kinds", 1)})
    pairs = stepped.filter("prev_pitch_type IS NOT NULL AND next_pitch_type IS NOT NULL")
    return _both_perspectives(pairs.drop("game_pk", "at_bat_number", "pitch_number", "kinds"))


def _transition_tallies(
    rows: DataFrame, dims: list[str], labels: list[str], merged: list[str], place: dict[str, Column] | None = None
) -> DataFrame:
    return _grouped(rows, [*dims, *labels], place).agg(
        *[F.max(label).alias(label) for label in merged],
        F.count(F.lit(1)).alias("transitions"),
        *[F.count_if(_has(event, "next_kinds")).alias(name) for name, event in _NEXT.items()],
    )


@dataclass(frozen=True)
class Summary:
    """A summary as a fold of tallies."""

    schema: T.StructType
    dims: tuple[str, ...]
    labels: tuple[str, ...]
    measures: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    count: Callable[..., DataFrame]

    def tallies(self, pitches: DataFrame, place: dict[str, Column] | None = None) -> DataFrame:
        """Tallies per date and group, which a later delivery of a date replaces.

        ``place``: columns of the dimensions and the date by which they are
        dealt to the tasks that combine them, for a writer that needs them so.
        """
        dims = [*self.dims, "game_date"]
        return conform(self.count(self.rows(pitches), dims, list(self.labels), [], place), tally_schema(self.schema))

    def group_hash(self) -> Column:
        return F.hash(*self.dims)

    def fold(self, tallies: DataFrame) -> DataFrame:
        """The summary of tallies; sums are divided once, here.  A group was updated when its newest tally was."""
        stamp = [F.max("updated_at").alias("updated_at")] if "updated_at" in tallies.columns else []
        summed = tallies.groupBy(*self.dims).agg(
            *[F.max(label).alias(label) for label in self.labels], *[F.sum(c).alias(c) for c in self.measures], *stamp
        )
        return self._rated(summed)

    def _rated(self, summed: DataFrame) -> DataFrame:
        """Sums of whole groups in the form of the summary."""
        means = {
            mean: F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n").cast("double"))
            for mean, name in (("avg_woba_value", "woba"), ("avg_xwoba", "xwoba"))
            if f"{name}_sum" in self.measures
        }
        schema = T.StructType([*self.schema.fields, T.StructField("updated_at", T.TimestampType())]) if "updated_at" in summed.columns else self.schema
        return conform(summed.withColumns(means | {"row_key": keys.row_key(*self.dims)}), schema)

    def of(self, pitches: DataFrame) -> DataFrame:
        """The summary of pitches in one go, whatever their dates."""
        return self._rated(self.count(self.rows(pitches), list(self.dims), [], list(self.labels)))


_PLAYER = ("season", "perspective", "player_id")
SUMMARIES = {
    "league_pitch_state_summary": Summary(
        LEAGUE_PITCH_STATE, ("season", *STATE, "pitch_type"), ("pitch_name",), STATE_TALLIES, _league_rows, _state_tallies
    ),
    "player_pitch_state_summary": Summary(
        PLAYER_PITCH_STATE, (*_PLAYER, *STATE, "pitch_type"), ("team", "pitch_name"), STATE_TALLIES, _player_rows, _state_tallies
    ),
    "pitch_transition_summary": Summary(
        PITCH_TRANSITIONS, (*_PLAYER, *STATE, "prev_pitch_type", "next_pitch_type"), (), TRANSITION_TALLIES, _transition_rows, _transition_tallies
    ),
}


def league_pitch_state(pitches: DataFrame) -> DataFrame:
    """Counts and mean values per season, game type, state, hands and pitch type."""
    return SUMMARIES["league_pitch_state_summary"].of(pitches)


def player_pitch_state(pitches: DataFrame) -> DataFrame:
    """The league summary per player, seen as batter and as pitcher."""
    return SUMMARIES["player_pitch_state_summary"].of(pitches)


def pitch_transitions(pitches: DataFrame) -> DataFrame:
    """What follows each pitch type in a state, per player and perspective."""
    return SUMMARIES["pitch_transition_summary"].of(pitches)
