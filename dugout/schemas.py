"""Table schemas, and projection of any frame onto one of them.

Measurements are doubles.  ``game_pk`` is a long: at cluster scale the number of
games outgrows an int.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema of ``name type`` pairs; needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PLAYERS = _schema(
    "player_id int, full_name string, bats string, throws string, position string, team string"
)
GAMES = _schema(
    "game_pk bigint, game_date date, home_team string, away_team string, venue string, game_type string, season int"
)
PITCHES = _schema(
    "pitch_id string, game_pk bigint, at_bat_number int, pitch_number int,"
    "pitcher_id int, batter_id int, pitcher_team string, batter_team string, stand string, p_throws string,"
    "inning int, inning_half string, outs_when_up int, balls int, strikes int,"
    "on_1b int, on_2b int, on_3b int, base_state string,"
    "pitch_type string, pitch_name string, game_type string,"
    "release_speed double, release_spin_rate double, release_extension double,"
    "release_pos_x double, release_pos_z double, pfx_x double, pfx_z double, plate_x double, plate_z double,"
    "sz_top double, sz_bot double, description string, zone int, type string,"
    "launch_speed double, launch_angle double, hit_distance_sc double, hc_x double, hc_y double, bb_type string,"
    "events string, estimated_ba_using_speedangle double, estimated_woba_using_speedangle double,"
    "woba_value double, woba_denom int, launch_speed_angle int, game_date date, season int"
)
AT_BATS = _schema(
    "at_bat_id string, game_pk bigint, at_bat_number int, pitcher_id int, batter_id int, stand string,"
    "p_throws string, inning int, inning_half string, outs_at_start int, on_1b int, on_2b int, on_3b int,"
    "base_state string, pitch_count bigint, final_balls int, final_strikes int, final_count string,"
    "reached_2strike boolean, reached_3ball boolean, reached_full boolean, final_event string,"
    "final_pitch_type string, game_type string, xwoba double, woba_value double, game_date date, season int"
)
INGESTION_LOG = _schema(
    "run_id bigint, start_date date, end_date date, rows_loaded bigint, status string, run_at timestamp"
)
BACKFILL_STATUS = _schema(
    "season int, expected_start_date date, expected_end_date date, loaded_rows bigint, completed boolean,"
    "completed_at timestamp, updated_at timestamp"
)

_STATE_DIMS = "game_type string, balls int, strikes int, outs_when_up int, stand string, p_throws string,"
_STATE_MEASURES = (
    "pitches bigint, plate_appearances bigint, ball_events bigint, called_strikes bigint, whiffs bigint,"
    "fouls bigint, balls_in_play bigint, hit_events bigint, walk_events bigint, strikeout_events bigint,"
    "avg_woba_value double, avg_xwoba double"
)
LEAGUE_PITCH_STATE = _schema(
    f"row_key string, season int, {_STATE_DIMS} pitch_type string, pitch_name string, {_STATE_MEASURES}"
)
PLAYER_PITCH_STATE = _schema(
    f"row_key string, season int, perspective string, player_id int, team string, {_STATE_DIMS}"
    f"pitch_type string, pitch_name string, {_STATE_MEASURES}"
)
PITCH_TRANSITIONS = _schema(
    f"row_key string, season int, perspective string, player_id int, {_STATE_DIMS}"
    "prev_pitch_type string, next_pitch_type string, transitions bigint, next_pitch_whiffs bigint,"
    "next_pitch_called_strikes bigint, next_pitch_balls bigint, next_pitch_in_play bigint,"
    "next_pitch_hits bigint, next_pitch_walks bigint, next_pitch_strikeouts bigint"
)

_STAT_HEAD = "row_key string, season int, player_id_fangraphs int, player_name string, team string, age int,"
BATTING_STANDARD = _schema(
    _STAT_HEAD + "g int, ab int, pa int, h int, singles int, doubles int, triples int, hr int, r int, rbi int,"
    "bb int, ibb int, so int, hbp int, sf int, sh int, gdp int, sb int, cs int, avg double, obp double,"
    "slg double, ops double, iso double, babip double, bb_pct double, k_pct double, stats_json string"
)
BATTING_VALUE = _schema(
    _STAT_HEAD + "woba double, wraa double, wrc double, wrc_plus double, bsr double, off_value double,"
    "def_value double, war double, wpa double, re24 double, rar double, dollars double, stats_json string"
)
PITCHING_STANDARD = _schema(
    _STAT_HEAD + "w int, l int, era double, g int, gs int, cg int, sho int, sv int, bs int, ip double, tbf int,"
    "h int, r int, er int, hr int, bb int, ibb int, hbp int, wp int, bk int, so int, k_per_9 double,"
    "bb_per_9 double, k_per_bb double, avg double, whip double, babip double, lob_pct double, fip double,"
    "stats_json string"
)
PITCHING_VALUE = _schema(
    _STAT_HEAD + "war double, rar double, dollars double, xfip double, siera double, wpa double, re24 double,"
    "era_minus double, fip_minus double, k_pct double, bb_pct double, lob_pct double, stats_json string"
)

TABLES = {
    "players": PLAYERS,
    "games": GAMES,
    "pitches": PITCHES,
    "at_bats": AT_BATS,
    "league_pitch_state_summary": LEAGUE_PITCH_STATE,
    "player_pitch_state_summary": PLAYER_PITCH_STATE,
    "pitch_transition_summary": PITCH_TRANSITIONS,
    "batting_standard_stats": BATTING_STANDARD,
    "batting_value_stats": BATTING_VALUE,
    "pitching_standard_stats": PITCHING_STANDARD,
    "pitching_value_stats": PITCHING_VALUE,
    "ingestion_log": INGESTION_LOG,
    "season_backfill_status": BACKFILL_STATUS,
}


def tally_schema(summary: T.StructType) -> T.StructType:
    """Schema of a summary's tallies: per date, with sums and numbers of values in place of means."""
    fields = []
    for field in summary.fields:
        if field.name.startswith("avg_"):
            stem = field.name.removeprefix("avg_").removesuffix("_value")
            fields += [T.StructField(f"{stem}_sum", T.DoubleType()), T.StructField(f"{stem}_n", T.LongType())]
        elif field.name != "row_key":
            fields.append(field)
    return T.StructType([*fields, T.StructField("game_date", T.DateType())])


CORE_TABLES = ("players", "games", "pitches", "at_bats")
SUMMARY_TABLES = ("league_pitch_state_summary", "player_pitch_state_summary", "pitch_transition_summary")
#: Tallies per date that a summary is folded from.
TALLIES = {name: f"{name}_by_date" for name in SUMMARY_TABLES}
TABLES |= {tally: tally_schema(TABLES[name]) for name, tally in TALLIES.items()}
STAT_TABLES = ("batting_standard_stats", "batting_value_stats", "pitching_standard_stats", "pitching_value_stats")
#: Stored with ``updated_at``, when a row was last written with new values.
STAMPED = ("players", *SUMMARY_TABLES, *TALLIES.values(), *STAT_TABLES)
SEASON_TABLES = ("pitches", "at_bats", "games") + SUMMARY_TABLES + STAT_TABLES


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a schema: cast what is there, NULL for what is absent."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
