"""Player names, attributes and teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.functions import keys

ROLES = {"batter": ("batter_id", "batter_team", "Batter"), "pitcher": ("pitcher_id", "pitcher_team", "Pitcher")}


def role_columns(role: str) -> tuple[str, str, str]:
    """Id column, team column and label of ``batter`` or ``pitcher``."""
    if role not in ROLES:
        raise ValueError("role must be batter or pitcher")
    return ROLES[role]


def resolve_names(ids: DataFrame, names: DataFrame, profiles: DataFrame) -> DataFrame:
    """Full name per id: the name table first, the profile table where it has none."""
    full = F.concat_ws(" ", keys.title_case(F.col("name_first")), keys.title_case(F.col("name_last")))
    first_source = names.groupBy(F.col("key_mlbam").alias("player_id")).agg(F.max(full).alias("looked_up"))
    second_source = profiles.groupBy("player_id").agg(F.max("full_name").alias("profile_name"))
    return (
        ids.select("player_id")
        .join(first_source, "player_id", "left")
        .join(second_source, "player_id", "left")
        .select("player_id", F.coalesce("looked_up", "profile_name").alias("full_name"))
    )


def _in_game() -> Column:
    """Place of a pitch within its game as one long."""
    return F.shiftleft(F.coalesce(F.col("at_bat_number"), F.lit(0)).cast("long"), 31) + F.coalesce(F.col("pitch_number"), F.lit(0))


def player_traits(pitches: DataFrame) -> DataFrame:
    """Position, latest throwing and batting hand and latest recorded team per player.

    One scan feeds both roles.  Pitching comes first for the team, as a player who
    ever pitched is a pitcher.  Pitches fold to one row per player, game and
    set of values, with their last place as one long, so that no text is compared
    or sorted per pitch.
    """
    seen = F.explode(
        F.array(
            F.struct(
                F.lit("P").alias("position"),
                F.col("pitcher_id").alias("player_id"),
                F.col("p_throws").alias("throws"),
                F.lit(None).cast("string").alias("bats"),
                F.col("pitcher_team").alias("team"),
            ),
            F.struct(
                F.lit("B").alias("position"),
                F.col("batter_id").alias("player_id"),
                F.lit(None).cast("string").alias("throws"),
                F.col("stand").alias("bats"),
                F.col("batter_team").alias("team"),
            ),
        )
    )
    values = ("position", "throws", "bats", "team")
    rows = pitches.select(seen.alias("s"), "game_date", "game_pk", _in_game().alias("place")).select("s.*", "game_date", "game_pk", "place")
    games = rows.filter("player_id IS NOT NULL").groupBy("player_id", "game_date", "game_pk", *values).agg(F.max("place").alias("place"))
    last = F.struct("game_date", "game_pk", "place")

    def latest(value: Column, extra: Column | None = None) -> Column:
        present = value.isNotNull() if extra is None else value.isNotNull() & extra
        return F.max_by(value, F.when(present, last))

    team = F.col("team")
    return games.groupBy("player_id").agg(
        F.when(F.bool_or(F.col("position") == "P"), "P").otherwise("B").alias("position"),
        latest(F.col("throws")).alias("throws"),
        latest(F.col("bats")).alias("bats"),
        F.coalesce(latest(team, F.col("position") == "P"), latest(team, F.col("position") == "B")).alias("team"),
    )


def enrich_players(players: DataFrame, pitches: DataFrame, names: DataFrame, profiles: DataFrame) -> DataFrame:
    """Fill attributes of unnamed players; named players pass through unchanged.

    Order of preference: names from the name table, then the profile; hands,
    position and team from the pitches, then the profile, then what is stored.
    """
    stubs = players.filter("full_name IS NULL").select("player_id")
    resolved = resolve_names(stubs, names, profiles).withColumnRenamed("full_name", "new_name")
    seen = player_traits(pitches).select(
        "player_id",
        F.lit(True).alias("seen"),
        *[F.col(c).alias(f"seen_{c}") for c in ("bats", "throws", "position", "team")],
    )
    profile = profiles.groupBy("player_id").agg(
        *[F.max(c).alias(f"profile_{c}") for c in ("bats", "throws", "position")]
    )
    named_in_first = names.select(F.col("key_mlbam").alias("player_id")).distinct()
    fallback = profile.join(named_in_first, "player_id", "left_anti")
    joined = (
        players.join(resolved, "player_id", "left")
        .join(seen, "player_id", "left")
        .join(fallback, "player_id", "left")
    )
    stub = F.col("full_name").isNull() & F.coalesce(F.col("seen"), F.lit(False))

    def fill(name: str, *candidates: str) -> Column:
        return F.when(stub, F.coalesce(*candidates, name)).otherwise(F.col(name)).alias(name)

    return joined.select(
        "player_id",
        fill("full_name", "new_name"),
        fill("bats", "seen_bats", "profile_bats"),
        fill("throws", "seen_throws", "profile_throws"),
        fill("position", "seen_position", "profile_position"),
        fill("team", "seen_team"),
    )


def latest_recorded_team(pitches: DataFrame) -> DataFrame:
    """Latest non-null recorded team per player: as a pitcher where there is one, else as a batter."""
    return player_traits(pitches).filter("team IS NOT NULL").select("player_id", "team")


def refresh_player_teams(players: DataFrame, pitches: DataFrame) -> DataFrame:
    """Players with their latest team, and whether it changed."""
    latest = latest_recorded_team(pitches).withColumnRenamed("team", "latest")
    joined = players.join(latest, "player_id", "left")
    changed = F.col("latest").isNotNull() & ~F.col("team").eqNullSafe(F.col("latest"))
    return joined.select(
        *[
            (F.when(changed, F.col("latest")).otherwise(F.col("team")) if c == "team" else F.col(c)).alias(c)
            for c in players.columns
        ],
        changed.alias("team_changed"),
    )


def with_derived_teams(pitches: DataFrame, games: DataFrame) -> DataFrame:
    """Pitches with ``derived_batter_team`` and ``derived_pitcher_team``."""
    sides = games.select("game_pk", F.col("home_team").alias("_home"), F.col("away_team").alias("_away"))
    home, away, top = F.col("_home"), F.col("_away"), F.col("inning_half")
    return (
        pitches.join(sides, "game_pk", "left")
        .withColumns(
            {
                "derived_batter_team": keys.batter_team(F.col("batter_team"), top, home, away),
                "derived_pitcher_team": keys.pitcher_team(F.col("pitcher_team"), top, home, away),
            }
        )
        .drop("_home", "_away")
    )


def player_appearances(pitches: DataFrame, games: DataFrame, role: str) -> DataFrame:
    """Pitches and newest non-null derived team of every player in a role.

    Pitches fold to one row per player, game, half and recorded team before the
    games are joined; position within a game packs into one long so that the fold
    stays a fixed-width hash aggregation.
    """
    player, team, _ = role_columns(role)
    folded = (
        pitches.filter(F.col(player).isNotNull())
        .groupBy(F.col(player).alias("player_id"), "game_date", "game_pk", "inning_half", team)
        .agg(F.max(_in_game()).alias("position"), F.count(F.lit(1)).alias("pitches"))
    )
    derived = F.col(f"derived_{team}")
    other = ({"batter_team", "pitcher_team"} - {team}).pop()
    derivable = with_derived_teams(folded.withColumn(other, F.lit(None).cast("string")), games)
    newest = F.when(derived.isNotNull(), F.struct("game_date", "game_pk", "position"))
    return derivable.groupBy("player_id").agg(
        F.max_by(derived, newest).alias("latest_team"), F.sum("pitches").alias("pitches")
    )


def player_latest_team(pitches: DataFrame, games: DataFrame, role: str) -> DataFrame:
    """Newest non-null derived team of every player in a role."""
    seen = player_appearances(pitches, games, role)
    return seen.filter("latest_team IS NOT NULL").select("player_id", "latest_team")


def name_players(df: DataFrame, players: DataFrame, role: str, as_column: str | None = None) -> DataFrame:
    """Add the display name of the player in a role."""
    player, _, label = role_columns(role)
    names = players.select(F.col("player_id").alias(player), F.col("full_name").alias("_full_name"))
    return (
        df.join(names, player, "left")
        .withColumn(as_column or f"{role}_name", keys.display_name(F.col("_full_name"), label, F.col(player)))
        .drop("_full_name")
    )
