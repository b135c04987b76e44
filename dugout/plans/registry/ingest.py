"""Cleaning, keys, filters, upserts, rollup and player dimensions."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions import keys
from dugout.operators import clean, players, rollup, season_stats
from dugout.operators.filters import Window, filter_pitch_state, filter_pitches
from dugout.plans import fixture
from dugout.plans.registry.base import query


@query("clean_pitches", "SELECT * FROM cleaned", "cleaned")
def clean_pitches(lake):
    return clean.clean_pitches(lake.raw)


@query(
    "base_state",
    """SELECT base_state, on_1b IS NOT NULL AS first_base, on_2b IS NOT NULL AS second_base, on_3b IS NOT NULL AS third_base,
       COUNT(*) AS pitches FROM cleaned GROUP BY ALL""",
    "cleaned",
)
def base_state(lake):
    bases = [F.col(c) for c in ("on_1b", "on_2b", "on_3b")]
    return lake.raw.groupBy(
        keys.base_state(*bases).alias("base_state"),
        *[b.isNotNull().alias(f"{label}_base") for b, label in zip(bases, ("first", "second", "third"))],
    ).agg(F.count(F.lit(1)).alias("pitches"))


@query(
    "supported_games",
    "SELECT game_type, COUNT(*) AS pitches, COUNT(DISTINCT game_pk) AS games FROM pitches GROUP BY game_type",
    "pitches",
)
def supported_games(lake):
    return (
        clean.supported_games(lake.raw)
        .groupBy("game_type")
        .agg(F.count(F.lit(1)).alias("pitches"), F.count_distinct("game_pk").alias("games"))
    )


@query(
    "upsert",
    """SELECT pitch_id, season, CASE WHEN pitch_number % 2 = 0 THEN 'corrected' ELSE description END AS description
       FROM pitches WHERE NOT (pitch_number % 2 = 1 AND at_bat_number % 5 = 0)
       UNION ALL
       SELECT concat(pitch_id, '_new'), season, 'added' FROM pitches WHERE pitch_number = 1""",
    "pitches",
)
def upsert(lake):
    columns = ["pitch_id", "season", "description"]
    stored = lake.pitches.filter("NOT (pitch_number % 2 = 1 AND at_bat_number % 5 = 0)").select(*columns)
    corrected = lake.pitches.filter("pitch_number % 2 = 0").select(*columns).withColumn("description", F.lit("corrected"))
    added = (
        lake.pitches.filter("pitch_number = 1")
        .select(*columns)
        .withColumns({"pitch_id": F.concat("pitch_id", F.lit("_new")), "description": F.lit("added")})
    )
    return clean.upsert(stored, corrected.unionByName(added), ["season", "pitch_id"])


@query(
    "insert_ignore",
    """SELECT player_id, full_name FROM players WHERE player_id % 3 = 0
       UNION ALL SELECT player_id, NULL FROM stubs WHERE player_id % 3 <> 0""",
    "players",
    "stubs",
)
def insert_ignore(lake):
    stored = lake.players.filter("player_id % 3 = 0").select("player_id", "full_name")
    return clean.insert_ignore(stored, clean.player_stubs(lake.pitches), ["player_id"])


@query("player_stubs", "SELECT player_id FROM stubs", "stubs")
def player_stubs(lake):
    return clean.player_stubs(lake.pitches)


@query("games_dim", "SELECT * FROM games", "games")
def games_dim(lake):
    return clean.games_dim(clean.supported_games(clean.clean_pitches(lake.raw)))


@query(
    "dedupe_pitches",
    """SELECT pitch_id, game_pk, at_bat_number, pitch_number, description, min(release_speed) AS release_speed FROM (
         SELECT pitch_id, game_pk, at_bat_number, pitch_number, description, release_speed FROM pitches
         UNION ALL
         SELECT pitch_id, game_pk, at_bat_number, pitch_number, description, release_speed - 1 FROM pitches
         WHERE pitch_number % 2 = 0) u
       GROUP BY ALL""",
    "pitches",
)
def dedupe_pitches(lake):
    columns = ["pitch_id", "game_pk", "at_bat_number", "pitch_number", "description", "release_speed"]
    once = lake.pitches.select(*columns)
    again = once.filter("pitch_number % 2 = 0").withColumn("release_speed", F.col("release_speed") - 1)
    return clean.dedupe_pitches(once.unionByName(again), [F.asc_nulls_last("release_speed")])


def _batting_feed(lake) -> DataFrame:
    c = F.col("c_custkey")
    whole = lambda m, a=0: (c % m + a).cast("int")
    part = lambda m, d: ((c % m) / float(d)).cast("double")
    whole_columns = {
        "Age": whole(20, 20), "G": whole(162), "AB": whole(600), "PA": whole(700), "H": whole(200), "1B": whole(120),
        "2B": whole(40), "3B": whole(9), "HR": whole(50), "R": whole(110), "RBI": whole(120), "BB": whole(90),
        "IBB": whole(9), "SO": whole(190), "HBP": whole(12), "SF": whole(8), "SH": whole(5), "GDP": whole(20),
        "SB": whole(40), "CS": whole(11),
    }
    parts = {
        "AVG": part(32, 64), "OBP": part(40, 64), "SLG": part(60, 64), "OPS": part(100, 64), "ISO": part(30, 64),
        "BABIP": part(35, 64), "BB%": part(20, 128), "wOBA": part(50, 128), "wRAA": part(90, 2), "wRC": part(120, 1),
        "wRC+": part(180, 1), "BsR": part(16, 2), "Off": part(60, 2), "Def": part(40, 4), "WAR": part(20, 2),
        "WPA": part(9, 4), "RE24": part(50, 2), "RAR": part(70, 2),
    }
    return fixture.table(lake.spark, lake.sf_dir, "customer").select(
        F.when(c % 7 != 0, whole(100000, 1)).alias("IDfg"),
        F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(" "))).alias("Name"),
        F.when(c % 6 == 0, None).when(c % 6 == 1, " ").otherwise(F.concat(F.lit("T"), (c % 12).cast("string"))).alias("Team"),
        F.when(c % 9 == 0, None).otherwise(2019).cast("int").alias("Season"),
        *[v.alias(k) for k, v in whole_columns.items()],
        *[v.alias(k) for k, v in parts.items()],
    )


def _pitching_feed(lake) -> DataFrame:
    s = F.col("s_suppkey")
    whole = lambda m, a=0: (s % m + a).cast("int")
    part = lambda m, d: ((s % m) / float(d)).cast("double")
    whole_columns = {
        "Age": whole(20, 20), "W": whole(20), "L": whole(15), "G": whole(70), "GS": whole(33), "CG": whole(4),
        "ShO": whole(3), "SV": whole(40), "BS": whole(8), "TBF": whole(800), "H": whole(200), "R": whole(100),
        "ER": whole(90), "HR": whole(30), "BB": whole(80), "IBB": whole(6), "HBP": whole(12), "WP": whole(9),
        "BK": whole(3), "SO": whole(250),
    }
    parts = {
        "ERA": part(50, 8), "IP": part(400, 2), "K/9": part(30, 2), "BB/9": part(20, 4), "K/BB": part(16, 2),
        "AVG": part(32, 64), "WHIP": part(20, 8), "BABIP": part(30, 64), "LOB%": part(64, 64), "FIP": part(50, 8),
        "WAR": part(16, 2), "RAR": part(60, 2), "Dol": part(200, 4), "xFIP": part(50, 8), "SIERA": part(50, 16),
        "WPA": part(9, 4), "RE24": part(50, 2), "ERA-": part(150, 1), "FIP-": part(150, 1), "K%": part(30, 64),
        "BB%": part(15, 64),
    }
    return fixture.table(lake.spark, lake.sf_dir, "supplier").select(
        F.when(s % 7 != 0, whole(100000, 1)).alias("IDfg"),
        F.replace("s_name", F.lit("#"), F.lit(" ")).alias("Name"),
        F.when(s % 6 == 0, None).otherwise(F.concat(F.lit("T"), (s % 12).cast("string"))).alias("Team"),
        F.lit(2019).alias("Season"),
        *[v.alias(k) for k, v in whole_columns.items()],
        *[v.alias(k) for k, v in parts.items()],
    )


_BATTING_SQL = """
  SELECT CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 100000 + 1 AS INT) END AS IDfg,
    concat(' ', replace(c_name, '#', ' ')) AS Name,
    CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN ' ' ELSE concat('T', CAST(c_custkey % 12 AS VARCHAR)) END AS Team,
    CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(2019 AS INT) END AS Season,
""" + ",\n".join(
    [
        f'    CAST(c_custkey % {m} + {a} AS INT) AS "{k}"'
        for k, m, a in [
            ("Age", 20, 20), ("G", 162, 0), ("AB", 600, 0), ("PA", 700, 0), ("H", 200, 0), ("1B", 120, 0), ("2B", 40, 0),
            ("3B", 9, 0), ("HR", 50, 0), ("R", 110, 0), ("RBI", 120, 0), ("BB", 90, 0), ("IBB", 9, 0), ("SO", 190, 0),
            ("HBP", 12, 0), ("SF", 8, 0), ("SH", 5, 0), ("GDP", 20, 0), ("SB", 40, 0), ("CS", 11, 0),
        ]
    ]
    + [
        f'    (c_custkey % {m}) / {d}.0E0 AS "{k}"'
        for k, m, d in [
            ("AVG", 32, 64), ("OBP", 40, 64), ("SLG", 60, 64), ("OPS", 100, 64), ("ISO", 30, 64), ("BABIP", 35, 64),
            ("BB%", 20, 128), ("wOBA", 50, 128), ("wRAA", 90, 2), ("wRC", 120, 1), ("wRC+", 180, 1), ("BsR", 16, 2),
            ("Off", 60, 2), ("Def", 40, 4), ("WAR", 20, 2), ("WPA", 9, 4), ("RE24", 50, 2), ("RAR", 70, 2),
        ]
    ]
) + "\n  FROM customer"
_PITCHING_SQL = """
  SELECT CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 100000 + 1 AS INT) END AS IDfg,
    replace(s_name, '#', ' ') AS Name,
    CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE concat('T', CAST(s_suppkey % 12 AS VARCHAR)) END AS Team,
    CAST(2019 AS INT) AS Season,
""" + ",\n".join(
    [
        f'    CAST(s_suppkey % {m} + {a} AS INT) AS "{k}"'
        for k, m, a in [
            ("Age", 20, 20), ("W", 20, 0), ("L", 15, 0), ("G", 70, 0), ("GS", 33, 0), ("CG", 4, 0), ("ShO", 3, 0),
            ("SV", 40, 0), ("BS", 8, 0), ("TBF", 800, 0), ("H", 200, 0), ("R", 100, 0), ("ER", 90, 0), ("HR", 30, 0),
            ("BB", 80, 0), ("IBB", 6, 0), ("HBP", 12, 0), ("WP", 9, 0), ("BK", 3, 0), ("SO", 250, 0),
        ]
    ]
    + [
        f'    (s_suppkey % {m}) / {d}.0E0 AS "{k}"'
        for k, m, d in [
            ("ERA", 50, 8), ("IP", 400, 2), ("K/9", 30, 2), ("BB/9", 20, 4), ("K/BB", 16, 2), ("AVG", 32, 64),
            ("WHIP", 20, 8), ("BABIP", 30, 64), ("LOB%", 64, 64), ("FIP", 50, 8), ("WAR", 16, 2), ("RAR", 60, 2),
            ("Dol", 200, 4), ("xFIP", 50, 8), ("SIERA", 50, 16), ("WPA", 9, 4), ("RE24", 50, 2), ("ERA-", 150, 1),
            ("FIP-", 150, 1), ("K%", 30, 64), ("BB%", 15, 64),
        ]
    ]
) + "\n  FROM supplier"


def _stat_check(table: str, feed: str, absent: tuple[str, ...]) -> str:
    """SQL of one normalised stat table over a feed."""
    mapping, schema = season_stats.KINDS[table]
    kinds = {f.name: "INT" if f.dataType.simpleString() == "int" else "DOUBLE" for f in schema.fields}
    columns = [
        f"CAST({'NULL' if source in absent else chr(34) + source + chr(34)} AS {kinds[target]}) AS {target}"
        for target, source in mapping.items()
    ]
    present = [c for c in season_stats.IDENTITY + tuple(mapping.values()) if c not in absent]
    packed = "{" + ", ".join(f"'{c}': \"{c}\"" for c in present) + "}"
    return f"""
      SELECT concat_ws(':', '2019', COALESCE(CAST(IDfg AS VARCHAR), replace(trim(COALESCE(Name, '')), ' ', '_')),
          COALESCE(NULLIF(trim(Team), ''), 'NA')) AS row_key,
        COALESCE(Season, CAST(2019 AS INT)) AS season, IDfg AS player_id_fangraphs, Name AS player_name, Team AS team, Age AS age,
        {', '.join(columns)}, CAST(to_json({packed}) AS VARCHAR) AS stats_json
      FROM ({feed}) feed"""


@query("normalise_batting_standard", _stat_check("batting_standard_stats", _BATTING_SQL, ("K%",)))
def batting_standard(lake):
    return season_stats.normalise_season_stats(_batting_feed(lake), 2019, "batting_standard_stats")


@query("normalise_batting_value", _stat_check("batting_value_stats", _BATTING_SQL, ("Dol",)))
def batting_value(lake):
    return season_stats.normalise_season_stats(_batting_feed(lake), 2019, "batting_value_stats")


@query("normalise_pitching_standard", _stat_check("pitching_standard_stats", _PITCHING_SQL, ()))
def pitching_standard(lake):
    return season_stats.normalise_season_stats(_pitching_feed(lake), 2019, "pitching_standard_stats")


@query("normalise_pitching_value", _stat_check("pitching_value_stats", _PITCHING_SQL, ()))
def pitching_value(lake):
    return season_stats.normalise_season_stats(_pitching_feed(lake), 2019, "pitching_value_stats")


@query(
    "row_key",
    """SELECT concat_ws(':', CAST(season AS VARCHAR), COALESCE(pitch_type, 'NA'), COALESCE(events, 'NA')) AS row_key,
       COUNT(*) AS pitches FROM pitches GROUP BY 1""",
    "pitches",
)
def row_key(lake):
    return lake.pitches.groupBy(keys.row_key("season", "pitch_type", "events").alias("row_key")).agg(
        F.count(F.lit(1)).alias("pitches")
    )


_PITCH_FILTERS = {
    "season hides dates": (
        Window(season=2019, season_start=2015), dict(balls=1, strikes=1), "season = 2019 AND balls = 1 AND strikes = 1",
    ),
    "range": (
        Window(season_start=2017, season_end=2019), dict(outs=2, base_state="101", stand="R"),
        "season BETWEEN 2017 AND 2019 AND outs_when_up = 2 AND base_state = '101' AND stand = 'R'",
    ),
    "dates": (
        Window(start_date=date(2018, 4, 10), end_date=date(2018, 6, 30)), dict(p_throws="L", game_types=("R",)),
        "game_date BETWEEN DATE '2018-04-10' AND DATE '2018-06-30' AND p_throws = 'L' AND game_type IN ('R')",
    ),
    "player": (Window(), dict(pitcher_id=599970, pitch_type="SL"), "pitcher_id = 599970 AND pitch_type = 'SL'"),
    "batter": (Window(), dict(batter_id=600007), "batter_id = 600007"),
    "none": (Window(), {}, "TRUE"),
}


@query(
    "filter_pitches",
    " UNION ALL ".join(
        f"SELECT '{label}' AS filter, COUNT(*) AS pitches, COUNT(DISTINCT game_pk) AS games FROM pitches WHERE {where}"
        for label, (_, _, where) in _PITCH_FILTERS.items()
    ),
    "pitches",
)
def filter_pitches_query(lake):
    found = [
        lake.pitches.filter(filter_pitches(scope, **conditions))
        .agg(F.count(F.lit(1)).alias("pitches"), F.count_distinct("game_pk").alias("games"))
        .select(F.lit(label).alias("filter"), "*")
        for label, (scope, conditions, _) in _PITCH_FILTERS.items()
    ]
    return reduce(DataFrame.unionByName, found)


_STATE_FILTERS = {
    "batter": (
        "player_pitch_state_summary", "player_state",
        dict(season=2019, game_types=("R", "F"), perspective="batter", player_id=600007, balls=1),
        "season = 2019 AND game_type IN ('R','F') AND perspective = 'batter' AND player_id = 600007 AND balls = 1",
    ),
    "state": (
        "player_pitch_state_summary", "player_state", dict(strikes=2, outs=1, stand="L", p_throws="R", pitch_type="FF"),
        "strikes = 2 AND outs_when_up = 1 AND stand = 'L' AND p_throws = 'R' AND pitch_type = 'FF'",
    ),
    "after slider": (
        "pitch_transition_summary", "transitions", dict(prev_pitch_type="SL", perspective="pitcher", balls=0, strikes=1),
        "prev_pitch_type = 'SL' AND perspective = 'pitcher' AND balls = 0 AND strikes = 1",
    ),
}


@query(
    "filter_pitch_state",
    " UNION ALL ".join(
        f"SELECT '{label}' AS filter, COUNT(*) AS groups FROM {table} WHERE {where}"
        for label, (table, _, _, where) in _STATE_FILTERS.items()
    ),
    "player_pitch_state_summary",
    "pitch_transition_summary",
)
def filter_pitch_state_query(lake):
    found = [
        getattr(lake, attribute)
        .filter(filter_pitch_state(**conditions))
        .agg(F.count(F.lit(1)).alias("groups"))
        .select(F.lit(label).alias("filter"), "*")
        for label, (_, attribute, conditions, _) in _STATE_FILTERS.items()
    ]
    return reduce(DataFrame.unionByName, found)


_WINDOWS = {
    "career": (dict(window="career"), "season BETWEEN (SELECT min(season) FROM pitches) AND (SELECT max(season) FROM pitches)"),
    "last7": (
        dict(window="last7"),
        "game_date BETWEEN (SELECT max(game_date) - INTERVAL 6 DAY FROM pitches) AND (SELECT max(game_date) FROM pitches)",
    ),
    "swapped range": (dict(season_start=2019, season_end=2017), "season BETWEEN 2017 AND 2019"),
    "open range": (dict(season_start=2018), "season >= 2018"),
    "one season": (dict(season=2018), "season = 2018"),
    "latest": (dict(), "season = (SELECT max(season) FROM pitches)"),
}


@query(
    "resolve_window",
    " UNION ALL ".join(
        f"SELECT '{label}' AS time_window, COUNT(*) AS pitches, min(game_date) AS first_date, max(game_date) AS last_date"
        f" FROM pitches WHERE {where}"
        for label, (_, where) in _WINDOWS.items()
    ),
    "pitches",
)
def resolve_window_query(lake):
    found = [
        lake.pitches.filter(filter_pitches(lake.window(**request)))
        .agg(F.count(F.lit(1)).alias("pitches"), F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"))
        .select(F.lit(label).alias("time_window"), "*")
        for label, (request, _) in _WINDOWS.items()
    ]
    return reduce(DataFrame.unionByName, found)


@query("at_bat_rollup", "SELECT * FROM at_bats", "at_bats")
def at_bat_rollup(lake):
    return rollup.at_bat_rollup(lake.pitches)


@query(
    "enrich_players",
    """SELECT p.player_id,
         CASE WHEN p.full_name IS NULL THEN COALESCE(r.full_name, p.full_name) ELSE p.full_name END AS full_name,
         CASE WHEN p.full_name IS NULL THEN COALESCE(t.bats, CASE WHEN NOT r.in_names THEN f.bats END, p.bats) ELSE p.bats END AS bats,
         CASE WHEN p.full_name IS NULL THEN COALESCE(t.throws, CASE WHEN NOT r.in_names THEN f.throws END, p.throws) ELSE p.throws END AS throws,
         CASE WHEN p.full_name IS NULL THEN COALESCE(t.position, CASE WHEN NOT r.in_names THEN f.position END, p.position) ELSE p.position END AS position,
         CASE WHEN p.full_name IS NULL THEN COALESCE(t.team, p.team) ELSE p.team END AS team
       FROM players p JOIN resolved r ON r.player_id = p.player_id LEFT JOIN traits t ON t.player_id = p.player_id
       LEFT JOIN profile_table f ON f.player_id = p.player_id""",
    "players",
    "resolved",
    "traits",
)
def enrich_players(lake):
    return players.enrich_players(
        lake.players, lake.pitches, fixture.lookup_names(lake.spark, lake.sf_dir),
        fixture.lookup_profiles(lake.spark, lake.sf_dir),
    )


@query("resolve_names", "SELECT player_id, full_name FROM resolved", "resolved")
def resolve_names(lake):
    return players.resolve_names(
        lake.players, fixture.lookup_names(lake.spark, lake.sf_dir), fixture.lookup_profiles(lake.spark, lake.sf_dir)
    )


@query(
    "refresh_player_teams",
    """SELECT p.* EXCLUDE (team), CASE WHEN t.team IS NOT NULL THEN t.team ELSE p.team END AS team,
         t.team IS NOT NULL AND p.team IS DISTINCT FROM t.team AS team_changed
       FROM players p LEFT JOIN traits t ON t.player_id = p.player_id""",
    "players",
    "traits",
)
def refresh_player_teams(lake):
    return players.refresh_player_teams(lake.players, lake.pitches)


@query(
    "derived_team",
    """SELECT season, inning_half, batter_team, pitcher_team, derived_batter_team, derived_pitcher_team, COUNT(*) AS pitches
       FROM pitches_with_teams GROUP BY ALL""",
    "pitches_with_teams",
)
def derived_team(lake):
    by = ["season", "inning_half", "batter_team", "pitcher_team", "derived_batter_team", "derived_pitcher_team"]
    return players.with_derived_teams(lake.pitches, lake.games).groupBy(*by).agg(F.count(F.lit(1)).alias("pitches"))


@query(
    "player_latest_team",
    """SELECT 'batter' AS role, * FROM batter_latest_team UNION ALL SELECT 'pitcher', * FROM pitcher_latest_team""",
    "batter_latest_team",
    "pitcher_latest_team",
)
def player_latest_team(lake):
    return reduce(
        DataFrame.unionByName,
        [
            players.player_latest_team(lake.pitches, lake.games, role).select(F.lit(role).alias("role"), "*")
            for role in ("batter", "pitcher")
        ],
    )


@query(
    "display_name",
    """SELECT a.batter_id, COALESCE(p.full_name, concat('Batter #', CAST(a.batter_id AS VARCHAR))) AS batter_name, COUNT(*) AS pa
       FROM at_bats a LEFT JOIN players p ON p.player_id = a.batter_id GROUP BY ALL""",
    "at_bats",
    "players",
)
def display_name(lake):
    return players.name_players(
        lake.at_bats.groupBy("batter_id").agg(F.count(F.lit(1)).alias("pa")), lake.players, "batter"
    )
