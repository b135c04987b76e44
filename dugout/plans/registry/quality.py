"""Coverage and validation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.operators import quality
from dugout.plans.registry.base import ALL_TYPES, query

CURRENT_YEAR = 2023
# Games a season is taken to schedule, in place of the real calendar's.
EXPECTED_SQL = "CASE WHEN season = 2015 THEN {n} WHEN season = 2016 THEN {n} + 2 ELSE {n} + 40 END"


def _status(lake) -> DataFrame:
    """Seasons count as complete once they hold postseason finals."""
    finals = lake.games.filter("game_type = 'W'").select("season").distinct()
    return finals.select("season", (F.col("season") % 3 != 0).alias("completed"))


_STATUS_SQL = "(SELECT DISTINCT season, season % 3 <> 0 AS completed FROM games WHERE game_type = 'W')"
_GAMES_SQL = f"""SELECT season, COUNT(DISTINCT CASE WHEN game_type = 'R' THEN game_pk END) AS regular_games,
    COUNT(DISTINCT CASE WHEN game_type <> 'R' THEN game_pk END) AS postseason_total,
    {', '.join(f"COUNT(DISTINCT CASE WHEN game_type = '{t}' THEN game_pk END) AS postseason_{t.lower()}" for t in 'FDLW')}
    FROM pitches WHERE game_type IN {ALL_TYPES} GROUP BY season"""


@query(
    "season_report",
    f"""SELECT g.*, l.c AS league_pitch_state_rows, p.c AS player_pitch_state_rows, t.c AS pitch_transition_rows,
       COALESCE(b.c, 0) AS at_bat_rows, e.expected_games, g.season = 2025 AS reference_season
       FROM ({_GAMES_SQL}) g
       LEFT JOIN (SELECT season, COUNT(*) AS c FROM league_pitch_state_summary GROUP BY 1) l ON l.season = g.season
       LEFT JOIN (SELECT season, COUNT(*) AS c FROM player_pitch_state_summary GROUP BY 1) p ON p.season = g.season
       LEFT JOIN (SELECT season, COUNT(*) AS c FROM pitch_transition_summary GROUP BY 1) t ON t.season = g.season
       LEFT JOIN (SELECT season, COUNT(*) AS c FROM at_bats GROUP BY 1) b ON b.season = g.season
       LEFT JOIN (SELECT season, CAST(max(season) * 0 + CASE WHEN season = 2020 THEN 898 ELSE 2430 END AS BIGINT) AS expected_games
                  FROM games GROUP BY season) e ON e.season = g.season""",
    "pitches", "at_bats", "games", "league_pitch_state_summary", "player_pitch_state_summary", "pitch_transition_summary",
)
def season_report(lake):
    from dugout.functions.vocab import season_games

    expectations = (
        lake.games.select("season")
        .distinct()
        .withColumn("expected_games", season_games(F.col("season")).cast("bigint"))
    )
    derived = {
        "league_pitch_state": lake.league_state,
        "player_pitch_state": lake.player_state,
        "pitch_transition": lake.transitions,
        "at_bat": lake.at_bats,
    }
    return quality.season_report(lake.pitches, derived, expectations)


@query(
    "history_coverage",
    f"""SELECT s.season, s.season BETWEEN 2015 AND {CURRENT_YEAR} AS expected, l.season IS NOT NULL AS loaded, c.season IS NOT NULL AS completed,
       s.season BETWEEN 2015 AND {CURRENT_YEAR} AND c.season IS NULL AS missing, l.season IS NOT NULL AND c.season IS NULL AS incomplete
       FROM (SELECT CAST(unnest(range(2015, {CURRENT_YEAR + 1})) AS INT) AS season UNION SELECT season FROM pitches) s
       LEFT JOIN (SELECT DISTINCT season FROM pitches) l ON l.season = s.season
       LEFT JOIN (SELECT season FROM {_STATUS_SQL} x WHERE completed) c ON c.season = s.season""",
    "pitches", "games",
)
def history_coverage(lake):
    return quality.history_coverage(lake.pitches, _status(lake), CURRENT_YEAR)


_COVERAGE_SQL = """SELECT COUNT(*) AS total_players, COUNT(full_name) AS named_players,
    COUNT(*) FILTER (WHERE full_name IS NULL) AS unnamed_players, COUNT(team) AS team_players,
    COUNT(*) FILTER (WHERE full_name IS NULL) = 0 AS name_complete FROM players"""


@query("player_coverage", _COVERAGE_SQL, "players")
def player_coverage(lake):
    return quality.player_coverage(lake.players)


def _expected(lake):
    """The first season's regular games: exact for it, two short for the next, far off beyond."""
    return (
        F.when(F.col("season") == 2015, F.lit(_base(lake)))
        .when(F.col("season") == 2016, F.lit(_base(lake) + 2))
        .otherwise(F.lit(_base(lake) + 40))
    )


def _base(lake) -> int:
    return lake.pitches.filter("season = 2015 AND game_type = 'R'").agg(F.count_distinct("game_pk")).first()[0]


_BASE_SQL = "(SELECT COUNT(DISTINCT game_pk) FROM pitches WHERE season = 2015 AND game_type = 'R')"
_VERDICT_SQL = f"""SELECT *, CASE WHEN season = 2021 THEN 'PARTIAL' WHEN delta = 0 THEN 'PASS' WHEN abs(delta) <= 2 THEN 'CLOSE' ELSE 'FAIL' END AS verdict
    FROM (SELECT season, regular_games, postseason_total, CAST(e AS BIGINT) AS expected_games, CAST(regular_games - e AS BIGINT) AS delta
          FROM (SELECT g.*, {EXPECTED_SQL.format(n=_BASE_SQL)} AS e FROM ({_GAMES_SQL}) g) x) y"""


@query("game_count_verdict", _VERDICT_SQL, "pitches")
def game_count_verdict(lake):
    return quality.game_count_verdict(lake.pitches, _expected(lake), partial_season=2021)


@query(
    "game_count_verdict_calendar",
    f"""SELECT season, regular_games, postseason_total, CAST(e AS BIGINT) AS expected_games, CAST(regular_games - e AS BIGINT) AS delta,
       CASE WHEN regular_games = e THEN 'PASS' WHEN abs(regular_games - e) <= 2 THEN 'CLOSE' ELSE 'FAIL' END AS verdict
       FROM (SELECT *, CASE WHEN season = 2020 THEN 898 ELSE 2430 END AS e FROM ({_GAMES_SQL}) g) x""",
    "pitches",
)
def game_count_verdict_calendar(lake):
    return quality.game_count_verdict(lake.pitches)


@query(
    "thin_dates",
    f"""SELECT season, game_date, COUNT(DISTINCT game_pk) AS games, COUNT(DISTINCT pitcher_team) AS teams FROM pitches
       WHERE game_type = 'R' AND season IN (SELECT season FROM ({_VERDICT_SQL}) v WHERE delta <> 0 AND verdict <> 'PARTIAL' AND season <> 2020)
       GROUP BY season, game_date HAVING COUNT(DISTINCT game_pk) < 10""",
    "pitches",
)
def thin_dates(lake):
    return quality.thin_dates(lake.pitches, _expected(lake), partial_season=2021)


def schedule(lake) -> DataFrame:
    """Every game, and for every fifth one a further game that never landed."""
    played = lake.games.select("game_pk", "season", "game_date", F.concat_ws(" @ ", "away_team", "home_team").alias("matchup"))
    unplayed = played.filter("game_pk % 5 = 0").withColumn("game_pk", -F.col("game_pk") - 1)
    return played.unionByName(unplayed)


@query(
    "missing_games",
    """SELECT -game_pk - 1 AS game_pk, season, game_date, concat(away_team, ' @ ', home_team) AS matchup FROM games WHERE game_pk % 5 = 0
       UNION ALL
       SELECT game_pk, season, game_date, concat(away_team, ' @ ', home_team) FROM games WHERE game_pk % 7 = 3""",
    "games",
)
def missing_games(lake):
    return quality.missing_games(schedule(lake), lake.pitches.filter("game_pk % 7 <> 3"))


@query(
    "empty_tables",
    """SELECT 'league_pitch_state_summary' AS table_name, COUNT(*) AS row_count, CAST(NULL AS VARCHAR) AS warning FROM league_pitch_state_summary
       UNION ALL SELECT 'at_bats', COUNT(*), NULL FROM at_bats
       UNION ALL SELECT 'pitch_transition_summary', COUNT(*), 'WARNING: pitch_transition_summary is empty' FROM pitch_transition_summary WHERE season = 1900""",
    "league_pitch_state_summary", "at_bats", "pitch_transition_summary",
)
def empty_tables(lake):
    return quality.empty_tables(
        {
            "league_pitch_state_summary": lake.league_state,
            "at_bats": lake.at_bats,
            "pitch_transition_summary": lake.transitions.filter("season = 1900"),
        }
    )


@query(
    "status",
    f"""WITH cov AS (SELECT s.season, l.season IS NOT NULL AS loaded, c.season IS NOT NULL AS completed
       FROM (SELECT CAST(unnest(range(2015, {CURRENT_YEAR + 1})) AS INT) AS season) s
       LEFT JOIN (SELECT DISTINCT season FROM pitches) l ON l.season = s.season
       LEFT JOIN (SELECT season FROM {_STATUS_SQL} x WHERE completed) c ON c.season = s.season),
    names AS ({_COVERAGE_SQL})
    SELECT (SELECT min(game_date) FROM pitches) AS earliest_game_date, (SELECT max(game_date) FROM pitches) AS latest_game_date,
      (SELECT COUNT(*) FROM pitches) AS pitches,
      (SELECT string_agg(CAST(season AS VARCHAR), ',' ORDER BY season) FROM cov) AS expected_seasons,
      (SELECT string_agg(CAST(season AS VARCHAR), ',' ORDER BY season) FROM cov WHERE loaded) AS loaded_seasons,
      (SELECT string_agg(CAST(season AS VARCHAR), ',' ORDER BY season) FROM cov WHERE completed) AS completed_seasons,
      (SELECT string_agg(CAST(season AS VARCHAR), ',' ORDER BY season) FROM cov WHERE NOT completed) AS missing_seasons,
      (SELECT string_agg(CAST(season AS VARCHAR), ',' ORDER BY season) FROM cov WHERE loaded AND NOT completed) AS incomplete_seasons,
      (SELECT COUNT(*) = 0 FROM cov WHERE NOT completed) AS history_complete, names.* FROM names""",
    "pitches", "games", "players",
)
def status(lake):
    return quality.status(lake.pitches, lake.players, _status(lake), CURRENT_YEAR)
