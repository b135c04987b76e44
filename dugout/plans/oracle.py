"""SQL forms of the shared tables, as CTEs that reports' check queries build on."""

from __future__ import annotations

RAW = """
  SELECT o.*, (l.l_linenumber - 1) // 16 AS portion, l.l_partkey AS part, l.l_suppkey AS supp, CAST(l.l_quantity AS INT) AS qty,
    CAST(row_number() OVER w AS INT) AS pitch_number, lead(l.l_partkey) OVER w IS NULL AS is_last,
    row_number() OVER w AS rn
  FROM lineitem l JOIN (SELECT o_orderkey AS k, o_custkey AS cust FROM orders) o ON l.l_orderkey = o.k
  WINDOW w AS (PARTITION BY l.l_orderkey, (l.l_linenumber - 1) // 16 ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
    CAST(l.l_quantity AS INT))
"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "seq": ((), RAW),
    "ev": (
        ("seq",),
        """
  SELECT *, CASE WHEN NOT is_last THEN NULL ELSE
    CASE CAST((k * 7 + cust * 3) % 20 AS INT)
      WHEN 0 THEN 'strikeout' WHEN 1 THEN 'strikeout' WHEN 2 THEN 'strikeout' WHEN 3 THEN 'strikeout_double_play'
      WHEN 4 THEN 'walk' WHEN 5 THEN 'walk' WHEN 6 THEN 'intent_walk' WHEN 7 THEN 'single' WHEN 8 THEN 'single'
      WHEN 9 THEN 'double' WHEN 10 THEN 'triple' WHEN 11 THEN 'home_run' WHEN 12 THEN 'hit_by_pitch'
      WHEN 13 THEN 'sac_fly' WHEN 14 THEN 'sac_bunt' WHEN 15 THEN 'catcher_interf' WHEN 19 THEN NULL
      ELSE 'field_out' END END AS events
  FROM seq""",
    ),
    "ds": (
        ("ev",),
        """
  SELECT *, CASE
      WHEN events IN ('single','double','triple','home_run','field_out','sac_fly','sac_bunt') THEN 'hit_into_play'
      WHEN events IN ('strikeout','strikeout_double_play') THEN
        CASE WHEN part % 2 = 0 THEN 'swinging_strike' ELSE 'called_strike' END
      WHEN events IN ('walk','intent_walk') THEN 'ball'
      WHEN events = 'hit_by_pitch' THEN 'hit_by_pitch'
      ELSE CASE CAST(part % 14 AS INT)
        WHEN 0 THEN 'ball' WHEN 1 THEN 'ball' WHEN 2 THEN 'ball' WHEN 3 THEN 'blocked_ball' WHEN 4 THEN 'pitchout'
        WHEN 5 THEN 'called_strike' WHEN 6 THEN 'called_strike' WHEN 7 THEN 'swinging_strike'
        WHEN 8 THEN 'swinging_strike_blocked' WHEN 9 THEN 'foul' WHEN 10 THEN 'foul' WHEN 11 THEN 'foul_bunt'
        WHEN 12 THEN 'foul_tip' ELSE 'missed_bunt' END END AS description
  FROM ev""",
    ),
    "ct": (
        ("ds",),
        """
  SELECT *, k // 64 AS g, CAST(k % 64 + 1 + portion * 64 AS INT) AS ab, (part * 3 + supp) % 7 AS kind,
    CAST(least(3, coalesce(sum(CASE WHEN description IN ('ball','blocked_ball','pitchout') THEN 1 ELSE 0 END) OVER w, 0)) AS INT) AS balls,
    CAST(least(2, coalesce(sum(CASE WHEN description IN ('called_strike','swinging_strike','swinging_strike_blocked',
      'foul','foul_bunt','foul_tip','missed_bunt') THEN 1 ELSE 0 END) OVER w, 0)) AS INT) AS strikes
  FROM ds WINDOW w AS (PARTITION BY k, portion ORDER BY pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
    "raw_pitches": (
        ("ct",),
        """
  SELECT g AS game_pk, ab AS at_bat_number, pitch_number,
    CAST(k % 40 + 599965 AS INT) AS pitcher,
    CAST((cust + CASE WHEN k % 50 = 7 AND pitch_number >= 3 THEN 1 ELSE 0 END) % 60 + 600000 AS INT) AS batter,
    CASE WHEN k % 3 = 1 THEN '' WHEN k % 3 = 2 THEN concat('T', CAST(g % 12 AS VARCHAR)) END AS pitcher_team,
    CASE WHEN k % 3 = 1 THEN '' WHEN k % 3 = 2 THEN concat('T', CAST((g + 5) % 12 AS VARCHAR)) END AS batter_team,
    concat('T', CAST(g % 12 AS VARCHAR)) AS home_team, concat('T', CAST((g + 5) % 12 AS VARCHAR)) AS away_team,
    CASE WHEN cust % 3 = 0 THEN 'L' ELSE 'R' END AS stand, CASE WHEN k % 4 = 0 THEN 'L' ELSE 'R' END AS p_throws,
    CAST(ab % 9 + 1 AS INT) AS inning,
    CASE WHEN k % 37 = 0 THEN NULL WHEN ab % 2 = 0 THEN 'Bot' ELSE 'Top' END AS inning_topbot,
    CAST(k % 3 AS INT) AS outs_when_up, balls, strikes,
    CASE WHEN cust % 4 = 0 THEN CAST((cust + 7) % 60 + 600000 AS INT) END AS on_1b,
    CASE WHEN cust % 5 = 0 AND pitch_number > 1 THEN CAST((cust + 11) % 60 + 600000 AS INT) END AS on_2b,
    CASE WHEN cust % 7 = 0 THEN CAST((cust + 13) % 60 + 600000 AS INT) END AS on_3b,
    CASE WHEN part % 41 = 0 THEN NULL ELSE CASE CAST(kind AS INT) WHEN 0 THEN 'FF' WHEN 1 THEN 'SI' WHEN 2 THEN 'SL'
      WHEN 3 THEN 'CH' WHEN 4 THEN 'CU' WHEN 5 THEN 'FC' ELSE 'ST' END END AS pitch_type,
    CASE WHEN part % 41 = 0 THEN NULL ELSE CASE CAST(kind AS INT) WHEN 0 THEN '4-Seam Fastball' WHEN 1 THEN 'Sinker'
      WHEN 2 THEN 'Slider' WHEN 3 THEN 'Changeup' WHEN 4 THEN 'Curveball' WHEN 5 THEN 'Cutter' ELSE 'Sweeper' END END AS pitch_name,
    CASE WHEN g % 10 = 3 THEN 'F' WHEN g % 10 = 5 THEN 'D' WHEN g % 10 = 7 THEN 'L' WHEN g % 10 = 9 THEN 'W'
      WHEN g % 31 = 0 THEN 'S' ELSE 'R' END AS game_type,
    CASE WHEN part % 23 = 0 THEN NULL ELSE 78.0E0 + (part % 160) / 8.0E0 END AS release_speed,
    CASE WHEN part % 29 = 0 THEN NULL ELSE CAST((supp * 37 + qty) % 900 + 1800 AS DOUBLE) END AS release_spin_rate,
    (part % 33 - 16) / 16.0E0 AS pfx_x, (supp % 33 - 10) / 16.0E0 AS pfx_z,
    (part % 65 - 32) / 16.0E0 AS plate_x, (supp % 64) / 16.0E0 AS plate_z,
    description, CAST((part + qty) % 14 + 1 AS INT) AS zone,
    CASE WHEN description = 'hit_into_play' THEN 'X'
      WHEN description IN ('ball','blocked_ball','pitchout','hit_by_pitch') THEN 'B' ELSE 'S' END AS type,
    CASE WHEN description <> 'hit_into_play' THEN NULL WHEN part % 4 = 0 THEN 'ground_ball' WHEN part % 4 = 1 THEN 'fly_ball'
      WHEN part % 4 = 2 THEN 'line_drive' ELSE 'popup' END AS bb_type,
    events,
    CASE WHEN events IS NULL THEN NULL ELSE (part % 128) / 64.0E0 END AS estimated_woba_using_speedangle,
    CASE events WHEN 'single' THEN 0.875E0 WHEN 'double' THEN 1.25E0 WHEN 'triple' THEN 1.5E0 WHEN 'home_run' THEN 2.0E0
      WHEN 'walk' THEN 0.6875E0 WHEN 'strikeout' THEN 0.0E0 WHEN 'field_out' THEN 0.0E0 END AS woba_value,
    CAST(make_date(2015 + g % 7, 4, 1) + CAST((g // 7 * 13) % 180 AS INT) AS VARCHAR) AS game_date
  FROM ct""",
    ),
    "cleaned": (
        ("raw_pitches",),
        """
  SELECT concat_ws('_', CAST(game_pk AS VARCHAR), CAST(at_bat_number AS VARCHAR), CAST(pitch_number AS VARCHAR)) AS pitch_id,
    concat_ws('_', CAST(game_pk AS VARCHAR), CAST(at_bat_number AS VARCHAR)) AS at_bat_id,
    concat(CASE WHEN on_1b IS NULL THEN '0' ELSE '1' END, CASE WHEN on_2b IS NULL THEN '0' ELSE '1' END,
      CASE WHEN on_3b IS NULL THEN '0' ELSE '1' END) AS base_state,
    CAST(year(CAST(game_date AS DATE)) AS INT) AS season,
    * EXCLUDE (pitcher, batter, inning_topbot, game_date), pitcher AS pitcher_id, batter AS batter_id,
    inning_topbot AS inning_half, CAST(game_date AS DATE) AS game_date
  FROM raw_pitches""",
    ),
    "pitches": (("cleaned",), "SELECT * EXCLUDE (at_bat_id, home_team, away_team) FROM cleaned WHERE game_type IN ('R','F','D','L','W')"),
    "games": (
        ("cleaned",),
        """
  SELECT game_pk, max(game_date) AS game_date, max(home_team) AS home_team, max(away_team) AS away_team,
    CAST(NULL AS VARCHAR) AS venue, max(game_type) AS game_type, CAST(year(max(game_date)) AS INT) AS season
  FROM cleaned WHERE game_type IN ('R','F','D','L','W') GROUP BY game_pk""",
    ),
    "stubs": (("pitches",), "SELECT pitcher_id AS player_id FROM pitches UNION SELECT batter_id FROM pitches"),
    "players": (
        ("stubs",),
        """
  SELECT player_id,
    CASE WHEN player_id % 5 = 0 THEN NULL ELSE concat('Player ', CAST(player_id AS VARCHAR)) END AS full_name,
    CASE WHEN player_id % 3 = 0 THEN 'L' ELSE 'R' END AS bats, CASE WHEN player_id % 4 = 0 THEN 'L' ELSE 'R' END AS throws,
    CASE WHEN player_id < 600005 THEN 'P' ELSE 'B' END AS position,
    CASE WHEN player_id % 4 = 0 THEN NULL WHEN player_id % 4 = 1 THEN '' ELSE concat('T', CAST(player_id % 12 AS VARCHAR)) END AS team
  FROM stubs""",
    ),
    "at_bats": (
        ("pitches",),
        """
  SELECT concat_ws('_', CAST(game_pk AS VARCHAR), CAST(at_bat_number AS VARCHAR)) AS at_bat_id, game_pk, at_bat_number,
    arg_min(pitcher_id, pitch_number) AS pitcher_id, arg_min(batter_id, pitch_number) AS batter_id,
    arg_min(stand, pitch_number) AS stand, arg_min(p_throws, pitch_number) AS p_throws, arg_min(inning, pitch_number) AS inning,
    lower(substr(coalesce(arg_min(inning_half, pitch_number), ''), 1, 3)) AS inning_half,
    arg_min(outs_when_up, pitch_number) AS outs_at_start,
    arg_min(on_1b, pitch_number) AS on_1b, arg_min(on_2b, pitch_number) AS on_2b, arg_min(on_3b, pitch_number) AS on_3b,
    arg_min(base_state, pitch_number) AS base_state, count(*) AS pitch_count,
    arg_max(balls, pitch_number) AS final_balls, arg_max(strikes, pitch_number) AS final_strikes,
    concat_ws('-', CAST(arg_max(balls, pitch_number) AS VARCHAR), CAST(arg_max(strikes, pitch_number) AS VARCHAR)) AS final_count,
    max(strikes) >= 2 AS reached_2strike, max(balls) >= 3 AS reached_3ball, bool_or(balls >= 3 AND strikes >= 2) AS reached_full,
    arg_max(events, pitch_number) AS final_event, arg_max(pitch_type, pitch_number) AS final_pitch_type,
    arg_min(game_type, pitch_number) AS game_type, arg_max(estimated_woba_using_speedangle, pitch_number) AS xwoba,
    arg_max(woba_value, pitch_number) AS woba_value, arg_min(game_date, pitch_number) AS game_date,
    arg_min(season, pitch_number) AS season
  FROM pitches GROUP BY game_pk, at_bat_number""",
    ),
    "pitches_with_teams": (
        ("pitches", "games"),
        """
  SELECT p.*, concat_ws('_', CAST(p.game_pk AS VARCHAR), CAST(p.at_bat_number AS VARCHAR)) AS at_bat_id,
    COALESCE(NULLIF(p.batter_team, ''), CASE WHEN p.inning_half = 'Top' THEN g.away_team ELSE g.home_team END) AS derived_batter_team,
    COALESCE(NULLIF(p.pitcher_team, ''), CASE WHEN p.inning_half = 'Top' THEN g.home_team ELSE g.away_team END) AS derived_pitcher_team
  FROM pitches p LEFT JOIN games g ON g.game_pk = p.game_pk""",
    ),
}

_STATE_MEASURES = """
    max(pitch_name) AS pitch_name, COUNT(*) AS pitches,
    COUNT(DISTINCT concat(CAST(game_pk AS VARCHAR), '_', CAST(at_bat_number AS VARCHAR))) AS plate_appearances,
    COUNT(*) FILTER (WHERE description IN ('ball','blocked_ball','hit_by_pitch','pitchout')) AS ball_events,
    COUNT(*) FILTER (WHERE description = 'called_strike') AS called_strikes,
    COUNT(*) FILTER (WHERE description IN ('swinging_strike','swinging_strike_blocked','foul_tip','missed_bunt')) AS whiffs,
    COUNT(*) FILTER (WHERE description IN ('foul','foul_bunt','foul_pitchout')) AS fouls,
    COUNT(*) FILTER (WHERE description = 'hit_into_play' OR type = 'X') AS balls_in_play,
    COUNT(*) FILTER (WHERE events IN ('single','double','triple','home_run')) AS hit_events,
    COUNT(*) FILTER (WHERE events IN ('walk','intent_walk')) AS walk_events,
    COUNT(*) FILTER (WHERE events IN ('strikeout','strikeout_double_play')) AS strikeout_events,
    AVG(woba_value) AS avg_woba_value, AVG(estimated_woba_using_speedangle) AS avg_xwoba"""
_STATE_KEY = (
    "COALESCE(game_type, 'NA'), CAST(balls AS VARCHAR), CAST(strikes AS VARCHAR), CAST(outs_when_up AS VARCHAR),"
    " COALESCE(stand, 'NA'), COALESCE(p_throws, 'NA')"
)
_STATE = "game_type, balls, strikes, outs_when_up, stand, p_throws"

CTES["league_pitch_state_summary"] = (
    ("pitches",),
    f"""
  SELECT concat_ws(':', CAST(season AS VARCHAR), {_STATE_KEY}, COALESCE(pitch_type, 'NA')) AS row_key,
    season, {_STATE}, pitch_type, {_STATE_MEASURES}
  FROM pitches GROUP BY season, {_STATE}, pitch_type""",
)
CTES["player_pitch_state_summary"] = (
    ("pitches",),
    f"""
  SELECT concat_ws(':', CAST(season AS VARCHAR), perspective, CAST(player_id AS VARCHAR), {_STATE_KEY}, COALESCE(pitch_type, 'NA')) AS row_key,
    season, perspective, player_id, max(team) AS team, {_STATE}, pitch_type, {_STATE_MEASURES}
  FROM (SELECT *, 'batter' AS perspective, batter_id AS player_id, batter_team AS team FROM pitches WHERE batter_id IS NOT NULL
        UNION ALL
        SELECT *, 'pitcher', pitcher_id, pitcher_team FROM pitches WHERE pitcher_id IS NOT NULL) u
  GROUP BY season, perspective, player_id, {_STATE}, pitch_type""",
)
CTES["pitch_transition_summary"] = (
    ("pitches",),
    f"""
  SELECT concat_ws(':', CAST(season AS VARCHAR), perspective, COALESCE(CAST(player_id AS VARCHAR), 'NA'), {_STATE_KEY},
      COALESCE(prev_pitch_type, 'NA'), COALESCE(next_pitch_type, 'NA')) AS row_key,
    season, perspective, player_id, {_STATE}, prev_pitch_type, next_pitch_type, COUNT(*) AS transitions,
    COUNT(*) FILTER (WHERE nd IN ('swinging_strike','swinging_strike_blocked','foul_tip','missed_bunt')) AS next_pitch_whiffs,
    COUNT(*) FILTER (WHERE nd = 'called_strike') AS next_pitch_called_strikes,
    COUNT(*) FILTER (WHERE nd IN ('ball','blocked_ball','hit_by_pitch','pitchout')) AS next_pitch_balls,
    COUNT(*) FILTER (WHERE nd = 'hit_into_play' OR nt = 'X') AS next_pitch_in_play,
    COUNT(*) FILTER (WHERE ne IN ('single','double','triple','home_run')) AS next_pitch_hits,
    COUNT(*) FILTER (WHERE ne IN ('walk','intent_walk')) AS next_pitch_walks,
    COUNT(*) FILTER (WHERE ne IN ('strikeout','strikeout_double_play')) AS next_pitch_strikeouts
  FROM (SELECT b.*, v.perspective, CASE v.perspective WHEN 'batter' THEN batter_id ELSE pitcher_id END AS player_id
        FROM (SELECT *, pitch_type AS prev_pitch_type, LEAD(pitch_type) OVER w AS next_pitch_type, LEAD(description) OVER w AS nd,
                LEAD(type) OVER w AS nt, LEAD(events) OVER w AS ne
              FROM pitches WINDOW w AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number)) b,
             (VALUES ('batter'), ('pitcher')) v(perspective)) u
  WHERE player_id IS NOT NULL AND prev_pitch_type IS NOT NULL AND next_pitch_type IS NOT NULL
  GROUP BY season, perspective, player_id, {_STATE}, prev_pitch_type, next_pitch_type""",
)

_ORDERED = (
    "arg_max({value}, (CAST(game_date AS VARCHAR), lpad(CAST(game_pk AS VARCHAR), 20, '0'),"
    " lpad(CAST(at_bat_number AS VARCHAR), 12, '0'), lpad(CAST(pitch_number AS VARCHAR), 12, '0'))::VARCHAR)"
    " FILTER (WHERE {value} IS NOT NULL)"
)


def latest(value: str) -> str:
    """Latest non-null value in pitch order."""
    return _ORDERED.format(value=value)


CTES["traits"] = (
    ("pitches",),
    f"""
  SELECT COALESCE(p.player_id, b.player_id) AS player_id, CASE WHEN p.player_id IS NOT NULL THEN 'P' ELSE 'B' END AS position,
    p.throws, b.bats, COALESCE(p.team, b.team) AS team
  FROM (SELECT pitcher_id AS player_id, {latest('p_throws')} AS throws, {latest('pitcher_team')} AS team
        FROM pitches WHERE pitcher_id IS NOT NULL GROUP BY pitcher_id) p
  FULL OUTER JOIN (SELECT batter_id AS player_id, {latest('stand')} AS bats, {latest('batter_team')} AS team
        FROM pitches WHERE batter_id IS NOT NULL GROUP BY batter_id) b ON p.player_id = b.player_id""",
)
for _role in ("batter", "pitcher"):
    CTES[f"{_role}_latest_team"] = (
        ("pitches_with_teams",),
        f"SELECT {_role}_id AS player_id, {latest(f'derived_{_role}_team')} AS latest_team FROM pitches_with_teams"
        f" WHERE {_role}_id IS NOT NULL GROUP BY {_role}_id HAVING latest_team IS NOT NULL",
    )

# Python-style title case: upper after a non-letter, lower otherwise.
_TITLE = (
    "list_aggregate(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT"
    " regexp_matches(substr({x}, i - 1, 1), '[A-Za-z]') THEN upper(substr({x}, i, 1)) ELSE lower(substr({x}, i, 1)) END),"
    " 'string_agg', '')"
)
CTES["name_table"] = (
    (),
    """
  SELECT DISTINCT CAST(c_custkey % 100 + 599965 AS INT) AS key_mlbam,
    concat('  o''MAR ', CASE WHEN (c_custkey % 100 + 599965) % 2 = 0 THEN 'de' ELSE 'VAN' END) AS name_first,
    concat('smith-JONES', CAST(c_custkey % 100 + 599965 AS VARCHAR), 'x ') AS name_last
  FROM customer WHERE (c_custkey % 100 + 599965) % 5 <> 3""",
)
CTES["profile_table"] = (
    (),
    """
  SELECT DISTINCT CAST(c_custkey % 100 + 599965 AS INT) AS player_id,
    concat('Profile ', CAST(c_custkey % 100 + 599965 AS VARCHAR)) AS full_name,
    CASE WHEN (c_custkey % 100 + 599965) % 2 = 0 THEN 'S' ELSE 'R' END AS bats, 'L' AS throws, 'C' AS position
  FROM customer WHERE (c_custkey % 100 + 599965) % 10 <> 8""",
)
CTES["resolved"] = (
    ("stubs", "name_table", "profile_table"),
    f"""
  SELECT s.player_id, COALESCE(n.nm, f.full_name) AS full_name, n.nm IS NOT NULL AS in_names
  FROM stubs s
  LEFT JOIN (SELECT key_mlbam, concat({_TITLE.format(x='trim(name_first)')}, ' ', {_TITLE.format(x='trim(name_last)')}) AS nm
             FROM name_table) n ON n.key_mlbam = s.player_id
  LEFT JOIN profile_table f ON f.player_id = s.player_id""",
)


def sql(select: str, *needs: str) -> str:
    """A full query: the needed CTEs in dependency order, then ``select``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dependency in CTES[name][0]:
            visit(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    body = select.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    # A select that starts with its own WITH continues the list.
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
