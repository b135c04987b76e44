"""Front-end computations on report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dugout.functions import vocab
from dugout.operators import batters, counts, leaderboards, pitchers, presentation, sequences
from dugout.operators.filters import Window
from dugout.plans.registry.base import query
from dugout.plans.registry.endpoints import (
    BATTER_SEASONS, BATTER_SUMMARY, IN_SEASONS, SEASONS, batter_rows, matrix, pitcher_rows, usage, zones,
)
from dugout.plans.registry.library import BATTING_LEADERS, _sequence_check

_SUMS = ["g", "pa", "ab", "h", "doubles", "triples", "hr", "bb", "so"]
_MEANS = {"avg": "ab", "obp": "pa", "slg": "ab", "xwoba": "pa"}


@query(
    "season_totals",
    f"""WITH lines AS ({BATTER_SEASONS.strip()})
    SELECT season, team, {', '.join(_SUMS)}, {', '.join(_MEANS)}, 'team' AS row_type FROM lines
    UNION ALL
    SELECT season, 'Total', {', '.join(f'CAST(SUM(COALESCE({c}, 0)) AS BIGINT)' for c in _SUMS)},
      {', '.join(f'ROUND(COALESCE(SUM(COALESCE({c}, 0) * {w}) / NULLIF(SUM({w}), 0), 0), 9)' for c, w in _MEANS.items())}, 'total'
    FROM lines GROUP BY season HAVING COUNT(*) > 1""",
    "pitches_with_teams", "at_bats",
)
def season_totals(lake):
    lines = batters.batter_seasons(batter_rows(lake), lake.at_bats)
    exact = presentation.season_totals(lines, _SUMS, _MEANS)
    return exact.select(*[F.round(c, 9).alias(c) if c in _MEANS else F.col(c) for c in exact.columns])


@query(
    "slash_line",
    f"""SELECT pa, at_bats, hits, walks, total_bases, COALESCE(CAST(hits AS DOUBLE) / NULLIF(at_bats, 0), 0) AS slash_avg,
       COALESCE(CAST(hits + walks AS DOUBLE) / NULLIF(pa, 0), 0) AS slash_obp,
       COALESCE(CAST(total_bases AS DOUBLE) / NULLIF(at_bats, 0), 0) AS slash_slg FROM ({BATTER_SUMMARY.strip()}) s""",
    "pitches_with_teams", "at_bats",
)
def slash_line(lake):
    summary = batters.batter_summary(batter_rows(lake), lake.at_bats)
    return presentation.slash_line(summary.select("pa", "at_bats", "hits", "walks", "total_bases"))


_GRID_WHERE = "season = 2019 AND p_throws = 'L'"


def _matrix(lake):
    return counts.outcome_matrix(lake.pitches, lake.at_bats, Window(season=2019), p_throws="L")


@query(
    "matrix_totals",
    f"""SELECT 'All' AS count, CAST(SUM(at_bats) AS BIGINT) AS at_bats,
       {', '.join(f'ROUND(SUM(COALESCE({c}, 0) * at_bats) / greatest(1, SUM(at_bats)), 6) AS {c}' for c in ('k_pct', 'bb_pct', 'avg_xwoba'))}
       FROM ({matrix(_GRID_WHERE).strip()}) m""",
    "pitches", "at_bats",
)
def matrix_totals(lake):
    totals = presentation.matrix_totals(_matrix(lake))
    return totals.select("count", "at_bats", *[F.round(c, 6).alias(c) for c in ("k_pct", "bb_pct", "avg_xwoba")])


@query(
    "dense_count_grid",
    f"""SELECT CAST(i AS INT) AS position, CAST(i % 4 AS INT) AS balls, CAST(i // 4 AS INT) AS strikes,
       concat(CAST(i % 4 AS VARCHAR), '-', CAST(i // 4 AS VARCHAR)) AS count, COALESCE(m.k_pct, 0) AS k_pct
       FROM (SELECT unnest(range(12)) AS i) g LEFT JOIN ({matrix(_GRID_WHERE).strip()}) m
       ON m.balls = i % 4 AND m.strikes = i // 4""",
    "pitches", "at_bats",
)
def dense_count_grid(lake):
    return presentation.dense_count_grid(_matrix(lake))


@query(
    "leaderboard_rank",
    f"""SELECT *, CAST(row_number() OVER (ORDER BY COALESCE(avg, 0) DESC, batter_id) AS INT) AS rank,
       COALESCE(xwoba, 0) / greatest(max(COALESCE(xwoba, 0)) OVER (), 1.0) AS bar_share FROM ({BATTING_LEADERS}) b""",
    "at_bats", "players",
)
def leaderboard_rank(lake):
    board = leaderboards.batting_leaderboard(lake.at_bats, lake.players, 2019, limit=10, min_pa=5)
    return presentation.leaderboard_rank(board, "avg", "xwoba", ["batter_id"])


@query(
    "sequence_extremes",
    f"""WITH s AS ({_sequence_check(2, IN_SEASONS, 3).strip()})
    SELECT *, 'top' AS side FROM (SELECT * FROM s ORDER BY occurrences DESC, sequence LIMIT 10) t
    UNION ALL
    SELECT *, 'bottom' FROM (SELECT * FROM s ORDER BY COALESCE(whiff_pct, 0), occurrences DESC, sequence LIMIT 10) b""",
    "pitches",
)
def sequence_extremes(lake):
    found = sequences.pitch_sequences(lake.pitches, 2, min_occurrences=3, scope=SEASONS)
    return sequences.sequence_extremes(found)


def _fold_sql() -> str:
    """Outcome windows of five pitches folded step by step."""
    levels = ["f0 AS (SELECT *, 0 AS b0, 0 AS s0, CAST(NULL AS VARCHAR) AS t0 FROM w)"]
    for i in range(1, 6):
        o, b, s, t = f"o{i - 1}", f"b{i - 1}", f"s{i - 1}", f"t{i - 1}"
        levels.append(
            f"""f{i} AS (SELECT *, CASE WHEN {t} IS NULL AND {o} = 'ball' THEN least({b} + 1, 4) ELSE {b} END AS b{i},
              CASE WHEN {t} IS NULL AND {o} = 'strike' THEN least({s} + 1, 3)
                   WHEN {t} IS NULL AND {o} = 'foul' AND {s} < 2 THEN {s} + 1 ELSE {s} END AS s{i},
              CASE WHEN {t} IS NOT NULL THEN {t} WHEN {o} = 'ball' AND {b} + 1 >= 4 THEN 'Walk'
                   WHEN {o} = 'strike' AND {s} + 1 >= 3 THEN 'Strikeout' END AS t{i} FROM f{i - 1})"""
        )
    return ", ".join(levels)


@query(
    "derived_count",
    f"""WITH b AS (SELECT season, game_pk, at_bat_number, pitch_number,
        CASE WHEN description IN ('ball','blocked_ball','hit_by_pitch','pitchout') THEN 'ball'
        WHEN description IN ('called_strike','swinging_strike','swinging_strike_blocked','foul_tip','missed_bunt') THEN 'strike'
        WHEN description IN ('foul','foul_bunt','foul_pitchout') THEN 'foul' END AS o FROM pitches),
    w AS (SELECT a.o AS o0, b1.o AS o1, b2.o AS o2, b3.o AS o3, b4.o AS o4 FROM (SELECT * FROM b WHERE o IS NOT NULL) a
      {' '.join(f"LEFT JOIN b b{i} ON b{i}.game_pk = a.game_pk AND b{i}.at_bat_number = a.at_bat_number AND b{i}.pitch_number = a.pitch_number + {i}"
                + (f" AND b{i - 1}.o IS NOT NULL" if i > 1 else "") for i in range(1, 5))}),
    {_fold_sql()}
    SELECT concat_ws(',', o0, o1, o2, o3, o4) AS outcomes, CAST(b5 AS INT) AS balls, CAST(s5 AS INT) AS strikes,
      t5 IS NOT NULL AS terminal, t5 AS terminal_label, t5 IS NULL AND b5 < 3 AS ball_allowed, t5 IS NULL AND s5 < 2 AS strike_allowed,
      COUNT(*) AS runs FROM f5 GROUP BY ALL""",
    "pitches",
)
def derived_count(lake):
    grouped = sequences.outcome_runs(lake.pitches, 5).groupBy("run").agg(F.count(F.lit(1)).alias("runs"))
    return grouped.select(
        F.array_join("run", ",").alias("outcomes"),
        sequences.derived_count(F.col("run")).alias("c"),
        sequences.next_outcome_allowed(F.col("run"), F.lit("ball")).alias("ball_allowed"),
        sequences.next_outcome_allowed(F.col("run"), F.lit("strike")).alias("strike_allowed"),
        "runs",
    ).select("outcomes", "c.*", "ball_allowed", "strike_allowed", "runs")


@query(
    "pitch_mix_label",
    f"""WITH u AS ({usage(f'pitcher_id = 599970 AND {IN_SEASONS}').strip()}),
    r AS (SELECT *, row_number() OVER (PARTITION BY balls, strikes ORDER BY usage_pct DESC, pitch_type) AS rk FROM u)
    SELECT balls, strikes, string_agg(concat(pitch_type, ' ', CAST(CAST(ROUND(usage_pct * 100, 0) AS INT) AS VARCHAR), '%'), ' · ' ORDER BY rk) AS pitch_mix
    FROM r WHERE rk <= 3 GROUP BY balls, strikes""",
    "pitches",
)
def pitch_mix_label(lake):
    return presentation.pitch_mix_label(pitchers.pitcher_counts(pitcher_rows(lake)))


@query(
    "pitch_labels",
    "SELECT code, CASE " + "WHEN code IS NULL OR code = '' THEN 'Unknown' "
    + " ".join(f"WHEN code = '{c}' THEN '{name} ({c})'" for c, name in vocab.PITCH_TYPE_LABELS.items())
    + " ELSE code END AS label, COUNT(*) AS pitches FROM (SELECT CASE WHEN zone = 3 THEN 'ZZ' ELSE pitch_type END AS code FROM pitches) p GROUP BY ALL",
    "pitches",
)
def pitch_labels(lake):
    code = F.when(F.col("zone") == 3, "ZZ").otherwise(F.col("pitch_type"))
    by_code = lake.pitches.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("pitches"))
    return by_code.select("code", presentation.pitch_label(F.col("code")).alias("label"), "pitches")


@query(
    "zone_shading",
    f"""SELECT zone, pitches, CAST(pitches AS DOUBLE) / greatest(1, max(pitches) OVER ()) AS share,
       0.08E0 + CAST(pitches AS DOUBLE) / greatest(1, max(pitches) OVER ()) * 0.72E0 AS fill
       FROM ({zones('pitches', 'season = 2019 AND strikes = 2')}) z""",
    "pitches",
)
def zone_shading(lake):
    return presentation.zone_shading(counts.zone_map(lake.pitches, Window(season=2019), strikes=2))
