"""Sources, bundles, audit tables and the ingest lifecycles, run on scratch stores."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.functions.numbers import json_safe
from dugout.plans import ingest
from dugout.plans.registry.base import query
from dugout.plans.registry.ingest import _BATTING_SQL, _PITCHING_SQL, _batting_feed, _pitching_feed
from dugout.plans.registry.quality import schedule
from dugout.schemas import SEASON_TABLES, TABLES
from dugout.sources import bundles, landing
from dugout.sources.store import TableStore, remove, shared_folder
from dugout.streaming.stream_ingest import landed_stream, stream_ingest

TODAY = date(2022, 1, 15)


def scratch(lake) -> TableStore:
    """A new empty store in the shared folder."""
    return TableStore(lake.spark, f"{shared_folder(lake.spark)}/scratch/{uuid.uuid4().hex}")


def lake_tables(lake) -> dict[str, DataFrame]:
    return {
        "players": lake.players, "games": lake.games, "pitches": lake.pitches, "at_bats": lake.at_bats,
        "league_pitch_state_summary": lake.league_state, "player_pitch_state_summary": lake.player_state,
        "pitch_transition_summary": lake.transitions,
    }


def built_store(lake) -> TableStore:
    """The lake's own store with every table written; only to be read."""
    lake_tables(lake)
    return lake.store


def loaded_store(lake) -> TableStore:
    """A scratch store holding the lake's tables; those with a season lie by it already and are written where they are read."""
    store = scratch(lake)
    for name, df in lake_tables(lake).items():
        store.replace(name, df, placed="season" in df.columns)
    return store


@query(
    "landing_range",
    """SELECT game_pk, at_bat_number, pitch_number, description, game_date FROM raw_pitches
       WHERE game_date BETWEEN '2018-04-20' AND '2019-05-10'""",
    "raw_pitches",
)
def landing_range(lake):
    lake.raw
    found = landing.read_pitches(lake.spark, lake.store.path("landing"), date(2018, 4, 20), date(2019, 5, 10))
    return found.select("game_pk", "at_bat_number", "pitch_number", "description", "game_date")


@query(
    "landing_game", "SELECT at_bat_number, pitch_number, description FROM raw_pitches WHERE game_pk = 11", "raw_pitches",
)
def landing_game(lake):
    lake.raw
    return landing.read_game(lake.spark, lake.store.path("landing"), 11).select(
        "at_bat_number", "pitch_number", "description"
    )


@query(
    "season_stat_source",
    f"""SELECT IDfg, Name, Team, AB, H FROM ({_BATTING_SQL}) f WHERE COALESCE(Season, 2019) = 2019""",
)
def season_stat_source(lake):
    store = scratch(lake)
    store.write_folder(_batting_feed(lake), store.path("stat_feed"))
    return landing.read_season_stats(lake.spark, store.path("stat_feed"), 2019).select("IDfg", "Name", "Team", "AB", "H")


@query(
    "upsert_store",
    """WITH latest AS (SELECT game_pk, MAX(at_bat_number) AS final_at_bat FROM pitches GROUP BY 1)
       SELECT pitch_id, at_bat_number, pitch_number, description,
         CAST(CASE WHEN p.game_pk % 5 = 0 AND at_bat_number = final_at_bat THEN game_date + INTERVAL 1 DAY
                   ELSE game_date END AS DATE) AS game_date
       FROM pitches p JOIN latest USING (game_pk)""",
    "pitches",
)
def upsert_store(lake):
    """All pitches of a store by week, after every fifth game came again with its last appearance on the next day."""
    store = TableStore(lake.spark, scratch(lake).root, partitions=("season", "week"))
    store.unstage(ingest.load(store, lake.raw))
    final = F.max("at_bat_number").over(W.partitionBy("game_pk"))
    later = F.date_format(F.date_add(F.to_date("game_date"), 1), "yyyy-MM-dd")
    suspended = (
        lake.raw.filter("game_pk % 5 = 0")
        .withColumn("_final", final)
        .withColumn("game_date", F.when(F.col("at_bat_number") == F.col("_final"), later).otherwise(F.col("game_date")))
        .drop("_final")
    )
    store.unstage(ingest.load(store, suspended))
    return store.read("pitches").select("pitch_id", "at_bat_number", "pitch_number", "description", "game_date")


@query(
    "json_safe",
    """SELECT pitch_id, CASE WHEN zone IN (1, 2, 3) THEN NULL ELSE release_speed END AS release_speed, plate_x FROM pitches""",
    "pitches",
)
def json_safe_query(lake):
    speed = (
        F.when(F.col("zone") == 1, F.lit(float("inf")))
        .when(F.col("zone") == 2, F.lit(float("-inf")))
        .when(F.col("zone") == 3, F.lit(float("nan")))
        .otherwise(F.col("release_speed"))
    )
    return json_safe(lake.pitches.select("pitch_id", speed.alias("release_speed"), "plate_x"))


@query(
    "season_players",
    """SELECT * FROM players WHERE player_id IN (SELECT pitcher_id FROM pitches WHERE season = 2019
       UNION SELECT batter_id FROM pitches WHERE season = 2019)""",
    "players", "pitches",
)
def season_players(lake):
    return bundles.season_players(lake.players, lake.pitches, 2019)


#: Tables that the SQL derives too.
_COMPARED = (
    "players", "games", "pitches", "at_bats", "league_pitch_state_summary", "player_pitch_state_summary", "pitch_transition_summary",
)
_DIGITS = 12
#: Columns that the feed does not fill.
_UNFILLED = (
    "release_extension", "release_pos_x", "release_pos_z", "sz_top", "sz_bot", "launch_speed", "launch_angle", "hit_distance_sc", "hc_x",
    "hc_y", "estimated_ba_using_speedangle", "woba_denom", "launch_speed_angle",
)


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table and season, and the sum of a digest over every column of each row; doubles as whole thousandths."""

    def text(field) -> Column:
        value = F.col(field.name)
        if field.dataType.typeName() == "double":
            value = F.floor(value * 1000 + 0.5).cast("bigint")
        return F.coalesce(value.cast("string"), F.lit("-"))

    parts = []
    for name, df in tables.items():
        row = F.md5(F.concat_ws("|", *[text(f) for f in sorted(df.schema.fields, key=lambda f: f.name)]))
        season = F.col("season") if "season" in df.columns else F.lit(None).cast("int")
        numbers = df.select(season.alias("season"), F.conv(F.substring(row, 1, _DIGITS), 16, 10).cast("bigint").alias("_number"))
        # Halves of 24 bits add up as longs, which is cheaper than decimals, and are put together at the end.
        halves = [F.shiftright("_number", 24), F.col("_number").bitwiseAND(F.lit((1 << 24) - 1))]
        high, low = (F.sum(half).cast("decimal(19,0)") for half in halves)
        digest = (high * F.lit(1 << 24).cast("decimal(8,0)") + low).cast("string")
        grouped = numbers.groupBy("season").agg(F.count(F.lit(1)).alias("row_count"), digest.alias("digest"))
        parts.append(grouped.select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


def digests_sql(where: str = "TRUE", names: tuple[str, ...] = _COMPARED) -> str:
    def text(field) -> str:
        if field.name in _UNFILLED:
            return "'-'"
        value = f"CAST(FLOOR({field.name} * 1000 + 0.5) AS BIGINT)" if field.dataType.typeName() == "double" else field.name
        return f"COALESCE(CAST({value} AS VARCHAR), '-')"

    parts = []
    for name in names:
        fields = sorted(TABLES[name].fields, key=lambda f: f.name)
        has_season = any(f.name == "season" for f in fields)
        row = f"md5(concat_ws('|', {', '.join(map(text, fields))}))"
        parts.append(
            f"SELECT '{name}' AS table_name, {'season' if has_season else 'CAST(NULL AS INT) AS season'}, COUNT(*) AS row_count,"
            f" CAST(SUM(CAST('0x' || substr({row}, 1, {_DIGITS}) AS BIGINT)) AS VARCHAR) AS digest"
            f" FROM {name} WHERE {where if has_season else 'TRUE'} GROUP BY {'season' if has_season else 'ALL'} HAVING COUNT(*) > 0"
        )
    return " UNION ALL ".join(parts)


def stored_digests(store: TableStore, names: tuple[str, ...] = _COMPARED) -> DataFrame:
    return digests({name: store.read(name) for name in names})


@query("season_bundle_roundtrip", digests_sql(), *_COMPARED)
def season_bundle_roundtrip(lake):
    """Every season out as a bundle, and all bundles in again."""
    source, target = built_store(lake), scratch(lake)
    root = f"{target.root}/exports"
    bundles.export_all(source, root)
    bundles.import_all(target, root)
    return stored_digests(target)


@query("export_import_all", digests_sql(), *_COMPARED)
def export_import_all(lake):
    """All seasons of every table out and in again; transitions are taken out of the export and so rebuilt."""
    source, target = built_store(lake), scratch(lake)
    root = f"{target.root}/exports"
    bundles.export_tables(source, root)
    remove(lake.spark, f"{root}/pitch_transition_summary.parquet")
    bundles.import_tables(target, root)
    return stored_digests(target)


@query("import_mixed_bundles", digests_sql(), *_COMPARED)
def import_mixed_bundles(lake):
    """Every season out and in again; only the bundles of even seasons lack transitions, so just these are rebuilt."""
    source, target = built_store(lake), scratch(lake)
    root = f"{target.root}/exports"
    for folder in bundles.export_all(source, root):
        if int(folder[-1]) % 2 == 0:
            remove(lake.spark, f"{folder}/pitch_transition_summary.parquet")
    bundles.import_all(target, root)
    return stored_digests(target)


@query(
    "load_season_smart",
    "SELECT run, loaded_from, t.* FROM (VALUES ('first', 'source'), ('second', 'parquet')) step(run, loaded_from),"
    f" ({digests_sql('season = 2018', _COMPARED[1:])}) t",
    *_COMPARED[1:],
)
def load_season_smart(lake):
    """Built from the source the first time, imported from its bundle the second."""
    root = f"{scratch(lake).root}/exports"
    runs = []
    for run in ("first", "second"):
        store = scratch(lake)
        came_from = ingest.load_season_smart(store, 2018, root, lake.raw, TODAY)
        runs.append(stored_digests(store, _COMPARED[1:]).select(F.lit(run).alias("run"), F.lit(came_from).alias("loaded_from"), "*"))
    return reduce(DataFrame.unionByName, runs)


@query("delete_season", digests_sql("season <> 2017"), *_COMPARED)
def delete_season(lake):
    store = loaded_store(lake)
    store.delete_season(2017, SEASON_TABLES)
    return stored_digests(store)


def _keys_sql(table: str, feed: str, season: int) -> str:
    key = "concat_ws(':', COALESCE(CAST(IDfg AS VARCHAR), replace(trim(COALESCE(Name, '')), ' ', '_')), COALESCE(NULLIF(trim(Team), ''), 'NA'))"
    return f"SELECT DISTINCT '{table}' AS table_name, COALESCE(Season, {season}) AS season, COALESCE(Season, {season}) || ':' || {key} AS row_key FROM ({feed}) f"


@query(
    "replace_season_stats",
    " UNION ALL ".join(
        [
            *(_keys_sql(t, f"SELECT * FROM ({_BATTING_SQL}) b WHERE HR > 10", 2019) for t in ("batting_standard_stats", "batting_value_stats")),
            *(_keys_sql(t, _PITCHING_SQL, 2019) for t in ("pitching_standard_stats", "pitching_value_stats")),
        ]
    ),
)
def replace_season_stats(lake):
    """All four stat tables; a second delivery of the batting feeds replaces the first."""
    store = scratch(lake)
    batting, pitching = ("batting_standard_stats", "batting_value_stats"), ("pitching_standard_stats", "pitching_value_stats")
    ingest.replace_season_stats(store, {t: _batting_feed(lake) for t in batting} | {t: _pitching_feed(lake) for t in pitching}, 2019)
    ingest.replace_season_stats(store, {t: _batting_feed(lake).filter("HR > 10") for t in batting}, 2019)
    stored = [store.read(name).select(F.lit(name).alias("table_name"), "season", "row_key") for name in batting + pitching]
    return reduce(DataFrame.unionByName, stored)


@query(
    "ingest_log",
    """SELECT CAST(row_number() OVER (ORDER BY start_date) AS BIGINT) AS run_id, start_date, end_date, rows_loaded, 'success' AS status FROM (
         SELECT DATE '2019-04-01' AS start_date, DATE '2019-05-31' AS end_date, COUNT(*) AS rows_loaded FROM pitches
         WHERE game_date BETWEEN DATE '2019-04-01' AND DATE '2019-05-31' HAVING COUNT(*) > 0
         UNION ALL
         SELECT DATE '2019-06-01', DATE '2019-08-31', COUNT(*) FROM pitches WHERE game_date BETWEEN DATE '2019-06-01' AND DATE '2019-08-31' HAVING COUNT(*) > 0) u""",
    "pitches",
)
def ingest_log(lake):
    store = scratch(lake)
    for start, end in ((date(2019, 4, 1), date(2019, 5, 31)), (date(2019, 6, 1), date(2019, 8, 31))):
        ingest.load_range(store, lake.raw, start, end)
    return store.read("ingestion_log").drop("run_at")


_BOUNDS_SQL = """CASE WHEN season = 2020 THEN DATE '2020-07-23' ELSE make_date(season, 3, 1) END AS expected_start_date,
    CASE WHEN season = 2020 THEN DATE '2020-09-27' ELSE make_date(season, 11, 15) END AS expected_end_date"""


@query(
    "backfill_status",
    f"""SELECT s.season, {_BOUNDS_SQL.replace('season', 's.season')}, COUNT(p.pitch_id) AS loaded_rows, TRUE AS completed
       FROM (SELECT CAST(unnest([2019, 2020]) AS INT) AS season) s
       LEFT JOIN pitches p ON p.season = s.season AND (p.season <> 2020 OR p.game_date BETWEEN DATE '2020-07-23' AND DATE '2020-09-27')
       GROUP BY ALL""",
    "pitches",
)
def backfill_status(lake):
    store = scratch(lake)
    ingest.backfill(store, lake.raw, [2019, 2020], TODAY)
    return store.read("season_backfill_status").drop("completed_at", "updated_at")


@query(
    "backfill_chunks",
    """SELECT start_date, least(start_date + INTERVAL 6 DAY, DATE '2018-11-15')::DATE AS end_date, COUNT(*) AS rows_loaded
       FROM (SELECT (DATE '2018-03-01' + CAST(datediff('day', DATE '2018-03-01', game_date) // 7 * 7 AS INT))::DATE AS start_date
             FROM pitches WHERE season = 2018) w GROUP BY ALL""",
    "pitches",
)
def backfill_chunks(lake):
    store = scratch(lake)
    ingest.backfill(store, lake.raw, [2018], TODAY, chunk_days=7)
    return store.read("ingestion_log").select("start_date", "end_date", "rows_loaded")


@query("incremental_update", digests_sql("season = 2021", _COMPARED[1:]), *_COMPARED[1:])
def incremental_update(lake):
    """A season loaded up to a date, then brought up to the day; the summaries' tallies are counted again by week."""
    store = TableStore(lake.spark, scratch(lake).root, partitions=("season", "week"))
    ingest.load_range(store, lake.raw, date(2021, 3, 1), date(2021, 6, 15), tally=True)
    ingest.incremental_update(store, lake.raw, date(2021, 12, 1))
    return stored_digests(store, _COMPARED[1:])


@query(
    "fill_games",
    """SELECT g.game_pk, g.season, g.game_date, concat(away_team, ' @ ', home_team) AS matchup, p.c AS pitches, TRUE AS filled
       FROM games g JOIN (SELECT game_pk, COUNT(*) AS c FROM pitches GROUP BY 1) p ON p.game_pk = g.game_pk WHERE g.game_pk % 7 = 3
       UNION ALL
       SELECT -game_pk - 1, season, game_date, concat(away_team, ' @ ', home_team), NULL, FALSE FROM games WHERE game_pk % 5 = 0""",
    "games", "pitches",
)
def fill_games(lake):
    store = scratch(lake)
    store.unstage(ingest.load(store, lake.raw.filter("game_pk % 7 <> 3")))
    return ingest.fill_games(store, schedule(lake), lake.raw)


@query(
    "stream_ingest",
    """SELECT pitch_id, game_pk, at_bat_number, pitch_number, pitcher_id, batter_id, inning_half, base_state, pitch_type, description,
       events, release_speed, game_date, season FROM pitches""",
    "pitches",
)
def stream_ingest_query(lake):
    """The landing folder read as a stream; the table equals the batch result."""
    store = _streamed(lake)
    return store.read("pitches").select(
        "pitch_id", "game_pk", "at_bat_number", "pitch_number", "pitcher_id", "batter_id", "inning_half", "base_state",
        "pitch_type", "description", "events", "release_speed", "game_date", "season",
    )


_STREAMED: dict[object, TableStore] = {}


def _streamed(lake) -> TableStore:
    """A store filled by the stream of the landing folder, summaries with it; once per lake."""
    if lake not in _STREAMED:
        lake.raw
        store = TableStore(lake.spark, scratch(lake).root, partitions=("season", "week"))
        stream = landed_stream(lake.spark, lake.store.path("landing"), lake.raw.schema, max_files=4)
        stream_ingest(store, stream, f"{store.root}/_checkpoint").awaitTermination()
        _STREAMED[lake] = store
    return _STREAMED[lake]


_STATE_TABLES = _COMPARED[4:]


@query("stream_summaries", digests_sql(names=_STATE_TABLES), *_STATE_TABLES)
def stream_summaries(lake):
    """The three summaries that the stream's batches left equal those of all pitches."""
    return stored_digests(_streamed(lake), _STATE_TABLES)
