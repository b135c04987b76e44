"""Portable season bundles: one Parquet table per model table and a manifest."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.schemas import CORE_TABLES, SEASON_TABLES, STAT_TABLES, SUMMARY_TABLES, TABLES, TALLIES
from dugout.sources.store import TableStore, matching, path_exists, placed_writers

KEYS = {
    "players": ["player_id"],
    "games": ["season", "game_pk"],
    "pitches": ["season", "pitch_id"],
    "at_bats": ["season", "at_bat_id"],
    **{t: ["season", "row_key"] for t in SUMMARY_TABLES + STAT_TABLES},
}

#: Seasons that are exported at once.
EXPORTS = 4


def bundle_path(root: str, season: int) -> str:
    return f"{root.rstrip('/')}/season={season}"


def season_players(players: DataFrame, pitches: DataFrame, season: int) -> DataFrame:
    """Players who pitched or batted in a season."""
    seen = (
        pitches.filter(F.col("season") == season)
        .select(F.explode(F.array("pitcher_id", "batter_id")).alias("player_id"))
        .distinct()
    )
    return players.join(seen, "player_id", "left_semi")


def export_season(store: TableStore, season: int, root: str) -> str:
    """Write one season of every table, its players and a manifest; returns the folder."""
    folder = bundle_path(root, season)
    # Stat tables are optional: one that was never loaded is left out.
    names = [t for t in SEASON_TABLES if t not in STAT_TABLES or store.exists(t)]
    for name in names:
        rows = store.read(name).filter(F.col("season") == season)
        rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    players = season_players(store.read("players"), store.read("pitches"), season)
    players.write.mode("overwrite").parquet(f"{folder}/players.parquet")
    files = F.create_map(*[F.lit(x) for t in (*names, "players") for x in (t, f"{t}.parquet")])
    manifest = store.spark.range(1).select(
        F.lit(season).alias("season"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("exported_at"),
        files.alias("files"),
    )
    manifest.write.mode("overwrite").json(f"{folder}/metadata.json")
    return folder


def _seasons(store: TableStore) -> list[int]:
    rows = store.read("pitches").select("season").distinct().filter("season IS NOT NULL").orderBy("season").collect()
    return [row["season"] for row in rows]


def export_all(store: TableStore, root: str) -> list[str]:
    """A bundle of each season; jobs of some seasons run at once, since the short ones of one leave cores idle."""
    with ThreadPoolExecutor(EXPORTS) as pool:
        return list(pool.map(lambda season: export_season(store, season, root), _seasons(store)))


def export_tables(store: TableStore, root: str) -> list[str]:
    """All seasons of every table, each in one job, with seasons as partitions; returns the tables written.

    The manifest beside them has a row per table and season.
    """
    names = [t for t in KEYS if t not in STAT_TABLES or store.exists(t)]
    told = []
    for name in names:
        rows = store.read(name)
        if "season" in rows.columns:
            folded = bool(store.seasons(TALLIES[name])) if name in TALLIES else False
            # Stored rows lie by season already; those folded from tallies are gathered into few files.
            with nullcontext() if folded else placed_writers(store.spark):
                (rows.hint("rebalance", "season") if folded else rows).write.mode("overwrite").partitionBy("season").parquet(
                    f"{root}/{name}.parquet"
                )
            told += [(name, season) for season in store.seasons(TALLIES.get(name, name)) or store.seasons(name)]
        else:
            rows.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
            told.append((name, None))
    manifest = store.spark.createDataFrame(told, "table_name string, season int")
    manifest.withColumn("exported_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{root}/manifest.json")
    return names


def import_tables(store: TableStore, root: str) -> None:
    """Load what ``export_tables`` wrote, one read and one upsert per table, whatever the number of seasons."""
    missing = [name for name in CORE_TABLES if _table(store, root, name) is None]
    if missing:
        raise FileNotFoundError(f"{root} is incomplete, missing: {', '.join(missing)}")
    for name in KEYS:
        rows = _table(store, root, name)
        if rows is not None:
            _put(store, name, rows)
    absent = tuple(name for name in SUMMARY_TABLES if _table(store, root, name) is None)
    if absent:
        rebuild_summaries(store, _seasons(store), absent)


def _put(store: TableStore, name: str, rows: DataFrame) -> None:
    """Upsert imported rows; an imported summary takes the place of the season's tallies."""
    store.upsert(name, rows, KEYS[name], locate=["game_pk"] if "game_pk" in rows.columns else None, stored=name != "players")
    if name in TALLIES and store.exists(TALLIES[name]):
        for row in rows.select("season").distinct().collect():
            store.delete_season(row["season"], (TALLIES[name],))


def _table(store: TableStore, folder: str, name: str) -> DataFrame | None:
    path = f"{folder}/{name}.parquet"
    return store.spark.read.schema(TABLES[name]).parquet(path) if path_exists(store.spark, path) else None


def bundle_exists(store: TableStore, folder: str) -> bool:
    """A bundle counts as present once it holds pitches."""
    return _table(store, folder, "pitches") is not None


def _bundle_files(store: TableStore, folders: list[str]) -> dict[str, list[str]]:
    """Per table the files of it that bundle folders hold."""
    return {name: [f"{f}/{name}.parquet" for f in folders if path_exists(store.spark, f"{f}/{name}.parquet")] for name in KEYS}


def _bundle_season(store: TableStore, folder: str, pitches: DataFrame) -> int | None:
    path = f"{folder}/metadata.json"
    if path_exists(store.spark, path):
        row = store.spark.read.schema("season int").json(path, multiLine=True).select("season").first()
        if row is not None and row["season"] is not None:
            return row["season"]
    return pitches.agg(F.min("season")).first()[0]


def rebuild_summaries(store: TableStore, seasons: list[int], only: tuple[str, ...] = SUMMARY_TABLES) -> None:
    """Recompute summaries of some seasons from the stored pitches."""
    store.retally([f"season={season}" for season in seasons], only)


def import_bundle(store: TableStore, folder: str) -> None:
    """Load a bundle folder: core tables, then summaries or their rebuild, then stats."""
    _import(store, [folder])


def _import(store: TableStore, folders: list[str]) -> None:
    """Load bundle folders with one read per table; what each folder lacks is decided for it alone."""
    held = _bundle_files(store, folders)
    lacking = {f: [name for name in KEYS if f"{f}/{name}.parquet" not in held[name]] for f in folders}
    for folder in folders:
        missing = [name for name in CORE_TABLES if name in lacking[folder]]
        if missing:
            raise FileNotFoundError(f"bundle {folder} is incomplete, missing: {', '.join(missing)}")
    tables = {name: store.spark.read.schema(TABLES[name]).parquet(*files) for name, files in held.items() if files}
    for name in CORE_TABLES:
        rows = tables[name]
        if name == "players":
            # A player is in the bundle of every season played: the latest row is kept.
            latest = F.max_by(F.struct(*rows.columns), F.col("_metadata.file_path"))
            rows = rows.groupBy("player_id").agg(latest.alias("row")).select("row.*")
        _put(store, name, rows)
    for name in SUMMARY_TABLES + STAT_TABLES:
        if name in tables:
            _put(store, name, tables[name])
    rebuilt: dict[tuple[str, ...], list[int]] = {}
    for folder in folders:
        absent = [name for name in SUMMARY_TABLES if name in lacking[folder]]
        if not absent:
            continue
        season = _bundle_season(store, folder, _table(store, folder, "pitches"))
        # Both state summaries are rebuilt when either is absent.
        states = SUMMARY_TABLES[:2]
        only = (states if set(absent) & set(states) else ()) + tuple(t for t in absent if t not in states)
        if season is not None:
            rebuilt.setdefault(only, []).append(season)
    for only, seasons in rebuilt.items():
        rebuild_summaries(store, seasons, only)


def import_all(store: TableStore, root: str) -> None:
    """Load every bundle below a folder with one read per table; none is loaded if one lacks a core table."""
    folders = matching(store.spark, f"{root.rstrip('/')}/season=*")
    if not folders:
        raise FileNotFoundError(f"no bundle below {root}")
    _import(store, folders)
