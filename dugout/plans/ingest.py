"""Ingest, backfill, incremental update and gap filling over a table store."""

from __future__ import annotations

import warnings
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.functions import vocab
from dugout.operators import clean, players, quality, rollup, season_stats
from dugout.schemas import BACKFILL_STATUS, INGESTION_LOG, PITCHES, SEASON_TABLES, TABLES, conform
from dugout.sources import bundles, landing
from dugout.sources.store import TableStore, small_scans

DELETED_WITH_SEASON = SEASON_TABLES + ("season_backfill_status",)


def season_bounds(season: int, today: date) -> tuple[date, date]:
    """Calendar span pitches of a season can fall in."""
    if season < vocab.FIRST_SEASON:
        raise ValueError(f"pitch coverage starts in {vocab.FIRST_SEASON}")
    if season == vocab.SHORT_SEASON:
        start, end = date(season, 7, 23), date(season, 9, 27)
    else:
        start, end = date(season, 3, 1), date(season, 11, 15)
    return start, min(end, today) if season == today.year else end


def numbered(store: TableStore, rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Rows with consecutive numbers in the given order, staged.

    Rows are dealt into ordered ranges and numbered within each; ranges are offset
    by the rows before them, one count per range.  No task holds all rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits count within a partition.
    placed = ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    staged = store.stage(placed)
    offsets, start = {}, first
    for row in staged.groupBy("_range").count().orderBy("_range").collect():
        offsets[row["_range"]] = start
        start += row["count"]
    before = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("_range")] if offsets else F.lit(first)
    out = staged.withColumn(name, (before + F.col("_at")).cast("bigint")).drop("_range", "_at")
    out.staged_at = staged.staged_at
    return out


def _log_rows(store: TableStore, counted: DataFrame) -> None:
    """Append runs (start_date, end_date, rows_loaded) numbered after the last one."""
    last = store.read("ingestion_log").agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0]
    runs = numbered(store, counted, ["start_date", "end_date"], "run_id", last + 1)
    stamped = runs.withColumns({"status": F.lit("success"), "run_at": F.current_timestamp()})
    store.append("ingestion_log", conform(stamped, INGESTION_LOG))
    store.unstage(runs)


#: Repeated keys that are broadcast to tell their rows from the others: some 50 MB.
FEW_KEYS = 500_000


def one_per_key(rows: DataFrame) -> tuple[DataFrame, bool]:
    """One row per pitch out of rows that can be read again, and whether they stay where they lie.

    Keys are counted first, by a shuffle of nothing else.  Only rows of repeated
    keys are ranked then, and all rows where more keys are repeated than a broadcast holds.
    """
    repeated = clean.repeated_keys(rows)
    found = repeated.limit(FEW_KEYS + 1).count()
    if not found:
        return rows, True
    return (clean.dedupe_few(rows, repeated), True) if found <= FEW_KEYS else (clean.dedupe_pitches(rows), False)


def load(store: TableStore, raw: DataFrame) -> DataFrame:
    """Clean a batch of raw rows and upsert players, games, pitches and at-bats.

    Returns the stored form of the batch, staged (``store.unstage`` removes it), with
    ``removed_rows``, how many rows of unsupported game types were left out, and
    ``partitions``, those of the pitches that were written.
    Safe to repeat: every write is by key.
    Appearances of touched games are rolled up again from all their stored pitches,
    so a batch that corrects a single pitch leaves a whole at-bat.
    """
    seen = Observation()
    cleaned = clean.supported_games(clean.clean_pitches(raw), seen)
    extra = [c for c in ("home_team", "away_team") if c in cleaned.columns]
    landed = store.stage(_with_sides(cleaned, extra))
    rows, _ = one_per_key(landed)
    batch = landed if rows is landed else store.stage(rows)
    if batch is not landed:
        store.unstage(landed)
    pitches = batch.drop(*extra)
    pitches.staged_at, pitches.removed_rows, pitches.partitions = batch.staged_at, seen.get["removed"] or 0, []
    if batch.isEmpty():
        return pitches
    games = store.stage(clean.games_dim(batch))
    of_batch = games.select("game_pk")
    store.insert_ignore("players", clean.player_stubs(batch), ["player_id"])
    store.upsert("games", games, ["game_pk"])
    # A game may lie in several partitions, old ones among them; its at-bats lie nowhere else.
    touched = list(dict.fromkeys(store.touched(batch) + store.holding("pitches", of_batch)))
    before = store.version("pitches").within(touched)
    store.upsert("pitches", pitches, ["pitch_id"], locate=["game_pk"], partitions=touched)
    of_games = store.read("pitches", partitions=touched)
    # Partitions that held nothing before hold games of the batch only.
    of_games = of_games.join(of_batch, "game_pk", "left_semi") if before else of_games.filter("game_pk IS NOT NULL")
    with small_scans(store.spark):
        store.upsert("at_bats", rollup.at_bat_rollup(of_games), ["at_bat_id"], locate=["game_pk"], partitions=touched)
    store.unstage(games)
    pitches.partitions = touched
    return pitches


def _with_sides(cleaned: DataFrame, extra: list[str]) -> DataFrame:
    """Pitch columns plus the home and away team the games need."""
    return cleaned.select(
        *[
            (F.col(f.name) if f.name in cleaned.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in PITCHES.fields
        ],
        *extra,
    )


def load_range(store: TableStore, raw: DataFrame, start: date, end: date, tally: bool = False) -> int:
    """Load a date range and log it; returns rows loaded.  With ``tally`` summaries follow in the partitions it touched."""
    batch = load(store, landing.in_dates(raw, start, end))
    loaded = batch.count()
    if tally and batch.partitions:
        store.retally(batch.partitions)
    store.unstage(batch)
    if loaded:
        run = store.spark.createDataFrame([(start, end, loaded)], "start_date date, end_date date, rows_loaded bigint")
        _log_rows(store, run)
    return loaded


def mark_backfill(store: TableStore, rows: list[tuple[int, date, date, int, bool]]) -> None:
    """Record that the backfill of some seasons started or completed."""
    marked = store.spark.createDataFrame(
        rows, "season int, expected_start_date date, expected_end_date date, loaded_rows bigint, completed boolean"
    ).withColumns(
        {"completed_at": F.when(F.col("completed"), F.current_timestamp()), "updated_at": F.current_timestamp()}
    )
    store.upsert("season_backfill_status", conform(marked, BACKFILL_STATUS), ["season"])


def backfill(store: TableStore, raw: DataFrame, seasons: list[int], today: date, chunk_days: int = 7) -> dict[int, int]:
    """Load whole seasons in one job; chunks of days only appear in the log."""
    spans = [(s, *season_bounds(s, today)) for s in sorted(seasons)]
    mark_backfill(store, [(s, start, end, 0, False) for s, start, end in spans])
    loaded = load(store, reduce(DataFrame.unionByName, [landing.in_dates(raw, start, end) for _, start, end in spans]))
    # A chunk is found by arithmetic on the date, not by comparing with every chunk.
    starts = F.create_map(*[F.lit(x) for s, start, _ in spans for x in (s, start)])
    ends = F.create_map(*[F.lit(x) for s, _, end in spans for x in (s, end)])
    first = starts[F.year("game_date")]
    chunk_start = F.date_add(first, (F.floor(F.datediff("game_date", first) / chunk_days) * chunk_days).cast("int"))
    per_chunk = (
        loaded.groupBy(chunk_start.alias("start_date"), ends[F.year("game_date")].alias("span_end"))
        .agg(F.count(F.lit(1)).alias("rows_loaded"))
        .withColumn("end_date", F.least(F.date_add("start_date", chunk_days - 1), F.col("span_end")))
    )
    _log_rows(store, per_chunk)
    counted = {row["season"]: row["n"] for row in loaded.groupBy("season").agg(F.count(F.lit(1)).alias("n")).collect()}
    store.unstage(loaded)
    mark_backfill(store, [(s, start, end, counted.get(s, 0), True) for s, start, end in spans])
    return {s: counted.get(s, 0) for s, _, _ in spans}


def replace_season_stats(store: TableStore, feeds: dict[str, DataFrame], season: int) -> dict[str, int]:
    """Replace a season's rows of the stat tables from raw stat frames.

    Rows of the feed replace those of their keys, whichever season they carry; then
    stored rows of the season that the feed does not have go.  Nothing is removed
    before the new rows are there.  An empty feed removes the season's rows, with
    a warning.
    """
    written = {}
    for name, feed in feeds.items():
        # Dealt by key before they are ranked, rows are sorted in many small tasks, not where a large file is read.
        normalised = season_stats.normalise_season_stats(feed, season, name).repartition("row_key")
        one_per_key = normalised.withColumn(
            "_rank", F.row_number().over(W.partitionBy("row_key").orderBy(F.desc("stats_json")))
        ).filter("_rank = 1").drop("_rank")
        rows = store.stage(conform(one_per_key, TABLES[name]))
        written[name] = rows.count()
        if written[name]:
            store.upsert(name, rows, ["row_key"])
        else:
            warnings.warn(f"the feed of {name} for {season} is empty; the season's rows are removed", stacklevel=2)
        of_season = store.read(name, stamped=True).filter(F.col("season") == season)
        kept = of_season.join(rows.select("row_key"), "row_key", "left_semi")
        store.replace(name, kept, [f"season={season}"])
        store.unstage(rows)
    return written


def refresh_season(store: TableStore, seasons: list[int], stat_feeds: dict[int, dict[str, DataFrame]] | None = None) -> None:
    """Rebuild the summaries of some seasons, and their stats where feeds are given."""
    bundles.rebuild_summaries(store, seasons)
    refresh_stats(store, stat_feeds)


def refresh_stats(store: TableStore, stat_feeds: dict[int, dict[str, DataFrame]] | None) -> None:
    for season, feeds in (stat_feeds or {}).items():
        replace_season_stats(store, feeds, season)


def load_season_smart(store: TableStore, season: int, root: str, raw: DataFrame, today: date) -> str:
    """Import a season from its bundle, or build and export it; returns which."""
    folder = bundles.bundle_path(root, season)
    if bundles.bundle_exists(store, folder):
        bundles.import_bundle(store, folder)
        return "parquet"
    backfill(store, raw, [season], today)
    refresh_season(store, [season])
    bundles.export_season(store, season, root)
    return "source"


def load_season_range(
    store: TableStore, first: int, last: int, root: str, raw: DataFrame, today: date
) -> dict[int, str]:
    """Load an inclusive range of seasons, each from its bundle where there is one."""
    low, high = sorted((first, last))
    return {season: load_season_smart(store, season, root, raw, today) for season in range(low, high + 1)}


def load_all_history(store: TableStore, root: str, raw: DataFrame, today: date) -> dict[int, str]:
    return load_season_range(store, vocab.FIRST_SEASON, today.year, root, raw, today)


def enrich(store: TableStore, names: DataFrame, profiles: DataFrame) -> dict[str, int]:
    """Fill unnamed players, then bring every player's team up to date."""
    pitches, stored = store.read("pitches"), store.read("players")
    filled = store.stage(players.enrich_players(stored, pitches, names, profiles))
    refreshed = store.stage(players.refresh_player_teams(filled, pitches))
    # Only rows with new values are written, so that the others keep their stamp.
    store.upsert("players", refreshed.drop("team_changed").exceptAll(stored), ["player_id"])
    counted = refreshed.agg(
        F.count_if("team_changed").alias("teams_changed"), F.count_if(F.col("full_name").isNull()).alias("unnamed")
    ).first()
    store.unstage(filled, refreshed)
    return counted.asDict()


def ensure_history(store: TableStore, root: str, raw: DataFrame, today: date) -> DataFrame:
    """Load every expected season that is not complete; returns the coverage."""
    def coverage() -> DataFrame:
        return quality.history_coverage(store.read("pitches"), store.read("season_backfill_status"), today.year)

    missing = [row["season"] for row in coverage().filter("missing").select("season").collect()]
    for season in missing:
        load_season_smart(store, season, root, raw, today)
    return coverage()


def incremental_update(store: TableStore, raw: DataFrame, today: date, root: str | None = None) -> dict:
    """Load what came after the last stored date of the current season; summaries follow in the partitions it touched.

    With nothing stored the season is backfilled.
    """
    season = today.year
    of_season = store.read("pitches").filter(F.col("season") == season)
    latest = of_season.agg(F.max("game_date")).first()[0]
    if latest is None:
        added = backfill(store, raw, [season], today)[season]
        refresh_season(store, [season])
    elif latest + timedelta(days=1) > today:
        return {"rows_added": 0, "latest_game_date": latest, "season": season, "up_to_date": True}
    else:
        added = load_range(store, raw, latest + timedelta(days=1), today, tally=True)
    if root is not None:
        bundles.export_season(store, season, root)
    newest = store.read("pitches").filter(F.col("season") == season).agg(F.max("game_date")).first()[0]
    return {"rows_added": added, "latest_game_date": newest, "season": season, "up_to_date": False}


def recent_update(store: TableStore, raw: DataFrame, today: date, days: int = 7) -> int:
    """Reload the last days; summaries follow."""
    return load_range(store, raw, today - timedelta(days=max(days - 1, 0)), today, tally=True)


def rebuild_season(store: TableStore, raw: DataFrame, season: int, today: date) -> int:
    """Delete a season everywhere, load it again and derive it."""
    store.delete_season(season, DELETED_WITH_SEASON)
    loaded = backfill(store, raw, [season], today)[season]
    refresh_season(store, [season])
    return loaded


def fill_games(store: TableStore, schedule: DataFrame, raw: DataFrame) -> DataFrame:
    """Load scheduled games that are absent; summaries follow in the partitions they touch.

    Returns the schedule rows that were looked for, with pitches found, staged (``store.unstage`` removes them).
    """
    absent = store.stage(quality.missing_games(schedule, store.read("pitches")))
    loaded = load(store, raw.join(absent.select("game_pk"), "game_pk", "left_semi"))
    found = loaded.groupBy("game_pk", "game_date", "season").agg(F.count(F.lit(1)).alias("pitches"))
    filled = absent.join(found.select("game_pk", "pitches"), "game_pk", "left").withColumn("filled", F.col("pitches").isNotNull())
    report = store.stage(filled)
    per_day = found.groupBy(F.col("game_date").alias("start_date")).agg(F.sum("pitches").alias("rows_loaded"))
    _log_rows(store, per_day.withColumn("end_date", F.col("start_date")))
    if loaded.partitions:
        store.retally(loaded.partitions)
    store.unstage(loaded, absent)
    return report
