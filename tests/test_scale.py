"""What the steps that all queries share may shuffle, copy and repeat."""

import contextlib
import hashlib
import threading

import pytest
from pyspark.sql import functions as F
from test_lifecycle import same

from dugout.operators import clean, rollup, summaries
from dugout.plans import fixture, ingest
from dugout.plans.lake import Lake
from dugout.plans.registry import storage
from dugout.sources import bundles
from dugout.sources.store import SORTED_BYTES, TableStore, matching
from dugout.streaming.stream_ingest import landed_stream, stream_ingest


@contextlib.contextmanager
def partitions(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def source(spark, tmp_path):
    """Orders of many games and one of 40 lines."""
    lines = spark.range(4000).select(
        F.expr("CASE WHEN id < 40 THEN 7 ELSE id div 2 * 3 END").alias("l_orderkey"), (F.col("id") % 50).alias("l_partkey"),
        (F.col("id") % 11).alias("l_suppkey"), F.expr("CASE WHEN id < 40 THEN id + 1 ELSE id % 2 + 1 END").cast("int").alias("l_linenumber"),
        F.lit(1.5).alias("l_extendedprice"), F.lit(3.0).alias("l_quantity"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    lines.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_orderkey") % 9).alias("o_custkey")).distinct().write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    return str(tmp_path)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]


def test_landed_files_do_not_grow_with_shuffle_partitions(spark, source):
    # One batch of the stream takes four files, so their number is that of its batches.
    with partitions(spark, 200):
        lake = Lake(spark, source)
        rows = lake.raw.count()
    assert rows == 4000
    assert len(matching(spark, f"{lake.store.path('landing')}/season=*/*.parquet")) <= 7


def test_ranges_of_dates_change_no_row(spark, source, monkeypatch):
    one = fixture.raw_pitches(spark, source)
    whole = one.localCheckpoint()
    monkeypatch.setattr(fixture, "FILE_BYTES", 1000)
    many = fixture.raw_pitches(spark, source)
    assert same(many, whole)
    # The parts of a long order are dealt to several partitions.
    assert many.filter("game_pk = 0 AND at_bat_number % 64 = 8").select(F.spark_partition_id()).distinct().count() > 1


def test_pitches_without_repeats_are_not_shuffled(spark, source):
    lake = Lake(spark, source)
    rows, placed = ingest.one_per_key(clean.cleaned_pitches(lake.raw))
    assert placed and not exchanges(rows)
    assert same(lake.pitches, clean.prepare_pitches(lake.raw))


@pytest.mark.parametrize("few", [500_000, 1])
def test_repeats_are_dropped_as_by_ranking_all_rows(spark, pitches, monkeypatch, few):
    monkeypatch.setattr(ingest, "FEW_KEYS", few)
    rows = pitches(
        dict(pitch_number=1), dict(pitch_number=1, description="foul"), dict(pitch_number=2), dict(pitch_number=3), dict(pitch_number=3),
        dict(game_pk=None, pitch_number=None, pitch_id="a"), dict(game_pk=None, pitch_number=None, pitch_id="b"), dict(game_pk=None, pitch_number=4),
    )
    found, _ = ingest.one_per_key(rows)
    wanted = clean.dedupe_pitches(rows)
    assert found.count() == wanted.count() == 5
    assert same(found, wanted)


def test_state_summaries_shuffle_each_row_once(lake):
    # The first exchange carries rows, the last what was combined by group.
    assert len(exchanges(summaries.player_pitch_state(lake.pitches))) == 2


def test_stored_updates_are_not_copied(spark, lake, store, monkeypatch):
    store.unstage(ingest.load(store, lake.raw))
    root = f"{store.root}/exports"
    monkeypatch.setattr(bundles, "SUMMARY_TABLES", ())
    bundles.export_tables(store, root)
    target = TableStore(spark, f"{store.root}/target")
    stage, copied = target.stage, []
    monkeypatch.setattr(target, "stage", lambda df: copied.append(df.columns) or stage(df))
    for name in ("games", "pitches", "at_bats"):
        bundles._put(target, name, bundles._table(target, root, name))
        assert same(target.read(name), store.read(name))
    assert not copied


def test_placed_rows_are_written_without_a_sort(spark, source, tmp_path):
    store = TableStore(spark, str(tmp_path / "placed"))
    rows = clean.cleaned_pitches(Lake(spark, source).raw).filter("season >= 2017")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store.replace("pitches", rows, placed=True)
    assert same(store.read("pitches"), rows) and store.seasons("pitches") == list(range(2017, 2022))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_season_stats_are_dealt_by_key_before_they_are_ranked(spark, store, monkeypatch):
    kept = []
    stage = store.stage
    monkeypatch.setattr(store, "stage", lambda df: kept.append(exchanges(df)) or stage(df))
    feed = spark.createDataFrame([(1, "A", "T", 3), (1, "A", "T", 4), (2, "B", "T", 5)], "IDfg int, Name string, Team string, HR int")
    assert ingest.replace_season_stats(store, {"batting_standard_stats": feed}, 2019) == {"batting_standard_stats": 2}
    # One staged copy, from one shuffle: the map side does not rank.
    assert len(kept) == 1 and len(kept[0]) == 1
    assert sorted(r.hr for r in store.read("batting_standard_stats").collect()) == [4, 5]


def test_bundles_go_out_and_in_without_a_shuffle(spark, lake, store, monkeypatch):
    store.replace("pitches", lake.pitches)
    monkeypatch.setattr(bundles, "KEYS", {"pitches": bundles.KEYS["pitches"]})
    monkeypatch.setattr(bundles, "CORE_TABLES", ("pitches",))
    monkeypatch.setattr(bundles, "SUMMARY_TABLES", ())
    bundles.export_tables(store, f"{store.root}/exports")
    target = TableStore(spark, f"{store.root}/target")
    written, write = [], target.write_folder
    monkeypatch.setattr(target, "write_folder", lambda df, *a, **k: written.append((exchanges(df), k)) or write(df, *a, **k))
    bundles.import_tables(target, f"{store.root}/exports")
    assert same(target.read("pitches"), store.read("pitches"))
    assert written == [([], {"placed": True})]


def test_an_upsert_shuffles_only_rows_of_its_games(spark, pitches, store, monkeypatch):
    store.replace("pitches", pitches(
        dict(game_pk=1), dict(game_pk=1, pitch_number=2), dict(game_pk=2), dict(game_pk=3, at_bat_number=None, pitch_number=4, pitch_id="3_4"),
        dict(game_pk=None, at_bat_number=7, pitch_number=7, pitch_id="7_7"), dict(game_pk=4, season=2018),
    ))
    updates = pitches(
        dict(game_pk=1, description="foul"), dict(game_pk=1, pitch_number=3), dict(game_pk=None, at_bat_number=3, pitch_number=4, description="foul", pitch_id="3_4"),
        dict(game_pk=None, at_bat_number=7, pitch_number=7, pitch_id="7_7", description="foul"),
    )
    wanted = clean.upsert(store.read("pitches"), updates, ["pitch_id"]).localCheckpoint()
    written, write = [], store.write_folder
    monkeypatch.setattr(store, "write_folder", lambda df, *a, **k: written.append((df.count(), exchanges(df), k)) or write(df, *a, **k))
    store.upsert("pitches", updates, ["pitch_id"], locate=["game_pk"], partitions=["season=2019"])
    assert same(store.read("pitches"), wanted)
    # The row of game 2 lies in no game of the updates; rows whose key lacks a part may meet any other.
    (apart, shuffled, how), (merged, _, _) = written
    assert (apart, how, merged) == (1, {"placed": True}, 5)
    # Only the games of the updates are shuffled, to be told once each.
    assert all("hashpartitioning(game_pk" in line for line in shuffled) and len(shuffled) == 1


@pytest.mark.parametrize("few", [500_000, 0])
def test_an_upsert_of_many_games_leaves_the_same_rows(spark, lake, store, monkeypatch, few):
    monkeypatch.setattr("dugout.sources.store.FEW_PLACES", few)
    store.unstage(ingest.load(store, lake.raw.filter("game_pk % 3 > 0")))
    store.unstage(ingest.load(store, lake.raw.filter("game_pk % 3 < 2")))
    assert same(store.read("pitches"), lake.pitches) and same(store.read("at_bats"), lake.at_bats)


def test_appearances_of_no_game_are_not_rolled_up(spark, lake, store):
    raw = lake.raw.withColumn("game_pk", F.expr("IF(game_pk = 1, NULL, game_pk)"))
    for _ in range(2):
        store.unstage(ingest.load(store, raw))
        assert store.read("at_bats").filter("game_pk IS NULL").isEmpty() and not store.read("pitches").filter("game_pk IS NULL").isEmpty()


def test_summaries_are_written_where_they_are_combined(spark, source, store, monkeypatch):
    lake, of_store = Lake(spark, source), []
    pitches = lake.pitches
    for owner in (lake.store, store):
        write = owner.write_folder
        monkeypatch.setattr(owner, "write_folder", lambda df, *a, write=write, **k: of_store.append(k) or write(df, *a, **k))
    assert same(lake.transitions, summaries.pitch_transitions(pitches)) and same(lake.league_state, summaries.league_pitch_state(pitches))
    store.replace("pitches", pitches)
    of_store.pop()
    store.retally([f"season={season}" for season in store.seasons("pitches")])
    assert of_store == [{"placed": True}] * 5
    assert same(store.read("pitch_transition_summary"), lake.transitions)


def test_the_rollup_sorts_small_scans(spark, source, monkeypatch):
    lake, sizes = Lake(spark, source), []
    scanned = "spark.sql.files.maxPartitionBytes"
    before, kept, raw = spark.conf.get(scanned), lake._kept, lake.raw
    monkeypatch.setattr(lake, "_kept", lambda name, df, *a, **k: sizes.append((name, spark.conf.get(scanned))) or kept(name, df, *a, **k))
    assert same(lake.at_bats, rollup.at_bat_rollup(lake.pitches))
    assert sizes == [("pitches", before), ("at_bats", str(SORTED_BYTES))] and spark.conf.get(scanned) == before
    assert raw.count() == 4000


def test_pitches_are_shuffled_before_they_are_seen_from_both_sides(lake):
    rows, combined = sorted(exchanges(summaries.player_pitch_state(lake.pitches)), key=lambda line: "REPARTITION" not in line)
    assert "_part" in rows and "player_id" not in rows and "player_id" in combined


def test_weekly_tallies_are_written_where_they_are_combined(spark, lake, pitches, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "weeks"), partitions=("season", "week"))
    store.replace("pitches", lake.pitches.unionByName(pitches(dict(game_pk=-1, game_date=None, season=None), dict(game_pk=None, pitch_type=None))))
    written, write = [], store.write_folder
    monkeypatch.setattr(store, "write_folder", lambda df, *a, **k: written.append((len(exchanges(df)), k)) or write(df, *a, **k))
    with partitions(spark, 24):
        store.retally(store.touched(store.read("pitches")))
        for name, summary in summaries.SUMMARIES.items():
            assert same(store.read(name), summary.of(store.read("pitches"))), name
    # Pitches are shuffled, of the transitions those that are lent too, and what is counted, once each.
    assert [how for _, how in written] == [{"placed": True}] * 3 and [n for n, _ in written][:2] == [2, 2]


def test_the_stream_keeps_its_state_in_files(spark, lake, store, tmp_path):
    rows = lake.raw.filter("season = 2019").drop("season").limit(20)
    rows.write.parquet(str(tmp_path / "landing"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stream_ingest(store, landed_stream(spark, str(tmp_path / "landing"), rows.schema), str(tmp_path / "checkpoint"), refresh=False).awaitTermination()
    assert "RocksDBStateStoreProvider" in (tmp_path / "checkpoint" / "offsets" / "0").read_text()
    assert spark.conf.get(name) == before and spark.conf.get(name, None) is None


def test_tables_that_lie_by_season_are_copied_without_a_shuffle(lake, monkeypatch):
    written, write = [], TableStore.write_folder
    storage.lake_tables(lake)
    monkeypatch.setattr(TableStore, "write_folder", lambda self, df, *a, **k: written.append(("season" in df.columns, k)) or write(self, df, *a, **k))
    store = storage.loaded_store(lake)
    assert len(written) == 7 and all((how == {"placed": True}) == by_season for by_season, how in written)
    assert all(same(store.read(name), df) for name, df in storage.lake_tables(lake).items())


def test_digests_of_large_sums_are_exact(spark):
    rows = spark.range(100_000).select(F.lit(2019).alias("season"), F.col("id"))
    told = storage.digests({"t": rows}).first()
    wanted = sum(int(hashlib.md5(f"{i}|2019".encode()).hexdigest()[:12], 16) for i in range(100_000))
    assert (told.row_count, told.digest) == (100_000, str(wanted))


def test_seasons_are_exported_side_by_side(lake, store, monkeypatch):
    store.replace("pitches", lake.pitches.filter("season IN (2018, 2019)"))
    for name in ("players", "games", "at_bats", *summaries.SUMMARIES):
        store.replace(name, storage.lake_tables(lake)[name].limit(0 if name != "players" else 50))
    met, export = threading.Barrier(2, timeout=60), bundles.export_season
    monkeypatch.setattr(bundles, "export_season", lambda *a: (met.wait(), export(*a))[1])
    root = f"{store.root}/exports"
    assert bundles.export_all(store, root) == [f"{root}/season=2018", f"{root}/season=2019"]
    for season in (2018, 2019):
        assert same(bundles._table(store, f"{root}/season={season}", "pitches"), lake.pitches.filter(F.col("season") == season))
