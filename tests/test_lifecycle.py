import datetime

import pytest
from pyspark.sql import functions as F

from dugout.operators import clean, quality, rollup, summaries
from dugout.plans import ingest
from dugout.schemas import PITCHES, TABLES
from dugout.sources import bundles, landing
from dugout.sources.store import TableStore, shared_folder
from dugout.streaming.stream_ingest import landed_stream, stream_ingest

TODAY = datetime.date(2022, 1, 15)


def same(left, right):
    columns = sorted(left.columns)
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_shared_folder_is_the_session_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == named.rstrip("/")


def test_loading_twice_changes_nothing(lake, store):
    ingest.load(store, lake.raw)
    first = {t: store.read(t).count() for t in ("players", "games", "pitches", "at_bats")}
    ingest.load(store, lake.raw)
    assert first == {t: store.read(t).count() for t in first}
    assert same(store.read("pitches"), lake.pitches)
    assert same(store.read("at_bats"), lake.at_bats)
    assert same(store.read("games"), lake.games)


def test_correcting_one_pitch_rolls_up_the_whole_appearance(lake, store):
    ingest.load(store, lake.raw)
    game = lake.pitches.groupBy("game_pk", "at_bat_number").count().filter("count > 3").first()
    where = (F.col("game_pk") == game.game_pk) & (F.col("at_bat_number") == game.at_bat_number)
    correction = lake.raw.filter(where & (F.col("pitch_number") == 1)).withColumn("stand", F.lit("S"))
    ingest.load(store, correction)
    row = store.read("at_bats").filter(where).first()
    assert row.pitch_count == game["count"] and row.stand == "S"


def test_game_that_moves_season_leaves_no_copy(lake, store):
    ingest.load(store, lake.raw.filter("season IN (2018, 2019)"))
    before = store.read("pitches").count()
    moving = lake.pitches.filter("season = 2018").first().game_pk
    moved = lake.raw.filter(F.col("game_pk") == moving).withColumn("game_date", F.lit("2019-05-05"))
    ingest.load(store, moved)
    for table in ("games", "pitches", "at_bats"):
        seasons = [r.season for r in store.read(table).filter(F.col("game_pk") == moving).select("season").distinct().collect()]
        assert seasons == [2019]
    assert store.read("pitches").count() == before
    # The whole season moved: its partition must go with it.
    ingest.load(store, lake.raw.filter("season = 2018").withColumn("game_date", F.lit("2019-05-05")))
    assert [r.season for r in store.read("pitches").select("season").distinct().collect()] == [2019]
    assert store.read("pitches").count() == before


def test_bundle_roundtrip_is_identity(lake, spark, tmp_path):
    source, target = TableStore(spark, str(tmp_path / "a")), TableStore(spark, str(tmp_path / "b"))
    ingest.load(source, lake.raw)
    ingest.refresh_season(source, [r.season for r in lake.pitches.select("season").distinct().collect()])
    root = str(tmp_path / "out")
    assert len(bundles.export_all(source, root)) == 7
    bundles.import_all(target, root)
    for name in ("players", "games", "pitches", "at_bats", "league_pitch_state_summary", "pitch_transition_summary"):
        assert same(source.read(name), target.read(name)), name


def test_incomplete_bundle_is_refused(lake, store, tmp_path):
    lake.games.write.parquet(str(tmp_path / "season=2019" / "games.parquet"))
    with pytest.raises(FileNotFoundError, match="pitches"):
        bundles.import_bundle(store, str(tmp_path / "season=2019"))


def test_what_a_bundle_lacks_is_decided_for_it_alone(lake, spark, tmp_path):
    """Complete and incomplete bundles below one folder: rebuilt for the lacking seasons only, refused without a core table."""
    root = tmp_path / "out"

    def bundle(season, *names, marked=False):
        for name, frame in (
            ("players", lake.players), ("games", lake.games), ("pitches", lake.pitches), ("at_bats", lake.at_bats),
            ("league_pitch_state_summary", lake.league_state), ("player_pitch_state_summary", lake.player_state),
            ("pitch_transition_summary", lake.transitions),
        ):
            if name in names:
                rows = frame.filter(F.col("season") == season) if "season" in frame.columns else frame
                if marked and name == "league_pitch_state_summary":
                    rows = rows.withColumn("pitch_type", F.lit("marked"))
                rows.write.parquet(str(root / f"season={season}" / f"{name}.parquet"))

    core = ("players", "games", "pitches", "at_bats")
    states = ("league_pitch_state_summary", "player_pitch_state_summary")
    bundle(2018, *core, *states, marked=True)
    bundle(2019, *core, *states, "pitch_transition_summary")
    bundle(2020, *core, "player_pitch_state_summary", "pitch_transition_summary")
    store = TableStore(spark, str(tmp_path / "a"))
    bundles.import_all(store, str(root))
    within = F.col("season").isin(2018, 2019, 2020)
    assert same(store.read("pitch_transition_summary"), lake.transitions.filter(within))
    assert same(store.read("player_pitch_state_summary"), lake.player_state.filter(within))
    league = store.read("league_pitch_state_summary")
    assert same(league.filter("season <> 2018"), lake.league_state.filter("season IN (2019, 2020)"))
    assert league.filter("season = 2018").select("pitch_type").distinct().collect() == [("marked",)]
    bundle(2021, "players", "games", "pitches")
    with pytest.raises(FileNotFoundError, match="season=2021 .*at_bats"):
        bundles.import_all(TableStore(spark, str(tmp_path / "b")), str(root))


def test_bundle_written_by_another_engine_loads(lake, spark, store, tmp_path):
    """Single Parquet files with narrower numbers, an extra column and an indented manifest."""
    import duckdb

    folder = tmp_path / "season=2019"
    folder.mkdir()
    con = duckdb.connect()
    for name in ("players", "games", "pitches", "at_bats"):
        df = getattr(lake, name)
        if "season" in df.columns:
            df = df.filter("season = 2019")
        df.write.parquet(str(tmp_path / "plain" / name))
        narrow = {"bigint": "INTEGER", "double": "FLOAT"}
        columns = ", ".join(f'CAST("{c}" AS {narrow[t]}) AS "{c}"' if t in narrow else f'"{c}"' for c, t in df.dtypes)
        con.execute(
            f"COPY (SELECT {columns}, current_timestamp AS updated_at FROM '{tmp_path}/plain/{name}/*.parquet')"
            f" TO '{folder}/{name}.parquet' (FORMAT PARQUET)"
        )
    (folder / "metadata.json").write_text('{\n  "season": 2019,\n  "files": {}\n}')
    bundles.import_bundle(store, str(folder))
    assert same(store.read("pitches"), lake.pitches.filter("season = 2019"))
    assert same(store.read("at_bats"), lake.at_bats.filter("season = 2019"))
    assert same(store.read("league_pitch_state_summary"), lake.league_state.filter("season = 2019"))


def test_smart_load_uses_the_bundle(lake, spark, tmp_path):
    root = str(tmp_path / "out")
    assert ingest.load_season_smart(TableStore(spark, str(tmp_path / "a")), 2019, root, lake.raw, TODAY) == "source"
    again = TableStore(spark, str(tmp_path / "b"))
    assert ingest.load_season_smart(again, 2019, root, lake.raw.limit(0), TODAY) == "parquet"
    assert same(again.read("pitches"), lake.pitches.filter("season = 2019"))


def test_incremental_update_catches_up_and_then_rests(lake, store):
    today = datetime.date(2021, 12, 1)
    opening = lake.pitches.filter("season = 2021").agg(F.min("game_date")).first()[0]
    ingest.load_range(store, lake.raw, datetime.date(2021, 3, 1), opening)
    result = ingest.incremental_update(store, lake.raw, today)
    assert same(store.read("pitches"), lake.pitches.filter("season = 2021"))
    assert result["rows_added"] > 0 and not result["up_to_date"]
    latest = result["latest_game_date"]
    assert ingest.incremental_update(store, lake.raw, latest)["up_to_date"]
    assert [r.run_id for r in store.read("ingestion_log").orderBy("run_id").collect()] == [1, 2]


def test_history_is_completed(lake, store, tmp_path):
    coverage = ingest.ensure_history(store, str(tmp_path), lake.raw, datetime.date(2017, 12, 31))
    assert {(r.season, r.missing) for r in coverage.collect()} == {(2015, False), (2016, False), (2017, False)}
    assert quality.history_complete(coverage).first().history_complete


def test_rebuild_season_removes_stale_rows(lake, store):
    ingest.load(store, lake.raw)
    ghost = lake.pitches.filter("season = 2019").limit(1).withColumns({"pitch_id": F.lit("ghost"), "game_pk": F.lit(-5).cast("bigint")})
    store.upsert("pitches", store.stage(ghost), ["pitch_id"])
    ingest.rebuild_season(store, lake.raw, 2019, TODAY)
    assert same(store.read("pitches"), lake.pitches)


def test_landing_reads_by_date_and_prunes(lake, spark):
    lake.raw
    found = landing.read_pitches(spark, lake.store.path("landing"), datetime.date(2019, 4, 1), datetime.date(2019, 6, 30))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "season" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert found.filter("game_date < '2019-04-01' OR game_date > '2019-06-30'").count() == 0 and found.count() > 0
    with pytest.raises(ValueError):
        landing.read_pitches(spark, "x", fmt="xml")


def test_stream_equals_batch_with_copies_and_late_files(lake, spark, store, tmp_path):
    """Files out of date order, each pitch delivered twice in different files."""
    folder = str(tmp_path / "landing")
    columns = [c for c in lake.raw.columns if c != "season"]
    for season in (2021, 2015, 2018):
        part = lake.raw.filter(F.col("season") == season).select(*columns).coalesce(1)
        part.write.mode("append").parquet(folder)
        part.write.mode("append").parquet(folder)
    schema = lake.raw.select(*columns).schema
    checkpoint = str(tmp_path / "checkpoint")
    stream_ingest(store, landed_stream(spark, folder, schema, max_files=1), checkpoint).awaitTermination()
    expected = lake.pitches.filter("season IN (2015, 2018, 2021)")
    assert same(store.read("pitches"), expected)
    assert same(store.read("at_bats"), rollup.at_bat_rollup(expected))
    assert same(store.read("pitch_transition_summary"), lake.transitions.filter("season IN (2015, 2018, 2021)"))
    # A replay from the start, as after a lost checkpoint, changes nothing.
    again = stream_ingest(store, landed_stream(spark, folder, schema), str(tmp_path / "checkpoint2"), refresh=False)
    again.awaitTermination()
    assert same(store.read("pitches"), expected)


def test_partitioning_is_configurable(lake, spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "fine"), partitions=("season", "game_date"))
    ingest.load(store, lake.raw.filter("season = 2019"))
    assert same(store.read("pitches"), lake.pitches.filter("season = 2019"))
    assert store.read("pitches").columns == PITCHES.names


def test_thin_dates_and_verdicts(pitches):
    df = pitches(*[dict(game_pk=g, season=s) for s, n in ((2018, 3), (2019, 5)) for g in range(s * 100, s * 100 + n)])
    verdicts = {r.season: r.verdict for r in quality.game_count_verdict(df, F.lit(4)).collect()}
    assert verdicts == {2018: "CLOSE", 2019: "CLOSE"}
    thin = quality.thin_dates(df, F.when(F.col("season") == 2018, 3).otherwise(9)).collect()
    assert [(r.season, r.games) for r in thin] == [(2019, 5)]


LAYOUTS = [("season",), ("season", "game_date")]


def two_game_feed(lake, first_date, second_dates):
    """Two games of the feed: one on a given date, one whose last appearance is on another date than the rest."""
    games = [r.game_pk for r in lake.raw.select("game_pk").distinct().orderBy("game_pk").limit(2).collect()]
    one = lake.raw.filter(F.col("game_pk") == games[0]).withColumn("game_date", F.lit(first_date))
    other = lake.raw.filter(F.col("game_pk") == games[1])
    last = other.agg(F.max("at_bat_number")).first()[0]
    moved = F.when(F.col("at_bat_number") == last, F.lit(second_dates[1])).otherwise(F.lit(second_dates[0]))
    return games, one, other.withColumn("game_date", moved)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("dates", [("2019-05-05", ("2019-05-04", "2019-05-05")), ("2019-12-31", ("2019-12-31", "2020-01-01"))])
def test_a_game_over_two_partitions_loses_nothing(lake, spark, tmp_path, layout, dates):
    store = TableStore(spark, str(tmp_path / "s"), partitions=layout)
    games, one, other = two_game_feed(lake, *dates)
    ingest.load(store, one.withColumn("game_date", F.lit(dates[1][1])))
    ingest.load(store, other)
    ingest.load(store, other)
    whole = one.withColumn("game_date", F.lit(dates[1][1])).unionByName(other)
    wanted = clean.prepare_pitches(whole)
    assert same(store.read("pitches"), wanted)
    assert same(store.read("at_bats"), rollup.at_bat_rollup(wanted))
    # Coming again on one date, the game leaves the partitions it was in.
    back = other.withColumn("game_date", F.lit(dates[1][0]))
    ingest.load(store, back)
    wanted = clean.prepare_pitches(one.withColumn("game_date", F.lit(dates[1][1])).unionByName(back))
    assert same(store.read("pitches"), wanted)
    assert same(store.read("at_bats"), rollup.at_bat_rollup(wanted))


def test_upsert_leaves_other_partitions_alone(lake, spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"), partitions=("season", "game_date"))
    store.replace("pitches", lake.pitches)
    counts = {tuple(r): r["count"] for r in store.read("pitches").groupBy("season", "game_date").count().collect()}
    store.upsert("pitches", lake.pitches.limit(3).withColumn("pitch_name", F.lit("changed")), ["pitch_id"], locate=["game_pk"])
    assert counts == {tuple(r): r["count"] for r in store.read("pitches").groupBy("season", "game_date").count().collect()}
    assert store.read("pitches").filter("pitch_name = 'changed'").count() == 3


@pytest.mark.parametrize("layout", LAYOUTS)
def test_a_bundle_with_pitches_of_more_seasons_than_its_games(lake, spark, tmp_path, layout):
    store = TableStore(spark, str(tmp_path / "s"), partitions=layout)
    for name, frame in (("players", lake.players), ("games", lake.games), ("pitches", lake.pitches), ("at_bats", lake.at_bats)):
        store.replace(name, frame)
    folder = str(tmp_path / "out" / "season=2018")
    stray = lake.pitches.filter("season = 2019").limit(2).withColumn("pitch_name", F.lit("changed"))
    for name, frame in (
        ("players", lake.players), ("games", lake.games.filter("season = 2018")),
        ("pitches", lake.pitches.filter("season = 2018").unionByName(stray)), ("at_bats", lake.at_bats.filter("season = 2018")),
        ("league_pitch_state_summary", lake.league_state.filter("season = 2018")),
        ("player_pitch_state_summary", lake.player_state.filter("season = 2018")),
        ("pitch_transition_summary", lake.transitions.filter("season = 2018")),
    ):
        frame.write.parquet(f"{folder}/{name}.parquet")
    bundles.import_bundle(store, folder)
    assert store.read("pitches").count() == lake.pitches.count()
    assert same(store.read("at_bats"), lake.at_bats)
    assert store.read("pitches").filter("pitch_name = 'changed'").count() == 2


def test_a_stat_feed_of_two_seasons_keeps_other_rows(spark, store):
    feed = lambda *rows: {"batting_standard_stats": spark.createDataFrame(rows, "Season int, IDfg int, Name string, Team string, AB int")}
    ingest.replace_season_stats(store, feed((2018, 1, "A", "X", 5), (2018, 2, "B", "X", 6)), 2018)
    assert ingest.replace_season_stats(store, feed((2019, 1, "A", "X", 7), (2018, 3, "C", "X", 9)), 2019) == {"batting_standard_stats": 2}
    stored = sorted((r.season, r.row_key) for r in store.read("batting_standard_stats").select("season", "row_key").collect())
    assert len(stored) == 4 and [s for s, _ in stored] == [2018, 2018, 2018, 2019]
    # The same key comes again under another season, and one of the season is gone.
    ingest.replace_season_stats(store, feed((2019, 3, "C", "X", 8)), 2019)
    stored = sorted((r.season, r.row_key) for r in store.read("batting_standard_stats").select("season", "row_key").collect())
    assert stored == [(2018, "2018:1:X"), (2018, "2018:2:X"), (2019, "2019:3:X")]
    with pytest.warns(UserWarning, match="empty"):
        ingest.replace_season_stats(store, {k: f.limit(0) for k, f in feed((2019, 1, "A", "X", 7)).items()}, 2019)
    assert {r.season for r in store.read("batting_standard_stats").collect()} == {2018}


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["write_folder", "matching", "create"])
def test_a_writer_killed_at_any_step_changes_nothing(spark, store, monkeypatch, step):
    """Readers see the state before, a pinned state stays, and the next writer goes on."""
    from dugout.sources import store as module

    rows = lambda *pairs: spark.createDataFrame(list(pairs), "season int, id int")
    seen = lambda **how: sorted(tuple(r) for r in store.read("odd", **how).select("season", "id").collect())
    store.replace("odd", rows((1, 1), (2, 2)))
    pinned = store.version("odd")

    def die(*args, **kwargs):
        if step == "write_folder":
            write(*args, **kwargs)
        elif step == "create":
            # The manifest is cut off before its last line.
            make(spark, args[1], args[2].rsplit("\n", 1)[0])
        raise Killed

    write, make = store.write_folder, module.create
    with monkeypatch.context() as broken:
        broken.setattr(store if step == "write_folder" else module, step, die)
        if step == "matching":
            # Killed once the pieces are written, while they are listed.
            broken.setattr(store, "version", lambda name: pinned)
        with pytest.raises(Killed):
            store.replace("odd", rows((2, 3)))
    assert seen() == [(1, 1), (2, 2)] == seen(version=pinned)
    store.replace("odd", rows((2, 4)))
    assert seen() == [(1, 1), (2, 4)] and seen(version=pinned) == [(1, 1), (2, 2)]
    assert store.version("odd").number > pinned.number
    dead = store.vacuum("odd")
    assert len(dead) >= 1 and seen() == [(1, 1), (2, 4)] and store.vacuum("odd") == []


def test_of_two_writers_the_second_fails(spark, store):
    rows = spark.createDataFrame([(1, 1)], "season int, id int")
    store.replace("odd", rows)
    start = store.version("odd")
    store.append("odd", rows)
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish("odd", start, [])
    assert store.read("odd").count() == 2


def test_weekly_tallies_follow_small_batches(lake, spark, tmp_path):
    """Batches of a store by week touch the tallies of their weeks only, and all summaries equal those of one batch."""
    store = TableStore(spark, str(tmp_path / "weeks"), partitions=("season", "week"))
    season = lake.raw.filter("season = 2019")
    edge = season.agg(F.max("game_date")).first()[0]
    early = season.filter(F.col("game_date") < edge)
    first = ingest.load(store, early)
    store.retally(first.partitions)
    before = store.version("player_pitch_state_summary_by_date")
    late = season.filter(F.col("game_date") == edge)
    second = ingest.load(store, late)
    store.retally(second.partitions)
    after = store.version("player_pitch_state_summary_by_date")
    changed = {f.rsplit("/", 1)[0] for f in set(before.folders) ^ set(after.folders)}
    assert changed <= set(second.partitions) and set(before.folders) & set(after.folders)
    stored = store.read("pitches")
    for name, summary in summaries.SUMMARIES.items():
        assert same(store.read(name), summary.of(stored)), name


def test_an_appearance_over_two_weeks_counts_once(pitches, spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "weeks"), partitions=("season", "week"))
    days = [datetime.date(2019, 5, 1), datetime.date(2019, 5, 20)]
    store.replace("pitches", pitches(*(dict(game_pk=9, pitch_number=i + 1, game_date=d) for i, d in enumerate(days))))
    for _ in range(2):
        for partition in store.touched(store.read("pitches")):
            store.retally([partition])
        assert [r.plate_appearances for r in store.read("league_pitch_state_summary").collect()] == [1]
        assert [r.pitches for r in store.read("league_pitch_state_summary").collect()] == [2]


def test_rows_with_new_values_alone_are_stamped_anew(spark, store):
    feed = lambda *rows: {"batting_standard_stats": spark.createDataFrame(rows, "Season int, IDfg int, Name string, Team string, AB int")}
    stamps = lambda: {r.row_key: r.updated_at for r in store.read("batting_standard_stats", stamped=True).collect()}
    ingest.replace_season_stats(store, feed((2018, 1, "A", "X", 5)), 2018)
    first = stamps()
    ingest.replace_season_stats(store, feed((2019, 2, "B", "X", 5)), 2019)
    second = stamps()
    assert second["2018:1:X"] == first["2018:1:X"] < second["2019:2:X"]
    assert "updated_at" not in store.read("batting_standard_stats").columns
    players = lambda *rows: spark.createDataFrame(rows, TABLES["players"])
    store.upsert("players", players((1, "a", None, None, None, None), (2, "b", None, None, None, None)), ["player_id"])
    before = {r.player_id: r.updated_at for r in store.read("players", stamped=True).collect()}
    store.upsert("players", players((2, "c", None, None, None, None)), ["player_id"])
    after = {r.player_id: r.updated_at for r in store.read("players", stamped=True).collect()}
    assert after[1] == before[1] and after[2] > before[2]


def test_removed_rows_are_reported(lake, store):
    loaded = ingest.load(store, lake.raw)
    assert loaded.removed_rows == lake.raw.filter("game_type NOT IN ('R','F','D','L','W') OR game_type IS NULL").count() > 0


def test_numbers_of_the_log_need_no_single_task(spark, store, capsys):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "start_date int").repartition(5)
    numbered = ingest.numbered(store, rows, ["start_date"], "run_id", 4)
    assert sorted((r.start_date, r.run_id) for r in numbered.collect()) == [(i, i + 4) for i in range(101)]
    numbered.explain()
    assert "SinglePartition" not in capsys.readouterr().out


def test_repeats_within_the_horizon_reach_no_rewrite(lake, spark, store, tmp_path):
    """Over a restart; a correction and a row of an old game still come through."""
    folder, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    raw = lake.raw.filter("season = 2019 AND game_pk % 3 = 0").drop("season")

    def deliver(rows):
        rows.write.mode("append").parquet(folder)
        stream_ingest(store, landed_stream(spark, folder, rows.schema), checkpoint).awaitTermination()
        return store.version("pitches").number

    first = deliver(raw)
    assert deliver(raw) == first
    key = raw.filter("game_type = 'R'").select("game_pk", "at_bat_number", "pitch_number").first()
    where = (F.col("game_pk") == key[0]) & (F.col("at_bat_number") == key[1]) & (F.col("pitch_number") == key[2])
    assert deliver(raw.filter(where).withColumn("description", F.lit("foul"))) > first
    assert store.read("pitches").filter(where).first().description == "foul"
    old = lake.raw.filter("season = 2016 AND game_type = 'R'").drop("season").limit(3)
    deliver(old)
    assert store.read("pitches").filter("season = 2016").count() == 3


def test_all_seasons_out_and_in_with_one_job_a_table(lake, spark, tmp_path):
    source, target = TableStore(spark, str(tmp_path / "a")), TableStore(spark, str(tmp_path / "b"))
    source.unstage(ingest.load(source, lake.raw))
    ingest.refresh_season(source, source.seasons("pitches"))
    root = str(tmp_path / "out")
    bundles.export_tables(source, root)
    bundles.import_tables(target, root)
    for name in ("players", "games", "pitches", "at_bats", *summaries.SUMMARIES):
        assert same(source.read(name), target.read(name)), name
    # An import takes the place of tallies, and a refresh that of the import.
    ingest.refresh_season(target, [2019])
    assert target.seasons("pitch_transition_summary_by_date") == [2019]
    assert same(source.read("pitch_transition_summary"), target.read("pitch_transition_summary"))


def test_staging_is_removed(lake, store):
    import os

    store.unstage(ingest.load(store, lake.raw))
    assert os.listdir(f"{store.root}/_staging") == []


def test_team_of_a_player_in_both_roles(pitches):
    """Pitching comes first, however old; among its rows the newest counts."""
    from dugout.operators.players import latest_recorded_team

    rows = pitches(
        dict(game_pk=1, pitcher_id=7, batter_id=8, pitcher_team="OLD", batter_team="X"),
        dict(game_pk=2, pitcher_id=7, batter_id=8, pitcher_team="NEW", batter_team=None),
        dict(game_pk=3, pitcher_id=9, batter_id=7, pitcher_team=None, batter_team="LATE"),
    )
    assert {r.player_id: r.team for r in latest_recorded_team(rows).collect()} == {7: "NEW", 8: "X"}
