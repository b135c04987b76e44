import datetime

import pytest
from pyspark.sql import DataFrame

from dugout.plans import fixture, ingest
from dugout.plans.registry.storage import built_store
from dugout.reports import Reports


@pytest.fixture(scope="module")
def reports(lake):
    return Reports(built_store(lake))


CALLS = {
    "context": lambda r: r.context(2023),
    "coverage": lambda r: r.coverage(2023),
    "season_report": lambda r: r.season_report(2019),
    "freshness": lambda r: r.freshness(datetime.date(2021, 12, 1)),
    "search": lambda r: r.player_search("batter", "player", 5),
    "league_state": lambda r: r.pitch_state_league(2019, season_type="both", stand="all", balls=0),
    "player_state": lambda r: r.pitch_state_player(599970, "pitcher", 2019),
    "next_pitch": lambda r: r.next_pitch(2019, 0, 0, "FF"),
    "outcome_by_pitch": lambda r: r.outcome_by_pitch(2019, 0, 0),
    "count_splits": lambda r: r.count_splits(0, 0, min_pa=1, season=2019, stand="r"),
    "outcome_matrix": lambda r: r.outcome_matrix(window="career"),
    "final_count": lambda r: r.outcome_by_final_count(season_start=2016),
    "zone_map": lambda r: r.zone_map(window="last7"),
    "batter": lambda r: r.batter(600007, window="career"),
    "pitcher": lambda r: r.pitcher(599970, window="career"),
    "pitching": lambda r: r.pitching(season=2019),
    "team": lambda r: r.team("t3", window="career"),
    "count_profile": lambda r: r.count_profile(599970, season_start=2015, season_end=2021),
    "splits": lambda r: r.splits("batter", 600007, "stand", window="career"),
    "sequences": lambda r: r.sequences(min_occurrences=1, season=2019),
    "outcome_sequence": lambda r: r.outcome_sequence("ball,strike", window="career"),
    "sequence_compare": lambda r: r.sequence_compare("ball", [599970], window="career"),
    "at_bat": lambda r: r.at_bat(5, 12),
    "batting_leaders": lambda r: r.batting_leaders(season=2019, min_pa=1),
    "batting_leaders_count": lambda r: r.batting_leaders(window="career", min_pa=1, balls=0, strikes=0),
    "stuff_leaders": lambda r: r.stuff_leaders(season=2019, min_pitches=1),
    "stuff_leaders_career": lambda r: r.stuff_leaders(window="career", min_pitches=1),
}


@pytest.mark.parametrize("name", CALLS)
def test_report_has_rows(name, reports):
    found = CALLS[name](reports)
    parts = {"": found} if isinstance(found, DataFrame) else found
    assert all(df.limit(1).count() == 1 for df in parts.values())


def test_branch_of_the_leaderboard(reports):
    assert "hr_pct" in reports.batting_leaders(season=2019, min_pa=1).columns
    assert "hr_pct" not in reports.batting_leaders(season=2019, min_pa=1, outs=1).columns


def test_enrich_names_every_resolvable_player(lake, spark, store):
    ingest.load(store, lake.raw)
    names, profiles = (f(spark, lake.sf_dir) for f in (fixture.lookup_names, fixture.lookup_profiles))
    first = ingest.enrich(store, names, profiles)
    known = names.selectExpr("key_mlbam AS player_id").union(profiles.select("player_id")).distinct()
    unknown = store.read("players").join(known, "player_id", "left_anti").count()
    assert first["unnamed"] == unknown
    assert ingest.enrich(store, names, profiles)["teams_changed"] == 0


def test_season_range_prefers_bundles(lake, store, tmp_path):
    today = datetime.date(2022, 1, 1)
    root = str(tmp_path / "out")
    assert ingest.load_season_range(store, 2016, 2015, root, lake.raw, today) == {2015: "source", 2016: "source"}
    assert ingest.load_season_range(store, 2016, 2016, root, lake.raw, today) == {2016: "parquet"}
