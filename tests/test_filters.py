import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dugout.functions.keys import row_key, title_case
from dugout.functions.numbers import json_safe, rnd
from dugout.operators import batters, filters, presentation, season_stats, sequences
from dugout.operators.filters import Window, resolve_window

CONTEXT = Row(
    earliest_game_date=datetime.date(2015, 4, 1), latest_game_date=datetime.date(2021, 9, 30), earliest_season=2015,
    latest_season=2021,
)


def test_windows():
    assert resolve_window(CONTEXT) == Window(2021, 2021, 2021)
    assert resolve_window(CONTEXT, season=2018) == Window(2018, 2018, 2018)
    assert resolve_window(CONTEXT, "career", season=2018) == Window(season_start=2015, season_end=2021)
    assert resolve_window(CONTEXT, season_start=2019, season_end=2016) == Window(season_start=2016, season_end=2019)
    assert resolve_window(CONTEXT, season=2017, season_start=2016) == Window(season_start=2016, season_end=2017)
    week = resolve_window(CONTEXT, "last7")
    assert (week.start_date, week.end_date) == (datetime.date(2021, 9, 24), datetime.date(2021, 9, 30))
    assert resolve_window(None, season=2018) == Window(2018)


def test_last7_window_prunes_seasons(lake):
    plan = lake.pitches.filter(filters.filter_pitches(lake.window("last7")))._jdf.queryExecution().executedPlan().toString()
    assert "season" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_arguments_are_checked(lake):
    with pytest.raises(ValueError):
        filters.game_types("winter")
    with pytest.raises(ValueError):
        batters.situational_splits(lake.at_bats, 1, split_by="1; drop")
    with pytest.raises(ValueError):
        sequences.parse_outcomes("ball,balk")
    assert filters.game_types("postseason") == ("F", "D", "L", "W")
    assert filters.hand("all") is None and filters.hand("l") == "L"


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.5025,), (-0.5025,), (2.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(rnd(F.col("x"), 0)).collect()] == [1.0, -1.0, 3.0, -3.0]
    ratio = spark.createDataFrame([(201, 400)], "a int, b int").select(rnd(F.col("a") / F.col("b"))).first()[0]
    assert ratio == 0.502  # 0.5025 lies just below the half in binary


def test_title_case(spark):
    names = [" o'neil ", "MARY-jane", "van der  berg", "josé", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(title_case(F.col("n"))).collect()] == [
        n.strip().title() if n is not None else None for n in names
    ]


def test_row_key_marks_absent_parts(spark):
    df = spark.createDataFrame([(2019, None)], "a int, b string")
    assert df.select(row_key("a", "b")).first()[0] == "2019:NA"


def test_json_safe(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (float("inf"), "b"), (1.5, None)], "x double, y string")
    assert [tuple(r) for r in json_safe(df).collect()] == [(None, "a"), (None, "b"), (1.5, None)]


def test_season_stats_key_falls_back_to_name(spark):
    raw = spark.createDataFrame(
        [(5, "Jo Li", "AAA", 2019, 1.5), (None, " Jo Li ", " ", None, None)], "IDfg int, Name string, Team string, Season int, WAR double"
    )
    found = season_stats.normalise_season_stats(raw, 2020, "batting_value_stats").collect()
    assert [r.row_key for r in found] == ["2020:5:AAA", "2020:Jo_Li:NA"]
    assert [r.season for r in found] == [2019, 2020]
    assert found[0].wrc_plus is None and found[0].war == 1.5
    assert '"WAR":null' in found[1].stats_json


def _fold(outcomes):
    balls = strikes = 0
    for o in outcomes:
        if o == "ball":
            balls += 1
            if balls == 4:
                return balls, strikes, "Walk"
        elif o == "strike":
            strikes += 1
            if strikes == 3:
                return balls, strikes, "Strikeout"
        elif o == "foul":
            strikes = min(2, strikes + 1)
    return balls, strikes, None


@pytest.mark.parametrize(
    "outcomes",
    [[], ["ball"] * 4 + ["strike"], ["foul"] * 5, ["foul", "foul", "strike", "ball"], ["strike", "ball", "strike", "foul"]],
)
def test_derived_count(spark, outcomes):
    df = spark.createDataFrame([(outcomes,)], "o array<string>")
    row = df.select(sequences.derived_count(F.col("o")).alias("c")).first().c
    assert (row.balls, row.strikes, row.terminal_label) == _fold(outcomes)
    assert row.terminal == (_fold(outcomes)[2] is not None)


def test_presentation_handles_empty(spark):
    empty = spark.createDataFrame([], "balls int, strikes int, at_bats bigint, k_pct double, bb_pct double, avg_xwoba double")
    grid = presentation.dense_count_grid(empty).collect()
    assert len(grid) == 12 and {r.k_pct for r in grid} == {0.0}
    assert presentation.matrix_totals(empty).first()["count"] == "All"
    line = spark.createDataFrame([(0, 0, 0, 0, 0)], "hits int, walks int, total_bases int, at_bats int, pa int")
    assert presentation.slash_line(line).first().slash_avg == 0.0
