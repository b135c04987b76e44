import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lake(spark):
    from dugout.plans.lake import Lake

    return Lake.of(spark, SMALL)


@pytest.fixture
def store(spark, tmp_path):
    from dugout.sources.store import TableStore

    return TableStore(spark, str(tmp_path / "store"))


PITCH_DEFAULTS = dict(
    game_pk=1, at_bat_number=1, pitch_number=1, pitcher_id=10, batter_id=20, pitcher_team=None, batter_team=None, stand="R",
    p_throws="L", inning=1, inning_half="Top", outs_when_up=0, balls=0, strikes=0, on_1b=None, on_2b=None, on_3b=None,
    base_state="000", pitch_type="FF", pitch_name="4-Seam Fastball", game_type="R", release_speed=90.0, description="ball",
    zone=5, type="B", bb_type=None, events=None, estimated_woba_using_speedangle=None, woba_value=None, season=2019,
)


@pytest.fixture
def pitches(spark):
    """Build a pitch frame from partial rows."""
    import datetime

    from dugout.schemas import PITCHES

    def build(*rows):
        full = []
        for row in rows:
            values = {**PITCH_DEFAULTS, "game_date": datetime.date(row.get("season", 2019) or 2019, 5, 1), **row}
            values.setdefault(
                "pitch_id", f"{values['game_pk']}_{values['at_bat_number']}_{values['pitch_number']}"
            )
            full.append(tuple(values.get(name) for name in PITCHES.names))
        return spark.createDataFrame(full, PITCHES)

    return build
