import pytest
from pyspark.sql import functions as F

from dugout.operators import clean, pitch_state, pitchers, rollup, summaries


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_transitions_are_typed_pairs_seen_twice(lake):
    pairs = rollup.next_pitches(lake.pitches, {"nxt": ("pitch_type", 1)}).filter("pitch_type IS NOT NULL AND nxt IS NOT NULL")
    assert total(lake.transitions, "transitions") == 2 * pairs.count()


def test_tallies_fold_to_the_summaries(lake):
    for name, direct in zip(summaries.SUMMARIES, (lake.league_state, lake.player_state, lake.transitions)):
        summary = summaries.SUMMARIES[name]
        folded = summary.fold(summary.tallies(lake.pitches))
        assert folded.exceptAll(direct).count() == 0 and direct.exceptAll(folded).count() == 0, name


def test_league_pitches_equal_each_perspective(lake):
    assert total(lake.league_state, "pitches") == lake.pitches.count()
    for perspective in ("batter", "pitcher"):
        assert total(lake.player_state.filter(F.col("perspective") == perspective), "pitches") == lake.pitches.count()


def test_usage_shares_sum_to_one(lake):
    usage = pitch_state.pitch_state_league(lake.league_state)
    assert abs(total(usage, "usage_pct") - 1) < 0.01
    for row in pitchers.usage_by_count(lake.pitches).groupBy("balls", "strikes").agg(F.sum("usage_pct").alias("s")).collect():
        assert abs(row.s - 1) < 0.01


def test_row_keys_are_unique(lake):
    for df in (lake.league_state, lake.player_state, lake.transitions):
        assert df.count() == df.select("row_key").distinct().count()


def test_upsert_twice_is_once(lake):
    stored = lake.pitches.select("pitch_id", "season", "description")
    updates = stored.filter("season = 2019").withColumn(
        "description", F.lit("x")
    )
    once = clean.upsert(stored, updates, ["pitch_id"])
    twice = clean.upsert(once, updates, ["pitch_id"])
    assert once.exceptAll(twice).count() == 0 and once.count() == stored.count()


def test_rollup_covers_every_pitch(lake):
    assert total(lake.at_bats, "pitch_count") == lake.pitches.count()


@pytest.mark.parametrize("depth", [1, 6, 63, 64, 65, 80, 130, 199, 200])
def test_outcome_sequences_of_any_length(pitches, depth):
    """A list of one outcome over an appearance of 200 balls, against counting places."""
    from dugout.operators.sequences import outcome_sequences

    thrown = pitches(*[dict(pitch_number=i, description="ball") for i in range(1, 201)])
    at_bats = rollup.at_bat_rollup(thrown)
    found = outcome_sequences(thrown, at_bats, [["ball"] * depth]).first()
    assert (found.sequence_length, found.occurrences) == (depth, 201 - depth)
