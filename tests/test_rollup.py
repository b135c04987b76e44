import itertools
import random

import pytest
from pyspark.sql import functions as F

from dugout.functions.keys import base_state
from dugout.operators import appearances, clean, players, rollup, sequences, summaries


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_first_and_last_skip_nulls_per_column(pitches):
    df = pitches(
        dict(pitch_number=1, stand=None, on_2b=None, events=None, pitch_type="SL", balls=0),
        dict(pitch_number=2, stand="L", on_2b=77, events="single", pitch_type="CH", balls=1, woba_value=0.875),
        dict(pitch_number=3, stand="R", on_2b=78, events=None, pitch_type=None, balls=2),
    )
    row = rollup.at_bat_rollup(df).first()
    assert (row.stand, row.on_2b, row.final_event, row.final_pitch_type) == ("L", 77, "single", "CH")
    assert (row.pitch_count, row.final_count, row.woba_value) == (3, "2-0", 0.875)
    assert row.inning_half == "top"


def test_full_count_needs_both_on_one_pitch(pitches):
    df = pitches(
        dict(at_bat_number=1, pitch_number=1, balls=3, strikes=0),
        dict(at_bat_number=1, pitch_number=2, balls=0, strikes=2),
        dict(at_bat_number=2, pitch_number=1, balls=3, strikes=2),
    )
    found = rows(rollup.at_bat_rollup(df), "at_bat_number", "reached_2strike", "reached_3ball", "reached_full")
    assert found == [(1, True, True, False), (2, True, True, True)]


def test_pinch_hitter_leaves_the_starter_in_the_rollup(pitches):
    df = pitches(dict(pitch_number=1, batter_id=20), dict(pitch_number=2, batter_id=21, events="walk"))
    assert rollup.at_bat_rollup(df).first().batter_id == 20
    shared = appearances.of_pitches(rollup.at_bat_rollup(df), df, "batter_id")
    assert rows(shared, "batter_id", "final_event") == [(20, "walk"), (21, "walk")]


def test_empty_input(pitches):
    empty = pitches().limit(0)
    assert rollup.at_bat_rollup(empty).count() == 0
    assert summaries.league_pitch_state(empty).count() == 0
    assert summaries.pitch_transitions(empty).count() == 0


def test_missing_columns_become_null(pitches):
    df = pitches(dict(pitch_number=1)).drop("stand", "events", "inning_half").withColumn("inning_topbot", F.lit("Bot"))
    row = rollup.at_bat_rollup(df).first()
    assert row.stand is None and row.final_event is None and row.inning_half == "bot"


@pytest.mark.parametrize("occupied", list(itertools.product([None, 5], repeat=3)))
def test_base_states(spark, occupied):
    df = spark.createDataFrame([occupied], "a int, b int, c int").select(base_state(F.col("a"), F.col("b"), F.col("c")).alias("s"))
    assert df.first().s == "".join("0" if v is None else "1" for v in occupied)


def test_dedupe_keeps_one_whole_row(pitches):
    df = pitches(
        dict(pitch_number=1, release_speed=95.0, description="foul"),
        dict(pitch_number=1, release_speed=91.0, description="ball"),
        dict(pitch_number=2),
    )
    kept = clean.dedupe_pitches(df, [F.desc("release_speed")])
    assert rows(kept, "pitch_number", "description") == [(1, "foul"), (2, "ball")]


def _long_appearances(pitches, seed=3):
    """Appearances with gaps in their pitch numbers, some far longer than a segment."""
    rng = random.Random(seed)
    kinds = ["ball", "called_strike", "foul", "hit_into_play", "swinging_strike"]
    made = []
    for at_bat, longest in enumerate((1, 3, 9, 150, 400), start=1):
        for number in range(1, longest + 1):
            if rng.random() < 0.1 and longest > 3:
                continue
            made.append(
                dict(
                    at_bat_number=at_bat, pitch_number=number, description=rng.choice(kinds), pitcher_id=10 + number // 90,
                    pitch_type=rng.choice(["FF", "SL", None]), events=rng.choice([None, None, "strikeout", "single"]),
                    balls=rng.choice([0, 1, 2, 3, None, 9, -1]), strikes=rng.choice([0, 1, 2, None, 70]),
                )
            )
    return made, pitches(*made)


@pytest.mark.parametrize("segment", [1, 2, 7, 1024])
def test_next_pitches_over_segments_equal_brute_force(pitches, monkeypatch, segment):
    """Gaps in the numbers, segments with fewer pitches than steps, and empty ones."""
    made, df = _long_appearances(pitches)
    monkeypatch.setattr(rollup, "SEGMENT", segment)
    fields = {"next_type": ("pitch_type", 1), "next_number": ("pitch_number", 1), "third": ("pitch_number", 2)}
    found = {(r.at_bat_number, r.pitch_number): (r.next_type, r.next_number, r.third) for r in rollup.next_pitches(df, fields).collect()}
    by_at_bat = {}
    for row in made:
        by_at_bat.setdefault(row["at_bat_number"], []).append(row)
    expected = {}
    for at_bat, rows in by_at_bat.items():
        rows = [*sorted(rows, key=lambda r: r["pitch_number"]), {}, {}]
        for row, one, two in zip(rows, rows[1:], rows[2:]):
            expected[at_bat, row["pitch_number"]] = one.get("pitch_type"), one.get("pitch_number"), two.get("pitch_number")
    assert found == expected


@pytest.mark.parametrize("segment", [1, 40, 1024])
def test_lists_of_any_length_equal_brute_force(pitches, monkeypatch, segment):
    """Lists shorter than, as long as and longer than what a number holds, over the edges of segments."""
    import random

    from dugout.operators import sequences

    rng = random.Random(3)
    names = {"ball": "ball", "called_strike": "strike", "foul": "foul", "hit_into_play": None, "swinging_strike": "strike"}
    made = [
        dict(at_bat_number=a, pitch_number=n, description=rng.choice(("ball", "ball", "ball", "called_strike", "swinging_strike")) if a == 1 else rng.choice(list(names)))
        for a in (1, 2) for n in range(1, 300) if n % 97
    ]
    df = pitches(*made)
    at_bats = rollup.at_bat_rollup(df)
    monkeypatch.setattr(sequences, "SEGMENT", segment)
    outcome = {(r["at_bat_number"], r["pitch_number"]): names[r["description"]] for r in made}
    starts = [(1, 5, 1), (1, 30, 31), (1, 40, 32), (1, 50, 33), (1, 100, 64), (1, 110, 70), (2, 60, 2), (1, 195, 95)]
    wanted = [[outcome[a, n + i] for i in range(length)] for a, n, length in starts]
    wanted = [w for w in wanted if None not in w] + [["foul"] * 40]
    found = {r.sequence: r.occurrences for r in sequences.outcome_sequences(df, at_bats, wanted).collect()}
    for w in wanted:
        n = sum(all(outcome.get((a, p + i)) == o for i, o in enumerate(w)) for a, p in outcome)
        assert found[" -> ".join(w)] == n


def test_outcome_sequences_equal_brute_force(pitches):
    made, df = _long_appearances(pitches)
    at_bats = rollup.at_bat_rollup(df)
    classes = {"ball": "ball", "called_strike": "strike", "swinging_strike": "strike", "foul": "foul"}
    by_number = {(r["at_bat_number"], r["pitch_number"]): r for r in made}
    final = {r.at_bat_number: r.final_event for r in at_bats.collect()}
    wanted = [["ball"], ["strike", "ball"], ["foul", "ball", "strike"], ["ball"] * 5]
    found = {r.sequence: r for r in sequences.outcome_sequences(df, at_bats, wanted).collect()}
    for outcomes in wanted:
        n = whiffs = strikeouts = 0
        for at_bat, number in by_number:
            run = [by_number.get((at_bat, number + i)) for i in range(len(outcomes))]
            if any(p is None or classes.get(p["description"]) != o for p, o in zip(run, outcomes)):
                continue
            following = by_number.get((at_bat, number + len(outcomes)))
            n += 1
            whiffs += following is not None and following["description"] == "swinging_strike"
            strikeouts += final[at_bat] == "strikeout"
        row = found[" -> ".join(outcomes)]
        assert row.occurrences == n
        if n:
            assert row.whiff_pct == pytest.approx(whiffs / n, abs=5.1e-4)
            assert row.k_pct == pytest.approx(strikeouts / n, abs=5.1e-4)


def test_counts_passed_equal_brute_force(pitches):
    made, df = _long_appearances(pitches)
    at_bats = rollup.at_bat_rollup(df)
    final = {r.at_bat_number: r.final_event for r in at_bats.collect()}
    passed = {(r["at_bat_number"], r["balls"], r["strikes"]) for r in made}
    expected = {}
    for at_bat, balls, strikes in passed:
        n, k = expected.get((balls, strikes), (0, 0))
        expected[balls, strikes] = (n + 1, k + (final[at_bat] == "strikeout"))
    found = {(r.balls, r.strikes): (r.at_bats, r.strikeouts) for r in appearances.by_count_passed(df, at_bats).collect()}
    assert found == expected


def test_two_way_player_is_a_pitcher(pitches):
    df = pitches(
        dict(pitch_number=1, pitcher_id=7, batter_id=8, p_throws="R", pitcher_team="AAA"),
        dict(at_bat_number=2, pitcher_id=9, batter_id=7, stand="L", batter_team="BBB"),
    )
    found = {r.player_id: r for r in players.player_traits(df).collect()}
    assert (found[7].position, found[7].throws, found[7].bats, found[7].team) == ("P", "R", "L", "AAA")
    assert (found[8].position, found[8].throws) == ("B", None)


def test_latest_team_prefers_newest_and_falls_to_home_when_half_unknown(spark, pitches):
    df = pitches(
        dict(game_pk=1, batter_id=7, batter_team="OLD"),
        dict(game_pk=2, batter_id=7, batter_team="", inning_half=None, season=2020),
    )
    games = spark.createDataFrame([(1, "H1", "A1"), (2, "H2", "A2")], "game_pk bigint, home_team string, away_team string")
    assert rows(players.player_latest_team(df, games, "batter"), "player_id", "latest_team") == [(7, "H2")]


def test_transition_pairs_break_on_unknown_types_but_sequences_step_over(pitches):
    df = pitches(
        dict(pitch_number=1, pitch_type="FF"), dict(pitch_number=2, pitch_type=None), dict(pitch_number=3, pitch_type="SL")
    )
    assert summaries.pitch_transitions(df).count() == 0
    assert rows(sequences.pitch_sequences(df, 2, min_occurrences=1), "sequence", "occurrences") == [("FF → SL", 1)]
