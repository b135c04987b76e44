"""Pitch sequences and single appearances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions import numbers, vocab
from dugout.functions.numbers import rate, rnd
from dugout.operators.appearances import APPEARANCE
from dugout.operators.filters import ALL_TIME, filter_pitches
from dugout.operators.filters import Window as Scope
from dugout.operators.rollup import SEGMENT, next_pitches

OUTCOMES = ("ball", "strike", "foul")
#: Outcomes that one long holds, two bits each.
_PACKED = 32


def pitch_sequences(
    pitches: DataFrame,
    length: int = 2,
    *,
    pitcher_id: int | None = None,
    min_occurrences: int = 20,
    scope: Scope = ALL_TIME,
    game_types=None,
) -> DataFrame:
    """Runs of two or three pitch types and what the last pitch of the run led to.

    Pitches of unknown type are dropped first, so a run may step over them.
    """
    if length not in (2, 3):
        raise ValueError("length must be 2 or 3")
    typed = pitches.filter(
        F.col("pitch_type").isNotNull() & filter_pitches(scope, pitcher_id=pitcher_id, game_types=game_types)
    ).select("game_pk", "at_bat_number", "pitch_number", "pitch_type", "description", "events")
    names = ("first_pitch", "second_pitch", "third_pitch")[:length]
    last = length - 1
    fields = {name: ("pitch_type", i) for i, name in enumerate(names) if i}
    fields |= {"last_description": ("description", last), "last_events": ("events", last)}
    runs = next_pitches(typed, fields).withColumnRenamed("pitch_type", "first_pitch")
    return (
        runs.filter(F.col(names[-1]).isNotNull())
        .groupBy(*names)
        .agg(
            numbers.rows().alias("occurrences"),
            rate(vocab.is_whiff(F.col("last_description"))).alias("whiff_pct"),
            rate(vocab.is_strikeout(F.col("last_events"))).alias("k_pct"),
        )
        .filter(F.col("occurrences") >= min_occurrences)
        .select(F.concat_ws(" → ", *names).alias("sequence"), *names, "occurrences", "whiff_pct", "k_pct")
        .orderBy(F.desc("occurrences"), "sequence")
    )


def parse_outcomes(text: str) -> list[str]:
    """``"Ball, strike"`` to a list; anything but ball, strike and foul is refused."""
    parsed = [value.strip().lower() for value in text.split(",") if value.strip()]
    if any(value not in OUTCOMES for value in parsed):
        raise ValueError("outcomes must contain only: ball, strike, foul")
    return parsed


def _classified(pitches: DataFrame, where: Column) -> DataFrame:
    """Pitches with a two-bit outcome code, 0 where the outcome is none of the three, and whether they missed the bat."""
    outcome = vocab.outcome(F.col("description"))
    code = F.coalesce(*[F.when(outcome == name, i + 1) for i, name in enumerate(OUTCOMES)], F.lit(0))
    return (
        pitches.filter(where)
        .select(
            *APPEARANCE, "pitch_number", "pitcher_id", code.cast("bigint").alias("code"),
            F.coalesce(vocab.is_whiff(F.col("description")), F.lit(False)).alias("whiff"),
        )
        .filter("code > 0")
    )


def outcome_runs(pitches: DataFrame, length: int, where: Column | None = None) -> DataFrame:
    """Each classified pitch with ``run``: its outcome and those of up to ``length - 1`` pitches right after it."""
    named = F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("code").cast("int"))
    classified = _classified(pitches, F.lit(True) if where is None else where).withColumn("outcome", named)
    fields = {f"{name}_{i}": (name, i) for i in range(1, length) for name in ("pitch_number", "outcome")}
    stepped = next_pitches(classified, fields)
    # A missing number leaves later ones too high for their place.
    adjacent = [F.when(F.col(f"pitch_number_{i}") == F.col("pitch_number") + i, F.col(f"outcome_{i}")) for i in range(1, length)]
    return stepped.withColumn("run", F.filter(F.array("outcome", *adjacent), lambda o: o.isNotNull())).drop(*fields)


def packed_outcomes(outcomes: list[str]) -> list[int]:
    """A list of outcomes as the codes that ``outcome_tails`` has where it ends: the last outcomes first, ``_PACKED`` to a number."""
    codes = [OUTCOMES.index(outcome) + 1 for outcome in reversed(outcomes)]
    words = [codes[i : i + _PACKED] for i in range(0, len(codes), _PACKED)]
    unsigned = [sum(code << 2 * k for k, code in enumerate(word)) for word in words]
    return [word - (1 << 64) if word >> 63 else word for word in unsigned]


def outcome_tails(classified: DataFrame, depth: int, *extra_keys: str) -> DataFrame:
    """Each pitch with the last ``depth`` outcomes up to it, packed into longs, and whether the pitch after it missed the bat.

    ``tail_0`` holds the pitch and up to 31 before it, two bits each, ``tail_1``
    the 32 before those, and so on; a pitch number that is missing ends the
    tail with zeros.  Each step doubles the outcomes a long holds, so a list of
    two hundred takes a dozen lags.  Pitch numbers are cut into segments, none
    shorter than the depth, whose edges are lent to their neighbours, so an
    appearance of any length spreads over many window groups.
    """
    length = max(SEGMENT, depth)
    number = F.col("pitch_number")
    segment = F.floor(number / length)
    place = F.pmod(number, F.lit(length))
    neighbours = F.array(segment, F.when(place >= length - (depth - 1), segment + 1), F.when(place == 0, segment - 1))
    spread = classified.select("*", F.explode(F.filter(neighbours, lambda s: s.isNotNull())).alias("_segment"))
    w = Window.partitionBy(*APPEARANCE, *extra_keys, "_segment").orderBy("pitch_number")

    def back(name: str, steps: int) -> Column:
        """A value that many pitch numbers before, 0 where that number is missing."""
        return F.coalesce(F.when(F.lag("pitch_number", steps).over(w) == number - steps, F.lag(name, steps).over(w)), F.lit(0).cast("bigint"))

    tails, held = spread.withColumn("tail_0", F.col("code")), 1
    while held < min(depth, _PACKED):
        tails = tails.withColumn("tail_0", F.col("tail_0").bitwiseOR(F.shiftleft(back("tail_0", held), 2 * held)))
        held *= 2
    following = F.when(F.lead("pitch_number", 1).over(w) == number + 1, F.lead("whiff", 1).over(w))
    steps = {f"tail_{i}": back("tail_0", i * _PACKED) for i in range(1, -(-depth // _PACKED))}
    return tails.withColumns(steps | {"next_whiff": F.coalesce(following, F.lit(False))}).filter(segment == F.col("_segment")).drop("_segment")


def _matches(tails: DataFrame, sequences: list[list[str]]) -> DataFrame:
    """One row per place a requested sequence ends, with whether the pitch after it missed the bat."""
    hits = []
    for outcomes in sequences:
        found = F.lit(True)
        for i, word in enumerate(packed_outcomes(outcomes)):
            width = min(_PACKED, len(outcomes) - i * _PACKED)
            tail = F.col(f"tail_{i}")
            if width < _PACKED:
                tail = tail.bitwiseAND(F.lit((1 << 2 * width) - 1))
            found = found & (tail == F.lit(word).cast("bigint"))
        hits.append(F.when(found, F.lit(" -> ".join(outcomes))))
    kept = F.explode(F.filter(F.array(*hits), lambda hit: hit.isNotNull())).alias("sequence")
    return tails.select(*APPEARANCE, "pitcher_id", "next_whiff", kept)


def _match_rates(matches: DataFrame, at_bats: DataFrame, *by: str) -> DataFrame:
    ends = at_bats.select(*APPEARANCE, "final_event")
    return (
        matches.join(ends, list(APPEARANCE), "left")
        .groupBy(*by, "sequence")
        .agg(
            numbers.rows().alias("occurrences"),
            rate(F.col("next_whiff")).alias("whiff_pct"),
            rate(vocab.is_strikeout(F.col("final_event"))).alias("k_pct"),
        )
    )


def _requested(spark, sequences: list[list[str]]) -> DataFrame:
    rows = [(" -> ".join(outcomes), len(outcomes)) for outcomes in sequences]
    return spark.createDataFrame(rows, "sequence string, sequence_length int").distinct()


def outcome_sequences(
    pitches: DataFrame,
    at_bats: DataFrame,
    sequences: list[list[str]],
    *,
    pitcher_id: int | None = None,
    scope: Scope = ALL_TIME,
    game_types=None,
) -> DataFrame:
    """Occurrences, whiff rate of the pitch after and strikeout rate per outcome sequence.

    All sequences are matched in one pass; one that never occurs gets a zero row.
    """
    cleaned = [[o.strip().lower() for o in s if o and o.strip()] for s in sequences]
    wanted = [s for s in cleaned if s]
    spark = pitches.sparkSession
    if not wanted:
        return spark.createDataFrame(
            [("", 0, 0)], "sequence string, sequence_length int, occurrences bigint"
        ).select("*", F.lit(None).cast("double").alias("whiff_pct"), F.lit(None).cast("double").alias("k_pct"))
    classified = _classified(pitches, filter_pitches(scope, pitcher_id=pitcher_id, game_types=game_types))
    tails = outcome_tails(classified, max(map(len, wanted)))
    found = _match_rates(_matches(tails, wanted), at_bats)
    return (
        _requested(spark, wanted)
        .join(found, "sequence", "left")
        .select(
            "sequence", "sequence_length", F.coalesce("occurrences", F.lit(0).cast("bigint")).alias("occurrences"),
            "whiff_pct", "k_pct",
        )
    )


def sequence_compare(
    pitches: DataFrame,
    at_bats: DataFrame,
    outcomes: list[str],
    pitcher_ids: list[int],
    *,
    scope: Scope = ALL_TIME,
    game_types=None,
) -> DataFrame:
    """One outcome sequence for the league next to chosen pitchers.

    A pitcher's row considers only pitches that pitcher threw.
    """
    classified = _classified(pitches, filter_pitches(scope, game_types=game_types))
    depth = len(outcomes)
    league = _matches(outcome_tails(classified, depth), [outcomes]).withColumn("label", F.lit("League Average"))
    own = classified.filter(F.col("pitcher_id").isin(*pitcher_ids))
    pitchers = _matches(outcome_tails(own, depth, "pitcher_id"), [outcomes]).withColumn(
        "label", F.col("pitcher_id").cast("string")
    )
    return _match_rates(league.unionByName(pitchers), at_bats, "label").orderBy("label")


def sequence_extremes(sequences: DataFrame, size: int = 10) -> DataFrame:
    """The most frequent runs, and those with the lowest whiff rate."""
    top = sequences.orderBy(F.desc("occurrences"), "sequence").limit(size)
    bottom = sequences.orderBy(F.coalesce("whiff_pct", F.lit(0.0)), F.desc("occurrences"), "sequence").limit(size)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


def derived_count(outcomes: Column) -> Column:
    """Fold a list of outcomes into balls, strikes and how the appearance ended.

    A foul never adds a third strike, and nothing counts after a walk or strikeout.
    """
    start = F.struct(
        F.lit(0).alias("balls"),
        F.lit(0).alias("strikes"),
        F.lit(False).alias("terminal"),
        F.lit(None).cast("string").alias("terminal_label"),
    )

    def step(count: Column, pitch: Column) -> Column:
        balls = F.when(pitch == "ball", F.least(count["balls"] + 1, F.lit(4))).otherwise(count["balls"])
        strikes = (
            F.when(pitch == "strike", F.least(count["strikes"] + 1, F.lit(3)))
            .when((pitch == "foul") & (count["strikes"] < 2), count["strikes"] + 1)
            .otherwise(count["strikes"])
        )
        label = F.when((pitch == "ball") & (balls >= 4), "Walk").when((pitch == "strike") & (strikes >= 3), "Strikeout")
        moved = F.struct(
            balls.cast("int").alias("balls"),
            strikes.cast("int").alias("strikes"),
            label.isNotNull().alias("terminal"),
            label.alias("terminal_label"),
        )
        return F.when(count["terminal"], count).otherwise(moved)

    return F.aggregate(outcomes, start, step)


def next_outcome_allowed(outcomes: Column, result: Column) -> Column:
    """Whether one more pitch with this result may follow the list."""
    count = derived_count(outcomes)
    return (
        ~count["terminal"]
        & ~((result == "ball") & (count["balls"] >= 3))
        & ~((result == "strike") & (count["strikes"] >= 2))
    )


def at_bat_timeline(pitches: DataFrame, game_pk: int, at_bat_number: int) -> DataFrame:
    """Every pitch of one appearance in order."""
    return (
        pitches.filter((F.col("game_pk") == game_pk) & (F.col("at_bat_number") == at_bat_number))
        .select(
            "pitch_number",
            F.concat_ws("-", "balls", "strikes").alias("count_before"),
            "pitch_type",
            "pitch_name",
            rnd(F.col("release_speed"), 1).alias("velo"),
            rnd(F.col("plate_x"), 2).alias("plate_x"),
            rnd(F.col("plate_z"), 2).alias("plate_z"),
            rnd(F.col("pfx_x"), 1).alias("h_break"),
            rnd(F.col("pfx_z"), 1).alias("v_break"),
            "description",
            "events",
        )
        .orderBy("pitch_number")
    )
