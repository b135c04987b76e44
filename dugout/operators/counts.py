"""Reports by ball-strike count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.functions import numbers, vocab
from dugout.functions.numbers import mean, rate, ratio, rnd
from dugout.operators import appearances as ap
from dugout.operators.filters import ALL_TIME, Window, filter_pitches
from dugout.operators.players import name_players


def count_label() -> Column:
    return F.concat_ws("-", "balls", "strikes")


def _mean_of_thousandths(value: Column) -> Column:
    """Mean of whole thousandths as a rate, rounded half away from zero in whole numbers."""
    total, n = F.sum(value), F.count(value)
    return F.when(n > 0, F.floor((2 * total + n) / (2 * n)) / 1000)


def count_state_splits(
    pitches: DataFrame,
    at_bats: DataFrame,
    players: DataFrame,
    balls: int,
    strikes: int,
    *,
    outs: int | None = None,
    base_state: str | None = None,
    scope: Window = ALL_TIME,
    min_pa: int = 50,
    stand: str | None = None,
    p_throws: str | None = None,
    game_types=None,
) -> DataFrame:
    """Batter results over appearances that reached a count.

    Pitch rates are those of the whole appearance, rounded before averaging; as
    whole thousandths their sum does not depend on the order of rows.
    """
    reached = filter_pitches(
        scope, balls=balls, strikes=strikes, outs=outs, base_state=base_state, stand=stand, p_throws=p_throws,
        game_types=game_types,
    )
    key = list(ap.APPEARANCE)
    batters = pitches.filter(reached).select(*key, "batter_id").distinct()
    d = F.col("description")
    kinds = {
        "swing_pct": vocab.is_swing(d), "whiff_pct": vocab.is_whiff(d), "called_strike_pct": vocab.is_called_strike(d),
        "contact_pct": F.col("bb_type").isNotNull(),
    }
    rates = pitches.groupBy(*key).agg(*[F.round(rate(kind) * 1000).cast("bigint").alias(name) for name, kind in kinds.items()])
    results = at_bats.select(*key, "xwoba", "woba_value", "final_event")
    measures = ap.result_rates()
    per_batter = (
        batters.join(results, key)
        .join(rates, key, "left")
        .groupBy("batter_id")
        .agg(
            numbers.rows().alias("pa"),
            measures["xwoba"].alias("xwoba"),
            mean(F.col("woba_value")).alias("woba"),
            *ap.named(measures, "k_pct", "bb_pct", avg="hit_pct"),
            *[_mean_of_thousandths(F.col(name)).alias(name) for name in kinds],
        )
        .filter(F.col("pa") >= min_pa)
    )
    return (
        name_players(per_batter, players, "batter")
        .select(
            "batter_id", "batter_name", "pa", "xwoba", "woba", "avg", "k_pct", "bb_pct", "swing_pct", "whiff_pct",
            "called_strike_pct", "contact_pct",
        )
        .orderBy(F.desc("xwoba"), "batter_id")
    )


def outcome_by_final_count(at_bats: DataFrame, scope: Window = ALL_TIME, game_types=None) -> DataFrame:
    """Outcome rates by the count an appearance ended on."""
    measures = ap.result_rates()
    return (
        at_bats.filter(filter_pitches(scope, game_types=game_types))
        .groupBy(F.col("final_balls").alias("balls"), F.col("final_strikes").alias("strikes"))
        .agg(
            numbers.rows().alias("at_bats"),
            *ap.named(measures, "k_pct", "bb_pct", "hr_pct", "hit_pct", avg_xwoba="xwoba"),
        )
        .select("balls", "strikes", count_label().alias("count"), "at_bats", "k_pct", "bb_pct", "hr_pct", "hit_pct",
                "avg_xwoba")
        .orderBy("balls", "strikes")
    )


def _share(name: str) -> Column:
    return rnd(ratio(F.col(name), F.col("at_bats")))


def outcome_matrix(
    pitches: DataFrame,
    at_bats: DataFrame,
    scope: Window = ALL_TIME,
    *,
    stand: str | None = None,
    p_throws: str | None = None,
    game_types=None,
) -> DataFrame:
    """Outcome rates of appearances that passed through each count."""
    chosen = pitches.filter(filter_pitches(scope, stand=stand, p_throws=p_throws, game_types=game_types))
    return (
        ap.by_count_passed(chosen, at_bats)
        .select(
            "balls",
            "strikes",
            count_label().alias("count"),
            "at_bats",
            _share("strikeouts").alias("k_pct"),
            _share("walks").alias("bb_pct"),
            _share("home_runs").alias("hr_pct"),
            _share("hits").alias("hit_pct"),
            rnd(ratio(F.col("xwoba_sum"), F.col("xwoba_n"))).alias("avg_xwoba"),
        )
        .orderBy("balls", "strikes")
    )


def count_results(pitches: DataFrame, at_bats: DataFrame) -> DataFrame:
    """Appearances, xwOBA, average and strikeout rate per count passed through."""
    return (
        ap.by_count_passed(pitches, at_bats)
        .select(
            "balls",
            "strikes",
            F.col("at_bats").alias("pa"),
            rnd(ratio(F.col("xwoba_sum"), F.col("xwoba_n"))).alias("xwoba"),
            _share("hits").alias("avg"),
            _share("strikeouts").alias("k_pct"),
        )
        .orderBy("balls", "strikes")
    )


def zone_values(pitches: DataFrame, value: Column, name: str) -> DataFrame:
    """One value per strike zone 1 to 9, zero where a zone saw no pitch."""
    found = pitches.filter(F.col("zone").between(1, 9)).groupBy("zone").agg(value.alias(name))
    zones = pitches.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("zone"))
    kind = found.schema[name].dataType
    return zones.join(found, "zone", "left").select("zone", F.coalesce(name, F.lit(0).cast(kind)).alias(name))


def zone_map(
    pitches: DataFrame,
    scope: Window = ALL_TIME,
    *,
    balls: int | None = None,
    strikes: int | None = None,
    outs: int | None = None,
    stand: str | None = None,
    p_throws: str | None = None,
    game_types=None,
) -> DataFrame:
    """Pitches per strike zone in a count state."""
    chosen = filter_pitches(
        scope, balls=balls, strikes=strikes, outs=outs, stand=stand, p_throws=p_throws, game_types=game_types
    )
    return zone_values(pitches.filter(chosen), numbers.rows(), "pitches")


def zone_grid(zones: DataFrame, name: str = "pitches") -> DataFrame:
    """The nine zones as three rows of three."""
    row = F.floor((F.col("zone") - 1) / 3).cast("int").alias("grid_row")
    cells = [
        F.max(F.when((F.col("zone") - 1) % 3 == i, F.col(name))).alias(label)
        for i, label in enumerate(("left_zone", "middle_zone", "right_zone"))
    ]
    return zones.groupBy(row).agg(*cells).orderBy("grid_row")
