"""Plate appearances selected through their pitches, and aggregates over them.

Pitches and at-bats meet on ``season, game_pk, at_bat_number``.  A game lies in
one season, so the season adds nothing to the key but lets a season filter on one
side prune the partitions of the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.functions import numbers, vocab

APPEARANCE = ("season", "game_pk", "at_bat_number")


def beside(*one_row: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side as one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def joined_team_list(team: Column) -> Column:
    """Distinct team codes as ``A/B``; NULL when there is none."""
    return F.nullif(F.array_join(F.sort_array(F.collect_set(team)), "/"), F.lit(""))


def of_pitches(at_bats: DataFrame, pitches: DataFrame, *extra: str) -> DataFrame:
    """At-bat rows of the appearances in ``pitches``, once per distinct ``extra`` value."""
    touched = pitches.select(*APPEARANCE, *extra).distinct()
    return at_bats.drop(*extra).join(touched, list(APPEARANCE))


def result_rates(event: str = "final_event", xwoba: str = "xwoba") -> dict[str, Column]:
    """Rates most reports share; NULL over no rows."""
    e = F.col(event)
    return {
        "xwoba": numbers.mean(F.col(xwoba)),
        "k_pct": numbers.rate(vocab.is_strikeout(e)),
        "bb_pct": numbers.rate(vocab.is_walk(e)),
        "hr_pct": numbers.rate(vocab.is_home_run(e)),
        "hit_pct": numbers.rate(vocab.is_hit(e)),
    }


def event_counts(event: str = "final_event") -> dict[str, Column]:
    e = F.col(event)
    return {
        "at_bats": F.count_if(vocab.is_at_bat(e)),
        "hits": F.count_if(vocab.is_hit(e)),
        "doubles": F.count_if(e == "double"),
        "triples": F.count_if(e == "triple"),
        "hr": F.count_if(vocab.is_home_run(e)),
        "walks": F.count_if(vocab.is_walk(e)),
        "strikeouts": F.count_if(vocab.is_strikeout(e)),
        "sac_fly": F.count_if(e == "sac_fly"),
        "total_bases": F.coalesce(F.sum(vocab.total_bases(e)), F.lit(0).cast("bigint")),
        "not_hit_by_pitch": F.count_if(e != "hit_by_pitch"),
    }


def named(columns: dict[str, Column], *wanted: str, **renamed: str) -> list[Column]:
    """Pick columns of a dict by name, optionally under another name (new=old)."""
    return [columns[w].alias(w) for w in wanted] + [columns[old].alias(new) for new, old in renamed.items()]


_SLOTS = 8
_MEASURES = ("at_bats", "strikeouts", "walks", "home_runs", "hits", "xwoba_sum", "xwoba_n")


def _count_measures() -> list[Column]:
    e = F.col("final_event")
    return [
        F.count(F.lit(1)).alias("at_bats"),
        F.count_if(vocab.is_strikeout(e)).alias("strikeouts"),
        F.count_if(vocab.is_walk(e)).alias("walks"),
        F.count_if(vocab.is_home_run(e)).alias("home_runs"),
        F.count_if(vocab.is_hit(e)).alias("hits"),
        F.sum("xwoba").alias("xwoba_sum"),
        F.count("xwoba").alias("xwoba_n"),
    ]


def by_count_passed(pitches: DataFrame, at_bats: DataFrame) -> DataFrame:
    """Result totals per count an appearance passed through.

    Counts of an appearance fold into the bits of one long, so pitches shuffle as
    one narrow row per appearance and the totals form per distinct bit pattern
    before any pattern is opened.  A count that has no bit, or a NULL one, is a
    group of its own in the same fold.
    """
    balls, strikes = F.col("balls"), F.col("strikes")
    outside = (
        balls.isNull() | strikes.isNull() | (balls < 0) | (strikes < 0) | (balls >= _SLOTS) | (strikes >= _SLOTS)
    )
    bit = F.when(~outside, F.expr(f"shiftleft(1L, balls * {_SLOTS} + strikes)"))
    odd = ("odd", "odd_balls", "odd_strikes")
    folded = pitches.groupBy(
        *APPEARANCE, outside.alias("odd"), F.when(outside, balls).alias("odd_balls"), F.when(outside, strikes).alias("odd_strikes")
    ).agg(F.bit_or(bit).alias("pattern"))
    results = at_bats.select(*APPEARANCE, "final_event", "xwoba")
    patterns = folded.join(results, list(APPEARANCE)).groupBy(*odd, "pattern").agg(*_count_measures())
    code = F.expr(f"filter(sequence(0, {_SLOTS * _SLOTS - 1}), c -> getbit(pattern, c) = 1)")
    inside = F.transform(code, lambda c: F.struct(F.floor(c / _SLOTS).cast("int").alias("balls"), (c % _SLOTS).cast("int").alias("strikes")))
    counts = F.when(F.col("odd"), F.array(F.struct(F.col("odd_balls").alias("balls"), F.col("odd_strikes").alias("strikes")))).otherwise(inside)
    opened = patterns.select(F.explode(counts).alias("at"), *_MEASURES).select("at.balls", "at.strikes", *_MEASURES)
    return opened.groupBy("balls", "strikes").agg(*[F.sum(m).alias(m) for m in _MEASURES])
