"""Plate-appearance rollup, and steps between the pitches of an appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions import keys
from dugout.operators.clean import AT_BAT_KEY
from dugout.schemas import AT_BATS, conform

#: Pitch numbers of an appearance are cut into segments of this many for windows.
SEGMENT = 1024


def at_bat_rollup(pitches: DataFrame) -> DataFrame:
    """One row per plate appearance.

    First and last values skip NULLs column by column.  All of it is one grouped
    aggregation with map-side partials, so an appearance of any length is folded
    before the shuffle.
    """
    present = set(pitches.columns)
    order = F.col("pitch_number")

    def source(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast("string")

    def first(name: str) -> Column:
        value = source(name)
        return F.min_by(value, F.when(value.isNotNull(), order))

    def last(name: str) -> Column:
        value = source(name)
        return F.max_by(value, F.when(value.isNotNull(), order))

    half_name = "inning_half" if "inning_half" in present else "inning_topbot"
    at_start = ("pitcher_id", "batter_id", "stand", "p_throws", "inning", "on_1b", "on_2b", "on_3b", "base_state",
                "game_type", "game_date", "season")
    rolled = pitches.groupBy(*AT_BAT_KEY).agg(
        *[first(c).alias(c) for c in at_start],
        first(half_name).alias("half"),
        first("outs_when_up").alias("outs_at_start"),
        F.count(F.lit(1)).alias("pitch_count"),
        last("balls").alias("final_balls"),
        last("strikes").alias("final_strikes"),
        (F.max("strikes") >= 2).alias("reached_2strike"),
        (F.max("balls") >= 3).alias("reached_3ball"),
        F.bool_or((F.col("balls") >= 3) & (F.col("strikes") >= 2)).alias("reached_full"),
        last("events").alias("final_event"),
        last("pitch_type").alias("final_pitch_type"),
        last("estimated_woba_using_speedangle").alias("xwoba"),
        last("woba_value").alias("woba_value"),
    )
    finished = rolled.withColumns(
        {
            "at_bat_id": keys.joined_key(*[F.col(c) for c in AT_BAT_KEY]),
            "inning_half": keys.half(F.col("half")),
            "final_count": F.concat_ws("-", F.col("final_balls"), F.col("final_strikes")),
        }
    )
    return conform(finished, AT_BATS)


def _lent(pitches: DataFrame, columns: list[str], depth: int) -> DataFrame:
    """The first ``depth`` pitches of every segment but the first, for the segments of the appearance that stand before it.

    Only rows of later segments are read, and none where appearances are as
    short as real ones.  A segment may hold fewer than ``depth`` pitches, or none,
    so its pitches go to that many of the filled segments before it.
    """
    appearance = list(AT_BAT_KEY)
    late = pitches.filter(F.col("pitch_number") >= SEGMENT).select(*columns).withColumn("_segment", _segment())
    inside = Window.partitionBy(*appearance, "_segment").orderBy("pitch_number")
    heads = late.withColumn("_place", F.row_number().over(inside)).filter(F.col("_place") <= depth)
    filled = Window.partitionBy(*appearance).orderBy("_segment")
    before = F.array(*[F.coalesce(F.lag("_segment", i).over(filled), F.lit(0)) for i in range(1, depth + 1)])
    lenders = heads.filter("_place = 1").select(*appearance, "_segment", F.array_distinct(before).alias("_before"))
    return heads.join(lenders, [*appearance, "_segment"]).select(*columns, F.explode("_before").alias("_segment"))


def _segment() -> Column:
    number = F.coalesce(F.col("pitch_number"), F.lit(0))
    return F.greatest(F.floor(number / SEGMENT), F.lit(0)).cast("long")


def next_pitches(pitches: DataFrame, fields: dict[str, tuple[str, int]]) -> DataFrame:
    """Add columns holding values of later pitches of the same appearance.

    ``fields`` maps a new column to (source column, steps ahead).  Windows run
    within segments of an appearance, each of which borrows the next pitches after it, so an
    appearance of any length spreads over many window groups.
    """
    depth = max(steps for _, steps in fields.values())
    columns = list(dict.fromkeys([*AT_BAT_KEY, "pitch_number", *(source for source, _ in fields.values())]))
    own = pitches.withColumns({"_segment": _segment(), "_own": F.lit(True)})
    lent = _lent(pitches, columns, depth).withColumn("_own", F.lit(False))
    window = Window.partitionBy(*AT_BAT_KEY, "_segment").orderBy("pitch_number")
    stepped = own.unionByName(lent, allowMissingColumns=True).withColumns(
        {name: F.lead(source, steps).over(window) for name, (source, steps) in fields.items()}
    )
    return stepped.filter("_own").drop("_segment", "_own")
