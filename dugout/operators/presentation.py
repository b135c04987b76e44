"""Computations a front end does on report rows: totals, ranks, grids, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions.numbers import ratio, rnd
from dugout.functions.vocab import PITCH_TYPE_LABELS


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def season_totals(lines: DataFrame, sums: list[str], weighted: dict[str, str]) -> DataFrame:
    """Season lines plus a ``Total`` line for every season with several teams.

    ``weighted`` maps a mean column to the column that weighs it.
    """
    means = [
        F.coalesce(ratio(F.sum(_zero(c) * _zero(w)), F.sum(_zero(w))), F.lit(0.0)).alias(c) for c, w in weighted.items()
    ]
    totals = (
        lines.groupBy("season")
        .agg(*[F.sum(_zero(c)).alias(c) for c in sums], *means, F.count(F.lit(1)).alias("_teams"))
        .filter("_teams > 1")
        .select("season", F.lit("Total").alias("team"), *sums, *weighted, F.lit("total").alias("row_type"))
    )
    shown = lines.select("season", "team", *sums, *weighted, F.lit("team").alias("row_type"))
    return shown.unionByName(totals)


def slash_line(summary: DataFrame) -> DataFrame:
    """Average, on-base and slugging of summary rows, zero where nothing counted."""

    def over(top: Column, bottom: str) -> Column:
        return F.coalesce(ratio(top, F.col(bottom)), F.lit(0.0))

    return summary.withColumns(
        {
            "slash_avg": over(_zero("hits"), "at_bats"),
            "slash_obp": over(_zero("hits") + _zero("walks"), "pa"),
            "slash_slg": over(_zero("total_bases"), "at_bats"),
        }
    )


def matrix_totals(matrix: DataFrame) -> DataFrame:
    """The matrix folded over all counts, weighed by at-bats."""
    weight = F.greatest(F.sum(_zero("at_bats")), F.lit(1))
    return matrix.agg(
        F.lit("All").alias("count"),
        F.sum(_zero("at_bats")).alias("at_bats"),
        *[
            ratio(F.sum(_zero(c) * _zero("at_bats")), weight).alias(c)
            for c in ("k_pct", "bb_pct", "avg_xwoba")
        ],
    )


def dense_count_grid(matrix: DataFrame, value: str = "k_pct") -> DataFrame:
    """All twelve counts in display order, zero where the matrix has none."""
    cells = matrix.sparkSession.range(12).select(
        F.col("id").cast("int").alias("position"),
        (F.col("id") % 4).cast("int").alias("balls"),
        F.floor(F.col("id") / 4).cast("int").alias("strikes"),
    )
    return (
        cells.join(matrix.select("balls", "strikes", value), ["balls", "strikes"], "left")
        .select(
            "position", "balls", "strikes", F.concat_ws("-", "balls", "strikes").alias("count"),
            F.coalesce(value, F.lit(0.0)).alias(value),
        )
        .orderBy("position")
    )


def leaderboard_rank(rows: DataFrame, metric: str, bar: str, tie: list[str]) -> DataFrame:
    """Rows with their rank by a metric and their share of the best ``bar`` value.

    The input is a leaderboard: at most a row per player, so one window group.
    """
    order = Window.orderBy(_zero(metric).desc(), *tie)
    best = F.greatest(F.max(_zero(bar)).over(Window.partitionBy()), F.lit(1.0))
    return rows.withColumns({"rank": F.row_number().over(order), "bar_share": _zero(bar) / best})


def pitch_mix_label(counts: DataFrame, top: int = 3) -> DataFrame:
    """The most used pitch types of every count as ``FF 40% · SL 30%``."""
    w = Window.partitionBy("balls", "strikes").orderBy(F.desc("usage_pct"), "pitch_type")
    share = rnd(F.col("usage_pct") * 100, 0).cast("int").cast("string")
    label = F.concat(F.col("pitch_type"), F.lit(" "), share, F.lit("%"))
    ranked = counts.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top)
    ordered = F.sort_array(F.collect_list(F.struct("_rank", label.alias("label"))))
    return (
        ranked.groupBy("balls", "strikes")
        .agg(F.array_join(F.transform(ordered, lambda item: item["label"]), " · ").alias("pitch_mix"))
        .orderBy("balls", "strikes")
    )


def pitch_label(code: Column) -> Column:
    """``Slider (SL)``; the bare code when it has no name, ``Unknown`` without one."""
    pairs = [F.lit(x) for item in PITCH_TYPE_LABELS.items() for x in item]
    name = F.try_element_at(F.create_map(*pairs), code)
    return (
        F.when(code.isNull() | (code == ""), "Unknown")
        .when(name.isNotNull(), F.concat(name, F.lit(" ("), code, F.lit(")")))
        .otherwise(code)
    )


def zone_shading(zones: DataFrame, value: str = "pitches") -> DataFrame:
    """Share of the busiest zone, and the fill strength it is drawn with."""
    best = F.greatest(F.max(value).over(Window.partitionBy()), F.lit(1))
    share = ratio(F.col(value), best)
    return zones.select("zone", value, share.alias("share"), (F.lit(0.08) + share * 0.72).alias("fill"))
