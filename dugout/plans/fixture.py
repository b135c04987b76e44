"""A raw pitch feed re-projected from order and line-item tables.

Orders act as plate appearances and line items as pitches: an order is the
appearance, its line items its pitches.  An order with more than 16 line numbers
is cut into several appearances.  Games are runs of 64 order keys.  All
measurements are dyadic fractions, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dugout.sources.store import stored_bytes

APPEARANCES_PER_GAME = 64
LINES_PER_APPEARANCE = 16
#: Stored line items for each range of dates, in all seasons: some 5 million.
FILE_BYTES = 64 << 20
FIRST_BATTER, BATTERS = 600000, 60
FIRST_PITCHER, PITCHERS = 599965, 40

# By (order key * 7 + customer key * 3) modulo 20.
EVENTS = (
    "strikeout", "strikeout", "strikeout", "strikeout_double_play", "walk", "walk", "intent_walk", "single",
    "single", "double", "triple", "home_run", "hit_by_pitch", "sac_fly", "sac_bunt", "catcher_interf",
    "field_out", "field_out", "field_out", None,
)
IN_PLAY_EVENTS = ("single", "double", "triple", "home_run", "field_out", "sac_fly", "sac_bunt")
# By part key modulo 14, for pitches whose description no event decides.
DESCRIPTIONS = (
    "ball", "ball", "ball", "blocked_ball", "pitchout", "called_strike", "called_strike", "swinging_strike",
    "swinging_strike_blocked", "foul", "foul", "foul_bunt", "foul_tip", "missed_bunt",
)
COUNTED_BALLS = ("ball", "blocked_ball", "pitchout")
COUNTED_STRIKES = (
    "called_strike", "swinging_strike", "swinging_strike_blocked", "foul", "foul_bunt", "foul_tip", "missed_bunt",
)
PITCH_TYPES = ("FF", "SI", "SL", "CH", "CU", "FC", "ST")
PITCH_NAMES = ("4-Seam Fastball", "Sinker", "Slider", "Changeup", "Curveball", "Cutter", "Sweeper")
BATTED_BALLS = ("ground_ball", "fly_ball", "line_drive", "popup")
WOBA = {
    "single": 0.875, "double": 1.25, "triple": 1.5, "home_run": 2.0, "walk": 0.6875, "strikeout": 0.0, "field_out": 0.0,
}


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feed rows with their season, clustered by season and ranges of dates.

    Rows spread while they are narrow, before the windows, which then need no
    further shuffle and leave them in the order in which they are landed; the join
    before them stays free to split a hot order, and the parts of one spread too.
    """
    share = max(1, stored_bytes(spark, f"{sf_dir}/lineitem.parquet") // FILE_BYTES)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_linenumber",
        "l_extendedprice", F.col("l_quantity").cast("int").alias("qty"),
        F.expr(f"(l_linenumber - 1) div {LINES_PER_APPEARANCE}").alias("portion"),
    )
    game = F.expr(f"l_orderkey div {APPEARANCES_PER_GAME}")
    g = F.col("game_pk")
    day = F.expr("cast((game_pk div 7 * 13) % 180 as int)")
    first_day = F.make_date((g % 7 + 2015).cast("int"), F.lit(4), F.lit(1))
    place = ("season", "_spread", "game_pk", "l_orderkey", "portion")
    order = Window.partitionBy(*place).orderBy("l_linenumber", "part", "supp", "l_extendedprice", "qty")
    placed = (
        lines.join(orders, "l_orderkey")
        .withColumn("game_pk", game)
        .withColumn("game_day", F.date_add(first_day, day))
        .withColumns(
            {
                "season": F.year("game_day"),
                "_spread": F.pmod(F.floor(F.dayofyear("game_day") * share / 366) + F.col("portion"), F.lit(share)).cast("int"),
            }
        )
    )
    # Eight partitions for each range, so that few of the seven seasons meet in a task, however few the session has.
    fewest = [8 * share] if 8 * share > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    joined = placed.repartition(*fewest, "season", "_spread").withColumns(
        {
            "pitch_number": F.row_number().over(order),
            "is_last": F.lead("part").over(order).isNull(),
        }
    )
    key, cust, part, supp, qty = (F.col(c) for c in ("l_orderkey", "cust", "part", "supp", "qty"))
    event = F.when(F.col("is_last"), _pick(EVENTS, (key * 7 + cust * 3) % 20))
    events = F.col("events")
    description = (
        F.when(events.isin(*IN_PLAY_EVENTS), "hit_into_play")
        .when(events.isin("strikeout", "strikeout_double_play"), _pick(("swinging_strike", "called_strike"), part % 2))
        .when(events.isin("walk", "intent_walk"), "ball")
        .when(events == "hit_by_pitch", "hit_by_pitch")
        .otherwise(_pick(DESCRIPTIONS, part % 14))
    )
    described = joined.withColumn("events", event).withColumn("description", description)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def running(kinds: tuple, most: int) -> Column:
        counted = F.sum(F.when(F.col("description").isin(*kinds), 1).otherwise(0)).over(earlier)
        return F.least(F.lit(most), F.coalesce(counted, F.lit(0))).cast("int")

    counted = described.withColumns(
        {
            "balls": running(COUNTED_BALLS, 3),
            "strikes": running(COUNTED_STRIKES, 2),
            "at_bat_number": (key % APPEARANCES_PER_GAME + 1 + F.col("portion") * APPEARANCES_PER_GAME).cast("int"),
            "kind": (part * 3 + supp) % 7,
        }
    )
    ab, number = F.col("at_bat_number"), F.col("pitch_number")
    home = F.concat(F.lit("T"), (g % 12).cast("string"))
    away = F.concat(F.lit("T"), ((g + 5) % 12).cast("string"))

    def recorded(team: Column) -> Column:
        return F.when(key % 3 == 1, "").when(key % 3 == 2, team)

    pinch = F.when((key % 50 == 7) & (number >= 3), 1).otherwise(0)
    described_as = F.col("description")
    game_type = (
        F.when(g % 10 == 3, "F").when(g % 10 == 5, "D").when(g % 10 == 7, "L").when(g % 10 == 9, "W")
        .when(g % 31 == 0, "S").otherwise("R")
    )
    typed = part % 41 != 0
    woba = F.try_element_at(F.create_map(*[F.lit(x) for pair in WOBA.items() for x in pair]), events)
    return counted.select(
        "game_pk",
        "at_bat_number",
        "pitch_number",
        (key % PITCHERS + FIRST_PITCHER).cast("int").alias("pitcher"),
        ((cust + pinch) % BATTERS + FIRST_BATTER).cast("int").alias("batter"),
        recorded(home).alias("pitcher_team"),
        recorded(away).alias("batter_team"),
        home.alias("home_team"),
        away.alias("away_team"),
        F.when(cust % 3 == 0, "L").otherwise("R").alias("stand"),
        F.when(key % 4 == 0, "L").otherwise("R").alias("p_throws"),
        (ab % 9 + 1).cast("int").alias("inning"),
        F.when(key % 37 == 0, None).when(ab % 2 == 0, "Bot").otherwise("Top").alias("inning_topbot"),
        (key % 3).cast("int").alias("outs_when_up"),
        "balls",
        "strikes",
        F.when(cust % 4 == 0, (cust + 7) % BATTERS + FIRST_BATTER).cast("int").alias("on_1b"),
        F.when((cust % 5 == 0) & (number > 1), (cust + 11) % BATTERS + FIRST_BATTER).cast("int").alias("on_2b"),
        F.when(cust % 7 == 0, (cust + 13) % BATTERS + FIRST_BATTER).cast("int").alias("on_3b"),
        F.when(typed, _pick(PITCH_TYPES, F.col("kind"))).alias("pitch_type"),
        F.when(typed, _pick(PITCH_NAMES, F.col("kind"))).alias("pitch_name"),
        game_type.alias("game_type"),
        F.when(part % 23 != 0, F.lit(78.0) + (part % 160) / 8.0).alias("release_speed"),
        F.when(part % 29 != 0, ((supp * 37 + qty) % 900 + 1800).cast("double")).alias("release_spin_rate"),
        ((part % 33 - 16) / 16.0).alias("pfx_x"),
        ((supp % 33 - 10) / 16.0).alias("pfx_z"),
        ((part % 65 - 32) / 16.0).alias("plate_x"),
        ((supp % 64) / 16.0).alias("plate_z"),
        "description",
        ((part + qty) % 14 + 1).cast("int").alias("zone"),
        F.when(described_as == "hit_into_play", "X")
        .when(described_as.isin("ball", "blocked_ball", "pitchout", "hit_by_pitch"), "B")
        .otherwise("S")
        .alias("type"),
        F.when(described_as == "hit_into_play", _pick(BATTED_BALLS, part % 4)).alias("bb_type"),
        "events",
        F.when(events.isNotNull(), (part % 128) / 64.0).alias("estimated_woba_using_speedangle"),
        woba.alias("woba_value"),
        F.date_format("game_day", "yyyy-MM-dd").alias("game_date"),
        "season",
    )


def named_players(stubs: DataFrame) -> DataFrame:
    """Player rows for ids: a fifth unnamed, team NULL, empty or set in turn."""
    pid = F.col("player_id")
    team = F.concat(F.lit("T"), (pid % 12).cast("string"))
    return stubs.select(
        "player_id",
        F.when(pid % 5 != 0, F.concat(F.lit("Player "), pid.cast("string"))).alias("full_name"),
        F.when(pid % 3 == 0, "L").otherwise("R").alias("bats"),
        F.when(pid % 4 == 0, "L").otherwise("R").alias("throws"),
        F.when(pid < FIRST_BATTER + 5, "P").otherwise("B").alias("position"),
        F.when(pid % 4 == 1, "").when(pid % 4 > 1, team).alias("team"),
    )


def lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name table: untidy first and last names for four fifths of the ids."""
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100 + FIRST_PITCHER).cast("int").alias("id"))
    pid = F.col("id")
    return ids.filter(pid % 5 != 3).distinct().select(
        pid.alias("key_mlbam"),
        F.concat(F.lit("  o'MAR "), F.when(pid % 2 == 0, "de").otherwise("VAN")).alias("name_first"),
        F.concat(F.lit("smith-JONES"), pid.cast("string"), F.lit("x ")).alias("name_last"),
    )


def lookup_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile table: every id, used where the name table has none."""
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100 + FIRST_PITCHER).cast("int").alias("id"))
    pid = F.col("id")
    return ids.filter(pid % 10 != 8).distinct().select(
        pid.alias("player_id"),
        F.concat(F.lit("Profile "), pid.cast("string")).alias("full_name"),
        F.when(pid % 2 == 0, "S").otherwise("R").alias("bats"),
        F.lit("L").alias("throws"),
        F.lit("C").alias("position"),
    )
