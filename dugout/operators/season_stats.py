"""Normalisation of external season-stat frames into the four stat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.schemas import BATTING_STANDARD, BATTING_VALUE, PITCHING_STANDARD, PITCHING_VALUE, conform

# Table column -> feed column.
BATTING_STANDARD_COLUMNS = {
    "g": "G", "ab": "AB", "pa": "PA", "h": "H", "singles": "1B", "doubles": "2B", "triples": "3B", "hr": "HR",
    "r": "R", "rbi": "RBI", "bb": "BB", "ibb": "IBB", "so": "SO", "hbp": "HBP", "sf": "SF", "sh": "SH",
    "gdp": "GDP", "sb": "SB", "cs": "CS", "avg": "AVG", "obp": "OBP", "slg": "SLG", "ops": "OPS", "iso": "ISO",
    "babip": "BABIP", "bb_pct": "BB%", "k_pct": "K%",
}
BATTING_VALUE_COLUMNS = {
    "woba": "wOBA", "wraa": "wRAA", "wrc": "wRC", "wrc_plus": "wRC+", "bsr": "BsR", "off_value": "Off",
    "def_value": "Def", "war": "WAR", "wpa": "WPA", "re24": "RE24", "rar": "RAR", "dollars": "Dol",
}
PITCHING_STANDARD_COLUMNS = {
    "w": "W", "l": "L", "era": "ERA", "g": "G", "gs": "GS", "cg": "CG", "sho": "ShO", "sv": "SV", "bs": "BS",
    "ip": "IP", "tbf": "TBF", "h": "H", "r": "R", "er": "ER", "hr": "HR", "bb": "BB", "ibb": "IBB", "hbp": "HBP",
    "wp": "WP", "bk": "BK", "so": "SO", "k_per_9": "K/9", "bb_per_9": "BB/9", "k_per_bb": "K/BB", "avg": "AVG",
    "whip": "WHIP", "babip": "BABIP", "lob_pct": "LOB%", "fip": "FIP",
}
PITCHING_VALUE_COLUMNS = {
    "war": "WAR", "rar": "RAR", "dollars": "Dol", "xfip": "xFIP", "siera": "SIERA", "wpa": "WPA", "re24": "RE24",
    "era_minus": "ERA-", "fip_minus": "FIP-", "k_pct": "K%", "bb_pct": "BB%", "lob_pct": "LOB%",
}
IDENTITY = ("IDfg", "Name", "Team", "Season", "Age")
KINDS = {
    "batting_standard_stats": (BATTING_STANDARD_COLUMNS, BATTING_STANDARD),
    "batting_value_stats": (BATTING_VALUE_COLUMNS, BATTING_VALUE),
    "pitching_standard_stats": (PITCHING_STANDARD_COLUMNS, PITCHING_STANDARD),
    "pitching_value_stats": (PITCHING_VALUE_COLUMNS, PITCHING_VALUE),
}


def stat_row_key(season: int, player_id, name, team):
    """``season:id:team``; the name stands in for an absent id, ``NA`` for an absent team."""
    token = F.coalesce(
        player_id.cast("int").cast("string"), F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit("_"))
    )
    team_token = F.coalesce(F.nullif(F.trim(team), F.lit("")), F.lit("NA"))
    return F.concat_ws(":", F.lit(str(season)), token, team_token)


def normalise_season_stats(raw: DataFrame, season: int, table: str) -> DataFrame:
    """Project, rename and key one raw stat frame for ``table``."""
    mapping, schema = KINDS[table]
    present = [c for c in IDENTITY + tuple(mapping.values()) if c in raw.columns]
    known = set(present)

    def feed(name: str, kind: str = "string"):
        return F.col(f"`{name}`") if name in known else F.lit(None).cast(kind)

    season_value = F.coalesce(F.nullif(feed("Season", "int").cast("int"), F.lit(0)), F.lit(season))
    normalised = raw.select(
        stat_row_key(season, feed("IDfg", "int"), feed("Name"), feed("Team")).alias("row_key"),
        season_value.alias("season"),
        feed("IDfg", "int").alias("player_id_fangraphs"),
        feed("Name").alias("player_name"),
        feed("Team").alias("team"),
        feed("Age", "int").alias("age"),
        *[feed(source).alias(target) for target, source in mapping.items() if source in known],
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in present]), {"ignoreNullFields": "false"}).alias("stats_json"),
    )
    return conform(normalised, T.StructType(schema.fields))
