"""Row keys, display names, name casing and team derivation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_key(*parts: Column) -> Column:
    """``a_b_c`` identifier of a pitch or plate appearance."""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def row_key(*parts: Column | str) -> Column:
    """``a:b:c`` key of a summary row, with ``NA`` for an absent part."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in columns])


def base_state(on_1b: Column, on_2b: Column, on_3b: Column) -> Column:
    """Occupied-base flags, first base leftmost: ``101`` is first and third."""
    flags = [F.when(base.isNotNull(), "1").otherwise("0") for base in (on_1b, on_2b, on_3b)]
    return F.concat(*flags)


def display_name(full_name: Column, role: str, player_id: Column) -> Column:
    """Known name, or ``Batter #id`` / ``Pitcher #id``."""
    return F.coalesce(full_name, F.concat(F.lit(f"{role} #"), player_id.cast("string")))


def title_case(name: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    pieces = F.split(F.lower(F.trim(name)), r"(?<=[^\p{L}])")
    capitalised = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.array_join(capitalised, "")


def half(inning_half: Column) -> Column:
    """Lower-case three-letter half; empty when unknown."""
    return F.substring(F.lower(F.coalesce(inning_half, F.lit(""))), 1, 3)


def derived_team(explicit: Column, inning_half: Column, when_top: Column, otherwise: Column) -> Column:
    """Recorded team, or the side the half-inning implies.

    An unknown half falls to ``otherwise``, as any half that is not the top does.
    """
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(inning_half == "Top", when_top).otherwise(otherwise))


def batter_team(explicit: Column, inning_half: Column, home: Column, away: Column) -> Column:
    return derived_team(explicit, inning_half, away, home)


def pitcher_team(explicit: Column, inning_half: Column, home: Column, away: Column) -> Column:
    return derived_team(explicit, inning_half, home, away)
