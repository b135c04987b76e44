"""Registration of queries and small SQL writers for their checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from dugout.functions import vocab
from dugout.plans import oracle
from dugout.plans.lake import Lake


@dataclass(frozen=True)
class Entry:
    run: Callable[[Lake], DataFrame]
    sql: str | None
    check: str | None = None


ENTRIES: dict[str, Entry] = {}


def query(name: str, check: str | None = None, *needs: str):
    """Register a query; ``check`` is SQL over the CTEs in ``needs``."""

    def register(run: Callable[[Lake], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(run, oracle.sql(check, *needs) if check else None, check)
        return run

    return register


# SQL fragments used by the checks.
HITS = "('single','double','triple','home_run')"
WALKS = "('walk','intent_walk')"
STRIKEOUTS = "('strikeout','strikeout_double_play')"
NOT_AB = "('walk','intent_walk','hit_by_pitch','sac_fly','sac_bunt','catcher_interf')"
WHIFF = "('swinging_strike','swinging_strike_blocked')"
CSW = "('called_strike','swinging_strike','swinging_strike_blocked','foul','foul_tip')"
POST = "('F','D','L','W')"
ALL_TYPES = "('R','F','D','L','W')"


def n(condition: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def pct(condition: str) -> str:
    return f"ROUND(CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(COUNT(*), 0), 3)"


def avg(value: str, digits: int = 3) -> str:
    return f"ROUND(AVG({value}), {digits})"


def tb(event: str = "final_event") -> str:
    return (
        f"CAST(SUM(CASE {event} WHEN 'single' THEN 1 WHEN 'double' THEN 2 WHEN 'triple' THEN 3"
        " WHEN 'home_run' THEN 4 ELSE 0 END) AS BIGINT)"
    )


def div(top: str, bottom: str, digits: int = 3) -> str:
    return f"ROUND(CAST({top} AS DOUBLE) / NULLIF({bottom}, 0), {digits})"


def one_of(column: str, values) -> str:
    """Membership in one of the fixed sets of ``vocab``."""
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def many(test: str) -> str:
    return f"COUNT(*) FILTER ({test})"


def share(test: str) -> str:
    """Share of rows that pass a test, to three digits."""
    return f"ROUND({many(test)} / CAST(NULLIF(COUNT(*), 0) AS DOUBLE), 3)"


EVENT = "final_event"
HIT, WALK, OUT_BY_STRIKES = (one_of(EVENT, v) for v in (vocab.HIT_EVENTS, vocab.WALK_EVENTS, vocab.STRIKEOUT_EVENTS))
OFFICIAL = f"NOT {one_of(EVENT, vocab.AB_EXCLUDED_EVENTS)}"
HOMER = f"{EVENT} = 'home_run'"
MISSED, CALLED_OR_MISSED = one_of("description", vocab.WHIFF_NARROW), one_of("description", vocab.CSW_WIDE)
BASES = "CAST(COALESCE(SUM(list_position(['single', 'double', 'triple', 'home_run'], final_event)), 0) AS BIGINT)"


def columns(**measures: str) -> str:
    """``expression AS name`` for each measure."""
    return ", ".join(f"{text} AS {name}" for name, text in measures.items())


def appearances(where: str, *values: str, pitches: str = "pitches_with_teams") -> str:
    """Rows of at_bats whose pitches pass a filter, once per distinct combination of ``values`` of these pitches."""
    grouped = ", ".join(("game_pk", "at_bat_number", *values))
    return f"(SELECT {grouped} FROM {pitches} WHERE {where} GROUP BY ALL) JOIN at_bats AS ab USING (game_pk, at_bat_number)"
