"""The report set behind one object, with request-style parameters.

Each method returns a lazy DataFrame, or a dict of them where a report has parts.
``window`` is ``season``, ``career`` or ``last7``; ``season_type`` is ``regular``,
``postseason`` or ``both``; a hand of None or ``all`` does not filter.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.operators import (
    batters, counts, leaderboards, pitch_state, pitchers, quality, sequences, teams,
)
from dugout.operators.filters import Window, data_context, filter_pitches, game_types, hand, resolve_window
from dugout.schemas import STAT_TABLES, SUMMARY_TABLES
from dugout.sources.store import TableStore


class Reports:
    def __init__(self, store: TableStore):
        self.store = store

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    @cached_property
    def pitches(self) -> DataFrame:
        return self.table("pitches")

    @cached_property
    def at_bats(self) -> DataFrame:
        return self.table("at_bats")

    @cached_property
    def games(self) -> DataFrame:
        return self.table("games")

    @cached_property
    def players(self) -> DataFrame:
        return self.table("players")

    @cached_property
    def context_row(self):
        return data_context(self.pitches).first()

    def window(self, window="season", season=None, season_start=None, season_end=None) -> Window:
        return resolve_window(self.context_row, window, season, season_start, season_end)

    # Context -----------------------------------------------------------------

    def context(self, current_year: int) -> dict[str, DataFrame]:
        """Data span, coverage, teams and the most active players."""
        return {
            "context": data_context(self.pitches),
            "teams": teams.teams(self.games),
            "batters": leaderboards.most_active(self._activity("batter")),
            "pitchers": leaderboards.most_active(self._activity("pitcher")),
            **self.coverage(current_year),
        }

    def coverage(self, current_year: int) -> dict[str, DataFrame]:
        history = quality.history_coverage(self.pitches, self.table("season_backfill_status"), current_year)
        return {
            "history": quality.history_complete(history),
            "players_status": quality.player_coverage(self.players),
        }

    def season_report(self, season: int | None = None) -> DataFrame:
        derived = {
            name.removesuffix("_summary").removesuffix("_stats"): self.table(name) for name in SUMMARY_TABLES + STAT_TABLES
        }
        report = quality.season_report(self.pitches, derived, quality.known_expectations(self.store.spark))
        return report if season is None else report.filter(F.col("season") == season)

    def freshness(self, today: date) -> DataFrame:
        return leaderboards.freshness(self.pitches, today.year, today)

    def _activity(self, role: str) -> DataFrame:
        return leaderboards.player_activity(self.pitches, self.at_bats, self.games, self.players, role)

    def player_search(self, role: str, term: str, limit: int = 25) -> DataFrame:
        return leaderboards.player_search(self._activity(role), term, limit)

    # Pitch state and prediction ----------------------------------------------

    @staticmethod
    def _state(season_type="both", stand=None, p_throws=None, **state) -> dict:
        return {"game_types": game_types(season_type), "stand": hand(stand), "p_throws": hand(p_throws), **state}

    def pitch_state_league(self, season: int, min_pitches: int = 1, **state) -> DataFrame:
        summary = self.table("league_pitch_state_summary")
        return pitch_state.pitch_state_league(summary, min_pitches, season=season, **self._state(**state))

    def pitch_state_player(
        self, player_id: int, perspective: str, season: int, min_pitches: int = 1, **state
    ) -> DataFrame:
        summary = self.table("player_pitch_state_summary")
        return pitch_state.pitch_state_player(
            summary, player_id, perspective, min_pitches, season=season, **self._state(**state)
        )

    def next_pitch(
        self, season: int, balls: int, strikes: int, prev_pitch_type: str, perspective: str = "pitcher",
        min_transitions: int = 1, **state,
    ) -> DataFrame:
        summary = self.table("pitch_transition_summary")
        return pitch_state.next_pitch(
            summary, balls, strikes, prev_pitch_type, perspective, min_transitions, season=season, **self._state(**state)
        )

    def outcome_by_pitch(self, season: int, balls: int, strikes: int, min_pitches: int = 1, **state) -> DataFrame:
        summary = self.table("league_pitch_state_summary")
        return pitch_state.outcome_by_pitch(
            summary, min_pitches, season=season, balls=balls, strikes=strikes, **self._state(**state)
        )

    # Counts ------------------------------------------------------------------

    def count_splits(
        self, balls: int, strikes: int, *, season_type="both", min_pa: int = 10, stand=None, p_throws=None, outs=None,
        base_state=None, **when,
    ) -> DataFrame:
        return counts.count_state_splits(
            self.pitches, self.at_bats, self.players, balls, strikes, outs=outs, base_state=base_state,
            scope=self.window(**when), min_pa=min_pa, stand=hand(stand), p_throws=hand(p_throws),
            game_types=game_types(season_type),
        )

    def outcome_matrix(self, *, season_type="both", stand=None, p_throws=None, **when) -> DataFrame:
        return counts.outcome_matrix(
            self.pitches, self.at_bats, self.window(**when), stand=hand(stand), p_throws=hand(p_throws),
            game_types=game_types(season_type),
        )

    def outcome_by_final_count(self, *, season_type="both", **when) -> DataFrame:
        return counts.outcome_by_final_count(self.at_bats, self.window(**when), game_types(season_type))

    def zone_map(
        self, *, season_type="both", balls=None, strikes=None, outs=None, stand=None, p_throws=None, **when
    ) -> DataFrame:
        zones = counts.zone_map(
            self.pitches, self.window(**when), balls=balls, strikes=strikes, outs=outs, stand=hand(stand),
            p_throws=hand(p_throws), game_types=game_types(season_type),
        )
        return counts.zone_grid(zones)

    # Profiles ----------------------------------------------------------------

    def batter(self, batter_id: int, *, season_type="both", team=None, **when) -> dict[str, DataFrame]:
        chosen = batters.batter_pitches(
            self.pitches, self.games, batter_id, self.window(**when), game_types=game_types(season_type), team=team
        )
        return {
            "summary": batters.batter_summary(chosen, self.at_bats),
            "seasons": batters.batter_seasons(chosen, self.at_bats),
            "counts": batters.batter_counts(chosen, self.at_bats),
            "zones": counts.zone_grid(batters.batter_zone_contact(chosen), "contact_rate"),
        }

    def pitcher(self, pitcher_id: int, *, season_type="both", team=None, **when) -> dict[str, DataFrame]:
        types = game_types(season_type)
        chosen = pitchers.pitcher_pitches(
            self.pitches, self.games, pitcher_id, self.window(**when), game_types=types, team=team
        )
        return {
            "summary": pitchers.pitcher_summary(chosen, self.at_bats),
            "seasons": pitchers.pitcher_seasons(self.pitches, self.games, pitcher_id, game_types=types, team=team),
            "counts": pitchers.pitcher_counts(chosen),
            "zones": counts.zone_grid(pitchers.pitcher_zones(chosen)),
        }

    def pitching(self, *, season_type="both", **when) -> dict[str, DataFrame]:
        chosen = self.pitches.filter(filter_pitches(self.window(**when), game_types=game_types(season_type)))
        return {
            "summary": pitchers.league_pitching_summary(chosen, self.at_bats),
            "seasons": pitchers.league_pitching_seasons(chosen),
            "counts": pitchers.pitcher_counts(chosen),
            "zones": counts.zone_grid(pitchers.pitcher_zones(chosen)),
        }

    def team(self, team_code: str, *, season_type="regular", **when) -> dict[str, DataFrame]:
        code, types, scope = team_code.upper(), game_types(season_type), self.window(**when)
        scoped = teams.scoped_pitches(self.pitches, self.games, scope, types)
        where = filter_pitches(scope, game_types=types)
        return {
            "summary": teams.team_summary(scoped, self.at_bats, code),
            "batting": teams.team_batting(scoped, self.at_bats, self.players, code, where),
            "pitching": teams.team_pitching(scoped, self.at_bats, self.players, code),
        }

    def count_profile(self, pitcher_id: int, *, season_type="both", **when) -> DataFrame:
        return pitchers.pitcher_count_profile(self.pitches, pitcher_id, self.window(**when), game_types(season_type))

    def splits(self, role: str, player_id: int, split_by: str = "base_state", *, season_type="both", **when) -> DataFrame:
        return batters.situational_splits(
            self.at_bats, player_id, role, split_by, self.window(**when), game_types(season_type)
        )

    # Sequences and appearances -----------------------------------------------

    def sequences(
        self, *, pitcher_id=None, min_occurrences: int = 5, length: int = 2, season_type="both", **when
    ) -> DataFrame:
        return sequences.pitch_sequences(
            self.pitches, length, pitcher_id=pitcher_id, min_occurrences=min_occurrences, scope=self.window(**when),
            game_types=game_types(season_type),
        )

    def outcome_sequence(self, outcomes: str, *, pitcher_id=None, season_type="both", **when) -> DataFrame:
        return sequences.outcome_sequences(
            self.pitches, self.at_bats, [sequences.parse_outcomes(outcomes)], pitcher_id=pitcher_id,
            scope=self.window(**when), game_types=game_types(season_type),
        )

    def sequence_compare(self, outcomes: str, pitcher_ids: list[int], *, season_type="both", **when) -> DataFrame:
        return sequences.sequence_compare(
            self.pitches, self.at_bats, sequences.parse_outcomes(outcomes), pitcher_ids, scope=self.window(**when),
            game_types=game_types(season_type),
        )

    def at_bat(self, game_pk: int, at_bat_number: int) -> DataFrame:
        return sequences.at_bat_timeline(self.pitches, game_pk, at_bat_number)

    # Leaderboards ------------------------------------------------------------

    def batting_leaders(
        self, *, window="season", season=None, season_start=None, season_end=None, season_type="both", limit: int = 10,
        min_pa: int = 10, balls=None, strikes=None, outs=None, stand=None, p_throws=None,
    ) -> DataFrame:
        """A plain single season ranks whole seasons; anything else ranks the situation."""
        scope = self.window(window, season, season_start, season_end)
        types = game_types(season_type)
        counted = balls is not None and strikes is not None
        plain = outs is None and stand is None and p_throws is None and season_type == "both"
        if not counted and window == "season" and scope.season is not None and plain:
            return leaderboards.batting_leaderboard(self.at_bats, self.players, scope.season, limit, min_pa, types)
        return leaderboards.batting_leaderboard_state(
            self.pitches, self.at_bats, self.players, scope, balls=balls, strikes=strikes, outs=outs, stand=hand(stand),
            p_throws=hand(p_throws), game_types=types, limit=limit, min_pa=min_pa,
        )

    def stuff_leaders(
        self, *, window="season", season=None, season_start=None, season_end=None, season_type="both", pitch_type=None,
        min_pitches: int = 20, limit: int = 10,
    ) -> DataFrame:
        scope = self.window(window, season, season_start, season_end)
        types = game_types(season_type)
        if window == "season" and scope.season is not None and season_type == "both":
            return leaderboards.stuff_proxy(
                self.pitches, self.players, scope.season, pitch_type, min_pitches, types
            ).limit(limit)
        return leaderboards.stuff_leaderboard_window(
            self.pitches, self.players, scope, pitch_type=pitch_type, min_pitches=min_pitches, game_types=types, limit=limit
        )
