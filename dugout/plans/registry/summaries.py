"""The three materialised summaries."""

from __future__ import annotations

from dugout.operators import summaries
from dugout.plans.registry.base import query


@query("league_pitch_state", "SELECT * FROM league_pitch_state_summary", "league_pitch_state_summary")
def league_pitch_state(lake):
    return summaries.league_pitch_state(lake.pitches)


@query("player_pitch_state", "SELECT * FROM player_pitch_state_summary", "player_pitch_state_summary")
def player_pitch_state(lake):
    return summaries.player_pitch_state(lake.pitches)


@query("pitch_transitions", "SELECT * FROM pitch_transition_summary", "pitch_transition_summary")
def pitch_transitions(lake):
    return summaries.pitch_transitions(lake.pitches)
