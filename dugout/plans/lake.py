"""The pitch model derived once per session from a folder of source tables."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from dugout.operators import clean, rollup, summaries
from dugout.operators.filters import Window, data_context, resolve_window
from dugout.plans import fixture, ingest
from dugout.sources.store import TableStore, shared_folder, small_scans

_OPEN: dict[tuple[str, str], Lake] = {}


class Lake:
    """Tables of the model, written on first use and read back from Parquet.

    Written tables give every report column pruning, filter push-down and season
    partition pruning, and survive the loss of executors.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        app = spark.sparkContext.applicationId
        self.spark, self.sf_dir = spark, sf_dir
        self.store = TableStore(spark, f"{shared_folder(spark)}/lake/{app}/{tag}")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Lake:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _OPEN:
            _OPEN[key] = cls(spark, sf_dir)
        return _OPEN[key]

    def _kept(self, name: str, df: DataFrame, placed: bool = False) -> DataFrame:
        """A table written and read back; summaries are ``placed``, where they were combined, since no row order helps them."""
        self.store.replace(name, df, placed=placed)
        return self.store.read(name)

    @cached_property
    def raw(self) -> DataFrame:
        """The landed raw feed, with its season as folder."""
        landed = fixture.raw_pitches(self.spark, self.sf_dir)
        path = self.store.path("landing")
        self.store.write_folder(landed, path, placed=True)
        return self.spark.read.parquet(path)

    @cached_property
    def pitches(self) -> DataFrame:
        """Pitches stay where they were landed, unless many of them are repeated."""
        cleaned = clean.cleaned_pitches(self.raw)
        pitches, placed = ingest.one_per_key(cleaned)
        return self._kept("pitches", pitches, placed)

    @cached_property
    def games(self) -> DataFrame:
        cleaned = clean.supported_games(clean.clean_pitches(self.raw))
        return self._kept("games", clean.games_dim(cleaned))

    @cached_property
    def players(self) -> DataFrame:
        return self._kept("players", fixture.named_players(clean.player_stubs(self.pitches)))

    @cached_property
    def at_bats(self) -> DataFrame:
        pitches = self.pitches
        with small_scans(self.spark):
            return self._kept("at_bats", rollup.at_bat_rollup(pitches))

    @cached_property
    def league_state(self) -> DataFrame:
        return self._kept("league_pitch_state_summary", summaries.league_pitch_state(self.pitches), placed=True)

    @cached_property
    def player_state(self) -> DataFrame:
        return self._kept("player_pitch_state_summary", summaries.player_pitch_state(self.pitches), placed=True)

    @cached_property
    def transitions(self) -> DataFrame:
        return self._kept("pitch_transition_summary", summaries.pitch_transitions(self.pitches), placed=True)

    @cached_property
    def context(self):
        """First and last date and season: one row on the driver."""
        return data_context(self.pitches).first()

    def window(self, *args, **kwargs) -> Window:
        return resolve_window(self.context, *args, **kwargs)
