"""Season-partitioned Parquet tables under one root folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.operators.clean import PITCH_KEY, upsert
from dugout.operators.summaries import SUMMARIES, Summary
from dugout.schemas import STAMPED, SUMMARY_TABLES, TABLES, TALLIES, conform

_LOCAL_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the one the session names in ``spark.checkpoint.dir``.  Where that is
    unset, a local session gets a temporary folder and any other one a folder of
    its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/dugout"
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="dugout-")
    return _LOCAL_ROOTS[app]


_HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"
#: Last folder of every written piece of a table: pieces are never changed.
_PIECE = "_v"
_MANIFESTS = "_manifest"
_END = "complete"


def _located(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in order."""
    system, folder = _located(spark, pattern)
    return sorted(found.getPath().toString() for found in system.globStatus(folder) or [])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, is there."""
    return len(matching(spark, path)) > 0


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    system, folder = _located(spark, path)
    return system.getContentSummary(folder).getLength()


def remove(spark: SparkSession, path: str) -> None:
    system, folder = _located(spark, path)
    system.delete(folder, True)


def create(spark: SparkSession, path: str, text: str) -> None:
    """Write a new small file; fails if it is there already."""
    system, file = _located(spark, path)
    out = system.create(file, False)
    try:
        out.write(text.encode())
    finally:
        out.close()


#: Partitions that a task which does not sort writes at once; with more of them it sorts.
PLACED_WRITERS = 16
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Tasks that combine and write the tallies of one partition smaller than a season.
TALLY_FILES = 8
#: Values of the locating columns that an upsert broadcasts: some 50 MB.
FEW_PLACES = 500_000


#: Stored bytes that a task reads at once if it sorts them: a million pitches or less.
SORTED_BYTES = 16 << 20
_SCANNED = "spark.sql.files.maxPartitionBytes"


@contextmanager
def _set(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def placed_writers(spark: SparkSession) -> AbstractContextManager[None]:
    """Let a task write several partitions at once, without a sort, within the block."""
    return _set(spark, _WRITERS, PLACED_WRITERS)


def small_scans(spark: SparkSession) -> AbstractContextManager[None]:
    """Let tasks that sort the rows they scan, as those of the rollup do, read few of them, within the block."""
    return _set(spark, _SCANNED, SORTED_BYTES)


def _stored_schema(name: str) -> T.StructType:
    fields = TABLES[name].fields
    return T.StructType([*fields, T.StructField("updated_at", T.TimestampType())]) if name in STAMPED else TABLES[name]


def week() -> Column:
    """Week of the year, from 0: days 1 to 7 are the first."""
    return F.floor((F.dayofyear("game_date") - 1) / 7).cast("int")


@dataclass(frozen=True)
class Version:
    """One state of a table: the folders that hold it, relative to the table."""

    number: int
    folders: tuple[str, ...]

    def within(self, partitions: list[str] | None) -> list[str]:
        """The folders of some partitions, given as ``season=2019`` or ``season=2019/week=3``."""
        if partitions is None:
            return list(self.folders)
        wanted = {f"{p}/" for p in partitions}
        return [f for f in self.folders if any(f[: i + 1] in wanted for i, c in enumerate(f) if c == "/")]


@dataclass
class TableStore:
    """Reads and writes the model's tables below ``root``.

    Tables with a season are partitioned by ``partitions``; ``week`` among them is
    that of ``game_date``.  Where small batches arrive often, partition by
    ``("season", "week")``: an upsert then rewrites only the weeks it touches.

    A table is a set of folders that are never changed once written, and a
    numbered manifest that lists them.  A write adds folders, then publishes the
    next manifest by creating one small file; until that moment, and after a crash before it,
    readers see the state before.  A manifest that was not written to its end does not
    count.  Of two writers that start from one state the second fails.  Nothing is ever renamed by this class.
    """

    spark: SparkSession
    root: str
    partitions: tuple[str, ...] = ("season",)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def partition_columns(self, columns: list[str]) -> list[str]:
        """Partition columns a table with these columns has."""
        return [c for c in self.partitions if c in columns or c == "week" and "game_date" in columns]

    def _placed(self, df: DataFrame) -> DataFrame:
        """With the week where the store is partitioned by it."""
        return df.withColumn("week", week()) if "week" in self.partitions and "game_date" in df.columns and "week" not in df.columns else df

    # Versions ------------------------------------------------------------------

    def version(self, name: str) -> Version:
        """The newest state of a table; number 0 and no folders if it was never written."""
        for path in reversed(matching(self.spark, f"{self.path(name)}/{_MANIFESTS}/*.txt")):
            lines = self._lines(path)
            if lines[-1:] == [_END]:
                return Version(int(path.rsplit("/", 1)[1].removesuffix(".txt")), tuple(lines[:-1]))
        return Version(0, ())

    def _lines(self, path: str) -> list[str]:
        system, file = _located(self.spark, path)
        stream = system.open(file)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return text.split("\n")

    def publish(self, name: str, start: Version, folders: list[str]) -> Version:
        """Make these folders the table, in one step, if its state is still ``start``."""
        taken = matching(self.spark, f"{self.path(name)}/{_MANIFESTS}/*.txt")
        numbers = [int(path.rsplit("/", 1)[1].removesuffix(".txt")) for path in taken]
        if self.version(name).number != start.number:
            raise RuntimeError(f"{name} was changed by another writer")
        # A manifest that was broken off keeps its number.
        number = max([start.number, *numbers]) + 1
        create(self.spark, f"{self.path(name)}/{_MANIFESTS}/{number:012d}.txt", "\n".join([*folders, _END]))
        return Version(number, tuple(folders))

    def vacuum(self, name: str) -> list[str]:
        """Remove pieces that the newest state does not hold: those of older states, and of writers that did not finish.

        Readers of an older state fail from then on, so run it when there are none, and no writer.
        """
        live = set(self.version(name).folders)
        root = self.path(name)
        found = {folder for depth in range(len(self.partitions) + 1) for folder in matching(self.spark, f"{root}/{'*/' * depth}{_PIECE}=*")}
        dead = [f for f in sorted(found) if f[f.rindex(f"/{name}/") + len(name) + 2 :] not in live]
        for folder in dead:
            remove(self.spark, folder)
        return dead

    # Reading -------------------------------------------------------------------

    def _load(self, name: str, version: Version | None = None, partitions: list[str] | None = None) -> DataFrame | None:
        """A stored table in its model schema with its partition columns, or None.

        The schema is given, so no file is opened to infer it; columns a file lacks
        read as NULL and narrower numbers widen.
        """
        state = version or self.version(name)
        folders = state.within(partitions)
        if not folders:
            return None
        reader = self.spark.read.option("basePath", self.path(name))
        if name in TABLES:
            reader = reader.schema(_stored_schema(name))
        return reader.parquet(*(f"{self.path(name)}/{folder}" for folder in folders)).drop(_PIECE)

    def exists(self, name: str) -> bool:
        return len(self.version(name).folders) > 0

    def _rows(
        self, name: str, version: Version | None = None, partitions: list[str] | None = None, stamped: bool = False
    ) -> DataFrame:
        schema = _stored_schema(name) if stamped else TABLES.get(name)
        stored = self._load(name, version, partitions)
        if stored is None:
            return self.spark.createDataFrame([], schema)
        return stored.select(*schema.names) if schema else stored

    def read(
        self, name: str, version: Version | None = None, partitions: list[str] | None = None, stamped: bool = False
    ) -> DataFrame:
        """A table, or some partitions of it, at its newest or a given state; empty when there is none.

        The summary of a season that has tallies is folded from them; that of another
        season is the one that was imported.  ``stamped``: with ``updated_at``, where the table has it.
        """
        rows = self._rows(name, version, partitions, stamped)
        tallied = self.seasons(TALLIES[name]) if name in TALLIES else []
        if not tallied:
            return rows
        folded = SUMMARIES[name].fold(self._rows(TALLIES[name], stamped=stamped))
        return rows.filter(~F.col("season").isin(tallied)).unionByName(folded) if self.exists(name) else folded

    def retally(self, partitions: list[str], only: tuple[str, ...] = SUMMARY_TABLES) -> None:
        """Count the stored pitches of some partitions anew for the summaries.

        The pitches around are read too where games of these partitions reach into
        others, so that an appearance is counted once; nothing else is read or
        written.  A season without tallies is counted whole.
        """
        reached: dict[tuple[str, ...], list[str]] = {}
        for name in only:
            known = self.seasons(TALLIES[name])
            wanted = list(dict.fromkeys(p if any(p.startswith(f"season={s}/") for s in known) else p.split("/")[0] for p in partitions))
            around = reached.get(tuple(wanted), wanted)
            if tuple(wanted) not in reached and any("/" in p for p in wanted):
                games = self.read("pitches", partitions=wanted).select("game_pk").distinct()
                seasons = [int(p.split("/")[0].removeprefix("season=")) for p in wanted if not p.startswith(f"season={_HIVE_NULL}")]
                around = reached[tuple(wanted)] = list(dict.fromkeys(wanted + self.holding("pitches", games, sorted(set(seasons)))))
            place = self._tally_place(SUMMARIES[name])
            tallies = SUMMARIES[name].tallies(self.read("pitches", partitions=around), place)
            if set(around) != set(wanted):
                tallies = tallies.filter(self._within(wanted))
            # Tallies are written where they were combined: those of seasons anywhere, those of smaller partitions in few tasks each.
            self.replace(TALLIES[name], tallies, wanted, placed=self.partitions == ("season",) or bool(place))

    def _tally_place(self, summary: Summary) -> dict[str, Column] | None:
        """Columns by which tallies are dealt where partitions are smaller than seasons, so that one lies in few files."""
        by = self.partition_columns(["season", "game_date"])
        if by in ([], ["season"]):
            return None
        share = max(1, min(TALLY_FILES, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        place = {f"_{c}": week() if c == "week" else F.col(c) for c in by}
        return place | {"_spread": F.pmod(summary.group_hash(), F.lit(share))}

    def _within(self, partitions: list[str]) -> Column:
        """Rows of the given partitions."""
        by = self.partition_columns(["season", "game_date"])
        parts = [F.concat(F.lit(f"{c}="), F.coalesce((week() if c == "week" else F.col(c)).cast("string"), F.lit(_HIVE_NULL))) for c in by]
        names = [F.concat_ws("/", *parts[: i + 1]) for i in range(len(parts))]
        found = F.lit(False)
        for name in names:
            found = found | name.isin(partitions)
        return found

    # Writing -------------------------------------------------------------------

    def write_folder(self, df: DataFrame, path: str, mode: str = "overwrite", placed: bool = False) -> None:
        """Write a frame as a plain folder in the layout of tables: whole games in order, a partition over many tasks.

        ``placed``: the rows already lie so, and are written where they are, each task to
        the few partitions it meets at once, without a sort.
        """
        df = self._placed(df)
        by = self.partition_columns(df.columns)
        extra = [_PIECE] if _PIECE in df.columns else []
        writer_of = df
        if by and not placed:
            layout = by + [c for c in PITCH_KEY if c in df.columns]
            spread = list(by)
            if "game_pk" in df.columns:
                # Whole games meet in a file, and a season spreads over many tasks.
                share = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
                df = df.withColumn("_spread", F.pmod(F.hash("game_pk"), F.lit(share)))
                spread.append("_spread")
            # Rebalancing merges small parts and splits one that outgrows a task.
            writer_of = df.hint("rebalance", *spread).drop("_spread").sortWithinPartitions(*layout)
        writer = writer_of.write.mode(mode)
        writer = writer.partitionBy(*by, *extra) if by or extra else writer
        with placed_writers(self.spark) if placed else nullcontext():
            writer.parquet(path)

    def _add(self, name: str, df: DataFrame, placed: bool = False) -> list[str]:
        """Write a frame as new pieces; their folders, relative to the table."""
        if name in STAMPED:
            known = F.col("updated_at") if "updated_at" in df.columns else F.lit(None)
            df = df.withColumn("updated_at", F.coalesce(known.cast("timestamp"), F.current_timestamp()))
        piece = uuid.uuid4().hex
        by = self.partition_columns(self._placed(df).columns)
        self.write_folder(df.withColumn(_PIECE, F.lit(piece)), self.path(name), "append", **({"placed": True} if placed else {}))
        found = matching(self.spark, f"{self.path(name)}/{'*/' * len(by)}{_PIECE}={piece}")
        return ["/".join(f.split("/")[-1 - len(by) :]) for f in found]

    def replace(self, name: str, df: DataFrame, partitions: list[str] | None = None, placed: bool = False) -> None:
        """Write a table, or the partitions of it that ``df`` holds; those of ``partitions`` that it does not hold go."""
        start = self.version(name)
        added = self._add(name, df, placed)
        by = self.partition_columns(df.columns)
        gone = [*(f.rsplit("/", 1)[0] for f in added if "/" in f), *(partitions or [])]
        replaced = set(start.within(gone if by else None))
        self.publish(name, start, [f for f in start.folders if f not in replaced] + added)

    def append(self, name: str, df: DataFrame) -> None:
        start = self.version(name)
        self.publish(name, start, [*start.folders, *self._add(name, df)])

    def stage(self, df: DataFrame) -> DataFrame:
        """Write a frame aside and read it back, cutting its lineage."""
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        staged = self.spark.read.schema(df.schema).parquet(path)
        staged.staged_at = path
        return staged

    def unstage(self, *staged: DataFrame) -> None:
        """Remove staged frames that nothing reads any more."""
        for frame in staged:
            remove(self.spark, frame.staged_at)

    def swap(self, name: str, df: DataFrame) -> None:
        """Replace a whole table by rows that may come from it."""
        start = self.version(name)
        self.publish(name, start, self._add(name, df))

    def touched(self, df: DataFrame) -> list[str]:
        """Partitions present in a frame: one small row per partition."""
        df = self._placed(df)
        by = self.partition_columns(df.columns)
        return [self._partition(row.asDict()) for row in df.select(*by).distinct().collect()] if by else []

    def _partition(self, value: dict) -> str:
        return "/".join(f"{c}={_HIVE_NULL if value[c] is None else value[c]}" for c in self.partitions if c in value)

    def holding(self, name: str, keys: DataFrame, seasons: list[int] | None = None) -> list[str]:
        """Partitions of a stored table with rows of the given keys; only key and partition columns are read."""
        within = None if seasons is None else [self._partition({"season": s}) for s in seasons]
        stored = self._load(name, partitions=within)
        if stored is None:
            return []
        by = self.partition_columns(stored.columns)
        return self.touched(self._placed(stored).select(*dict.fromkeys([*by, *keys.columns])).join(keys, keys.columns, "left_semi")) if by else []

    def upsert(
        self, name: str, updates: DataFrame, keys: list[str], locate: list[str] | None = None, partitions: list[str] | None = None,
        stored: bool = False,
    ) -> None:
        """Insert or replace rows by key; no row of another key is lost or changed.

        Only partitions are rewritten that hold rows of ``updates`` or stored rows
        of their keys, and every rewritten partition is read whole.  Unless the
        keys tell the partition, stored rows are looked for by ``locate``, columns
        that equal keys share (the keys themselves by default); a caller that knows
        all these partitions gives them.  Stored rows with other values of ``locate``
        are written where they are read, without a shuffle.  ``stored``: the updates lie in files, as
        staged ones do, and are read again instead of copied.
        """
        kept = stored or getattr(updates, "staged_at", None)
        updates = conform(updates, TABLES[name]) if name in TABLES else updates
        start = self.version(name)
        by = self.partition_columns(updates.columns)
        # Rows that are staged already, or read only once, need no copy.
        once = partitions is not None and not start.within(partitions if by else None)
        staged = None
        if not (kept or once):
            updates = staged = self.stage(updates)
        if not by:
            partitions = None
        elif partitions is None:
            partitions = self.touched(updates)
            if not set(by) <= set(keys):
                partitions = list(dict.fromkeys(partitions + self.holding(name, updates.select(*(locate or keys)).distinct())))
        replaced = set(start.within(partitions))
        merged, added = updates, []
        if replaced:
            existing = self._rows(name, start, partitions, stamped=name in TABLES)
            if by and locate:
                existing, apart = self._apart(existing, updates, locate)
                added = self._add(name, apart, placed=True) if apart is not None else []
            merged = upsert(existing, updates, keys)
        # New rows of whole seasons that lie in files by season stay in their order.
        placed = stored and not replaced and self.partitions == ("season",)
        added += self._add(name, merged, placed)
        self.publish(name, start, [f for f in start.folders if f not in replaced] + added)
        if staged is not None:
            self.unstage(staged)

    def _apart(self, existing: DataFrame, updates: DataFrame, locate: list[str]) -> tuple[DataFrame, DataFrame | None]:
        """Stored rows that updates may replace, and all others; no others where the updates' places outgrow a broadcast.

        A key that lacks a part may equal one of another game, so rows of such keys may always be replaced.
        """
        places = updates.select(*locate).distinct()
        if places.limit(FEW_PLACES + 1).count() > FEW_PLACES:
            return existing, None
        marked = existing.join(F.broadcast(places.withColumn("_met", F.lit(True))), locate, "left")
        met = F.col("_met").isNotNull()
        for part in dict.fromkeys([*locate, *(c for c in PITCH_KEY if c in existing.columns)]):
            met = met | F.col(part).isNull()
        return marked.filter(met).select(*existing.columns), marked.filter(~met).select(*existing.columns)

    def insert_ignore(self, name: str, updates: DataFrame, keys: list[str]) -> None:
        """Append rows whose key is new; stored rows win and stay where they are."""
        new = updates.join(self._rows(name).select(*keys), keys, "left_anti")
        self.append(name, conform(new, TABLES[name]))

    def seasons(self, name: str) -> list[int]:
        """Seasons that a table partitioned by them holds, by its manifest."""
        found = {f.split("/")[0].removeprefix("season=") for f in self.version(name).folders if f.startswith("season=")}
        return sorted(int(season) for season in found if season != _HIVE_NULL)

    def delete_season(self, season: int, tables: tuple[str, ...]) -> None:
        """Take one season out of every given table."""
        if self.partitions[:1] != ("season",):
            raise ValueError("season is not the first partition column")
        for name in (*tables, *(TALLIES[t] for t in tables if t in TALLIES)):
            start = self.version(name)
            gone = set(start.within([self._partition({"season": season})]))
            if gone:
                self.publish(name, start, [f for f in start.folders if f not in gone])
