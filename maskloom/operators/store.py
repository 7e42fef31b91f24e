"""The mapping as a table that grows by small saves.

A save writes a level: a folder of its own, dealt into hash buckets of the session and
sorted by it.  A manifest names the levels that count, oldest first, and is put in
place by one rename, so readers see a save as a whole or not at all, and keep the version
they began with while others write.  A batch's number goes into the manifest with its
level: a batch that runs again adds nothing.

Compaction merges levels of one tier into one of the next, so an entry is written again
once per tier, not once per save.  What a broken-off save or compaction leaves
behind is named by no manifest, and no reader looks at it.

A level holds entries and, without a placeholder, sessions that were saved again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.files import Folder
from maskloom.functions.rulebook import DEFAULT_TTL_SECONDS
from maskloom.operators.mapping import ENTRY_KEY, load_mapping
from maskloom.operators.numbering import MAPPING_COLUMNS
from maskloom.sources.corpus import SESSION

BUCKETS = 64
FANOUT = 4
_SCHEMA = (
    "system_id string, session_id string, epoch int, entity_type string, idx int, placeholder_key string, "
    "value string, first_seq bigint, first_ts timestamp, saved_ts timestamp"
)


@dataclass(frozen=True)
class Level:
    """One folder of entries; ``held`` are the buckets in it."""

    name: str
    tier: int
    held: tuple[int, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    levels: tuple[Level, ...] = ()
    #: Last batch of each writer.
    done: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        levels = tuple(Level(lv["name"], lv["tier"], tuple(lv["held"])) for lv in raw["levels"])
        return cls(raw["version"], raw["buckets"], levels, raw["done"])


class MappingStore:
    """A mapping table at ``path``, made with the first save."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fanout: int = FANOUT) -> None:
        self.spark, self.path, self._new_buckets, self.fanout = spark, path.rstrip("/"), buckets, fanout
        self._folder = Folder(spark, f"{self.path}/manifest")

    # --- versions ---------------------------------------------------------------

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or the one of ``version``."""
        if version is None:
            known = [int(n.removesuffix(".json")) for n in self._folder.names() if n.endswith(".json") and not n.startswith(".")]
            if not known:
                return Manifest(0, self._new_buckets)
            version = max(known)
        return Manifest.from_json(self._folder.read(f"{version:012d}.json"))

    def _publish(self, change: Callable[[Manifest], Manifest | None]) -> Manifest | None:
        """Apply ``change`` to the newest manifest; again if another writer was faster, not at all if it gives None."""
        while True:
            now = self.manifest()
            then = change(now)
            if then is None:
                return None
            then = Manifest(now.version + 1, now.buckets, then.levels, then.done)
            if self._folder.publish(f"{then.version:012d}.json", then.to_json()):
                return then

    # --- writing ----------------------------------------------------------------

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*SESSION), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int, tier: int) -> Level | None:
        """A level of these rows; None if there are none.

        Dealt by ranges of bucket, session and entry, so a large session is several tasks
        and files, and each file holds few sessions.
        """
        name = uuid.uuid4().hex
        place = f"{self.path}/levels/{name}"
        ordered = ["bucket", *SESSION, "epoch", "placeholder_key"]
        dealt = rows.select(*MAPPING_COLUMNS, self.bucket_of(buckets).alias("bucket")).repartitionByRange(*ordered)
        dealt.sortWithinPartitions(*ordered).write.partitionBy("bucket").parquet(place)
        held = sorted(int(n.removeprefix("bucket=")) for n in Folder(self.spark, place).names() if n.startswith("bucket="))
        return Level(name, tier, tuple(held)) if held else None

    def committed(self, writer: str, batch: int) -> bool:
        return self.manifest().done.get(writer, -1) >= batch

    def save(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Add entries; the same key is overwritten and a session's save time only grows.

        Rows without ``placeholder_key`` only say that their session was saved.  False,
        and nothing added, if this batch of ``writer`` is there already or there are no rows.
        """
        if writer is not None and self.committed(writer, batch):
            return False
        level = self._write(rows, self.manifest().buckets, 0)
        added = () if level is None else (level,)

        def appended(now: Manifest) -> Manifest | None:
            if writer is None:
                return Manifest(0, 0, now.levels + added, now.done) if added else None
            if now.done.get(writer, -1) >= batch:
                return None
            return Manifest(0, 0, now.levels + added, now.done | {writer: batch})

        return self._publish(appended) is not None and level is not None

    # --- reading ----------------------------------------------------------------

    def _rows(self, manifest: Manifest, wanted: set[int] | None, levels: tuple[Level, ...] | None = None) -> DataFrame:
        """What the levels hold in the wanted buckets, with the level's ``turn``."""
        out = None
        for turn, level in enumerate(manifest.levels if levels is None else levels):
            held = [b for b in level.held if wanted is None or b in wanted]
            if not held:
                continue
            root = f"{self.path}/levels/{level.name}"
            part = self.spark.read.schema(_SCHEMA).parquet(*[f"{root}/bucket={b}" for b in held])
            part = part.withColumn("turn", F.lit(turn))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], f"{_SCHEMA}, turn int")

    def _wanted(self, sessions: DataFrame | list[tuple[str, str]] | None, manifest: Manifest) -> set[int] | None:
        """Buckets of the sessions: as many numbers as there are buckets at most."""
        if sessions is None:
            return None
        if isinstance(sessions, list):
            sessions = self.spark.createDataFrame(sessions, "system_id string, session_id string")
        return {r["b"] for r in sessions.select(self.bucket_of(manifest.buckets).alias("b")).distinct().collect()}

    def _chosen(self, rows: DataFrame, sessions: DataFrame | list[tuple[str, str]] | None) -> DataFrame:
        if isinstance(sessions, list):
            # A plain condition, so that Parquet skips the row groups of other sessions.
            either = F.lit(False)
            for system, session in sessions:
                either = either | ((F.col("system_id") == system) & (F.col("session_id") == session))
            return rows.where(either)
        return rows if sessions is None else rows.join(sessions.select(*SESSION).distinct(), SESSION, "left_semi")

    def read(self, sessions: DataFrame | list[tuple[str, str]] | None = None, version: int | None = None) -> DataFrame:
        """The mapping, or that of some sessions, as of a version of the table (the newest by default).

        Only the buckets of the sessions are read, and of a list of sessions only the row
        groups that may hold them.
        """
        manifest = self.manifest(version)
        rows = self._chosen(self._rows(manifest, self._wanted(sessions, manifest)), sessions)
        return _merged(rows).where("placeholder_key IS NOT NULL")

    def epochs(self, sessions: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """``(system, session, epoch, saved_ts)``: last save of each epoch, those without entries too."""
        manifest = self.manifest(version)
        rows = self._chosen(self._rows(manifest, self._wanted(sessions, manifest)), sessions)
        return rows.groupBy(*SESSION, "epoch").agg(F.max("saved_ts").alias("saved_ts"))

    def load(self, sessions: list[tuple[str, str]], at: str, ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
        """Entries of the sessions that are alive at ``at``."""
        return load_mapping(self.read(sessions), at, ttl)

    # --- compaction -------------------------------------------------------------

    def compact(self) -> int:
        """Merge tiers of ``fanout`` levels or more until there are none; how many levels were merged."""
        merged = 0
        while True:
            levels = self.manifest().levels
            tiers = [lv.tier for lv in levels]
            full = [t for t in sorted(set(tiers)) if tiers.count(t) >= self.fanout]
            if not full:
                return merged
            gone = tuple(lv for lv in levels if lv.tier == full[0])
            self._replace(gone, full[0] + 1)
            merged += len(gone)

    def rewrite(self, change: Callable[[DataFrame], DataFrame] = lambda mapping: mapping) -> None:
        """Merge all levels into one and apply ``change`` on the way, such as `forget_sessions` or `purge_expired`."""
        levels = self.manifest().levels
        if levels:
            self._replace(levels, max(lv.tier for lv in levels), change)

    def _replace(self, gone: tuple[Level, ...], tier: int, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
        manifest = self.manifest()
        rows = _merged(self._rows(manifest, None, gone))
        level = self._write(change(rows) if change else rows, manifest.buckets, tier)
        names = {lv.name for lv in gone}

        def swapped(now: Manifest) -> Manifest | None:
            if not names <= {lv.name for lv in now.levels}:
                # Someone else has merged them; what was written here is left unnamed.
                return None
            first = next(i for i, lv in enumerate(now.levels) if lv.name in names)
            kept = [lv for lv in now.levels if lv.name not in names]
            return Manifest(0, 0, tuple(kept[:first] + ([level] if level else []) + kept[first:]), now.done)

        self._publish(swapped)


def _merged(rows: DataFrame) -> DataFrame:
    """One row per entry, the last one saved, and one without placeholder per epoch; all with their epoch's last save.

    Partial sums meet on the whole entry key, so a large session is never one group.
    """
    rest = [c for c in MAPPING_COLUMNS if c not in ENTRY_KEY]
    latest = (
        rows.groupBy(*ENTRY_KEY).agg(F.max_by(F.struct(*rest), F.struct("saved_ts", "turn")).alias("kept"))
        .select(*ENTRY_KEY, "kept.*").drop("saved_ts")
    )
    saves = rows.groupBy(*SESSION, "epoch").agg(F.max("saved_ts").alias("saved_ts"))
    return latest.join(saves, [*SESSION, "epoch"]).select(*MAPPING_COLUMNS)
