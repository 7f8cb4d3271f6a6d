"""Import of units: batch merges into immutable snapshots, and the same merge as a streaming sink.

A snapshot is a manifest: the folders of Parquet files that make up each table. A merge writes only
what is new. Records never change, so their symbols and occurrences, and the files once seen, are
added once; units and their edges lie in buckets by unit name, and only the buckets that a merge
touches are written again. A manifest becomes the current one by the exclusive creation of the next
numbered pointer, so readers see a snapshot whole, and of two writers one fails and reads again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symlake.model import EVENTS, FILES, SCHEMAS, TOLD, TRIGGERS
from symlake.operators.store import map_paths
from symlake.plans.index import CodeIndex, Once, broadcast_if_small, checkpoint, closure
from symlake.streaming import monitor

#: Tables in buckets by unit, tables that only grow.
BUCKETED = ("units", "unit_deps", "unit_includes")
GROWING = ("record_symbols", "occurrences", "files", "told")
_ALL = SCHEMAS | {"files": FILES, "told": TOLD, "triggers": TRIGGERS}
#: A pointer without its manifest's name after so many seconds is that of a writer that died.
CLAIM_SECONDS, TRIES = 60, 5
#: Rows a file of what delegates are told.
TOLD_ROWS = 1_000_000


class IndexError_(Exception):
    """An index that can't be opened or imported."""


class Conflict(IndexError_):
    """Another writer made the next snapshot."""


def stale_units(stored: DataFrame, landing: DataFrame, ignore_mod_time: bool = False) -> DataFrame:
    """landing rows to import: those whose time isn't exactly the stored one; all of them if times are ignored."""
    if ignore_mod_time:
        return landing
    # Equal times as two conditions: the rows, joined by unit before, aren't shuffled again by time too.
    old = stored.select(F.col("unit_name").alias("old_name"), F.col("mod_time_ns").alias("old_time"))
    same = (F.col("unit_name") == F.col("old_name")) & (F.col("mod_time_ns") <= F.col("old_time")) & (F.col("mod_time_ns") >= F.col("old_time"))
    return landing.join(old, same, "left_anti")


def record_symbols(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per record and symbol: roles and related roles united over the occurrences; names and kinds from symbols (usr, …), the first by ord if there is one, else the smallest."""
    own = occurrences.groupBy("record_name", "usr").agg(F.bit_or("roles").alias("roles"))
    related = occurrences.select("record_name", F.explode("relations").alias("r")).groupBy("record_name", F.col("r.usr").alias("usr")).agg(F.bit_or("r.roles").alias("related_roles"))
    facts = F.struct(*[c for c in symbols.columns if c not in ("usr", "ord")])
    info = symbols.groupBy("usr").agg((F.min_by(facts, "ord") if "ord" in symbols.columns else F.min(facts)).alias("s"))
    return own.join(related, ["record_name", "usr"], "left").join(info, "usr").select("record_name", "usr", "s.*", "roles", F.coalesce("related_roles", F.lit(0).cast("long")).alias("related_roles"))


def poll_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(unit_name, kind) between two polls (unit_name, mod_time_ns). Unchanged units are Added again; the import passes over them."""
    old = before.select("unit_name", F.col("mod_time_ns").alias("old"))
    kind = F.when(F.col("old").isNull(), "Added").when(F.col("mod_time_ns").isNull(), "Removed").when(F.col("old") == F.col("mod_time_ns"), "Added").otherwise("Modified")
    return after.select("unit_name", "mod_time_ns").join(old, "unit_name", "full").select("unit_name", kind.alias("kind"))


@dataclass(frozen=True)
class Options:
    """explicit_outputs: at first, only units of these outputs and what they depend on are imported; None: all units.
    prefix_mappings: (original, replacement) prefixes of the landing tables' paths. watch: imported units are checked
    against the times of their files. buckets: of the tables by unit."""

    explicit_outputs: frozenset[str] | None = None
    readonly: bool = False
    prefix_mappings: tuple[tuple[str, str], ...] = ()
    watch: bool = False
    buckets: int = 64
    keep: int = 10


class Store:
    """Snapshots below one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):  # noqa: B008
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self.fs.exists(self._path(self.path)):
            if options.readonly:
                raise IndexError_(f"failed opening database: {self.path} does not exist")
            if not self.fs.mkdirs(self._path(self.path)):
                raise IndexError_(f"failed creating directory: {self.path}")

    # Manifests

    def _read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Creates a file that isn't there yet."""
        stream = self.fs.create(self._path(f"{self.path}/{name}"), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _pointers(self) -> list[tuple[int, int]]:
        """(number, time in ms) of the pointers, latest first."""
        found = [s for s in self.fs.listStatus(self._path(self.path)) if s.getPath().getName().startswith("current-")]
        return sorted(((int(s.getPath().getName()[8:]), s.getModificationTime()) for s in found), reverse=True)

    def _manifest(self) -> dict:
        """The latest manifest that is whole; pointers that dead writers left are taken away."""
        for n, made in self._pointers():
            name = self._read(f"current-{n:012d}")
            if name:
                return json.loads(self._read(name))
            if time.time() - made / 1000 > CLAIM_SECONDS and not self.options.readonly:
                self.fs.delete(self._path(f"{self.path}/current-{n:012d}"), False)
        outputs = self.options.explicit_outputs
        return {"number": 0, "buckets": self.options.buckets, "outputs": None if outputs is None else sorted(outputs), "tables": {t: {} if t in BUCKETED else [] for t in _ALL}}

    def _frame(self, table: str, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(_ALL[table]).parquet(*paths) if paths else self.spark.createDataFrame([], _ALL[table])

    def _table(self, manifest: dict, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        folders = manifest["tables"][table]
        if table in BUCKETED:
            folders = sorted({f for b, f in folders.items() if buckets is None or int(b) in buckets})
        return self._frame(table, folders)

    def _index(self, manifest: dict) -> CodeIndex:
        return CodeIndex(*(self._table(manifest, t) for t in SCHEMAS), files=self._table(manifest, "files"))

    def current(self) -> CodeIndex:
        """The latest snapshot, seen through its explicit outputs if there are such."""
        manifest = self._manifest()
        ix = self._index(manifest)
        return ix if manifest["outputs"] is None else ix.show_outputs(manifest["outputs"])

    def imported(self) -> CodeIndex:
        """All of the latest snapshot, whatever is visible of it."""
        return self._index(self._manifest())

    def outputs(self) -> list[str] | None:
        return self._manifest()["outputs"]

    def triggers(self) -> DataFrame:
        """(unit_name, path, trigger_ns): the files that units are out of date for."""
        return self._table(self._manifest(), "triggers")

    def told(self) -> DataFrame:
        """What delegates were told, in the order of snapshot and ord."""
        return self._table(self._manifest(), "told")

    def told_stream(self) -> DataFrame:
        """The same as a stream, for delegates that listen. Late ones get all that was told before."""
        return self.spark.readStream.schema(TOLD).parquet(f"{self.path}/told-*")

    def _publish(self, manifest: dict) -> None:
        name = f"manifest-{uuid.uuid4().hex}"
        n = manifest["number"] + 1
        self._write(name, json.dumps(manifest | {"number": n}))
        try:
            self._write(f"current-{n:012d}", name)
        except Py4JJavaError as e:
            self.fs.delete(self._path(f"{self.path}/{name}"), False)
            raise Conflict(f"snapshot {n} was written by another") from e

    def vacuum(self, keep: int | None = None) -> None:
        """Takes away all but the latest snapshots, and the folders that only those held. What is being written belongs to none yet, so folders younger than an hour stay."""
        numbers = [n for n, _ in self._pointers()]
        kept, old = numbers[: keep or self.options.keep], numbers[keep or self.options.keep :]
        names = {n: self._read(f"current-{n:012d}") for n in numbers}
        used: set[str] = set()
        for n in kept:
            if names[n]:
                used |= {f for t in json.loads(self._read(names[n]))["tables"].values() for f in (t.values() if isinstance(t, dict) else t)}
        for n in old:
            self.fs.delete(self._path(f"{self.path}/current-{n:012d}"), False)
            if names[n]:
                self.fs.delete(self._path(f"{self.path}/{names[n]}"), False)
        for s in self.fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if s.isDirectory() and not name.startswith("told-") and time.time() - s.getModificationTime() / 1000 > 3600 and not any(f == name or f.startswith(name + "/") for f in used):
                self.fs.delete(s.getPath(), True)

    # Import

    def merge(self, landing: CodeIndex, events: DataFrame, now_ns: int | None = None, outputs: list[str] | None = None) -> dict[str, int]:
        """Applies events (unit_name, kind, …; the last by seq counts) from the landing tables. Returns what a delegate would be told.

        outputs replaces the list of explicit outputs. If another writer was faster, all is done again on what it wrote.
        """
        if self.options.readonly:
            raise IndexError_("the index is read-only")
        landing, work = map_paths(landing, self.options.prefix_mappings), f"{self.path}/work-{uuid.uuid4().hex}"

        def once(df: DataFrame) -> DataFrame:
            """Written in columns, so smaller than a checkpoint, and of known size: what is small is broadcast."""
            at = f"{work}/{uuid.uuid4().hex}"
            df.write.parquet(at)
            return self.spark.read.schema(df.schema).parquet(at)

        try:
            return self._merge_until_published(landing, events, now_ns, outputs, once)
        finally:
            self.fs.delete(self._path(work), True)

    def _merge_until_published(self, landing: CodeIndex, events: DataFrame, now_ns: int | None, outputs: list[str] | None, once: Once) -> dict[str, int]:
        events = once(events.groupBy("unit_name").agg(F.max_by(F.struct("kind", "is_initial", "is_dependency", "ignore_mod_time"), "seq").alias("e")).select("unit_name", "e.*"))
        bad = landing.units.join(events, "unit_name", "left_semi").filter(~F.col("provider_kind").isin("clang", "swift")).limit(1).collect()
        if bad:
            raise IndexError_(f"unit {bad[0]['unit_name']} has the unknown provider {bad[0]['provider_kind']}")
        for _ in range(TRIES):
            try:
                return self._merge(landing, events, time.time_ns() if now_ns is None else now_ns, outputs, once)
            except Conflict as e:
                conflict = e
        raise IndexError_(str(conflict))

    def _fresh(self, manifest: dict, stored: DataFrame, landing: CodeIndex, last: DataFrame) -> DataFrame:
        """(unit_name, mod_time_ns, main_file, out_file) of landing units to import."""
        flag = lambda c: F.coalesce(c, F.lit(False))
        units = landing.units.select("unit_name", "mod_time_ns", "main_file", "out_file")
        found = units.join(last.filter("kind in ('Added', 'Modified')"), "unit_name")
        if manifest["outputs"] is None:
            wanted = found
        else:
            wanted = found.filter(F.col("out_file").isin(manifest["outputs"]) | flag("is_dependency"))
            # What wanted units depend on, with main files too, is imported where it is missing or another version.
            edges = landing.unit_deps.filter("kind = 'unit'").select(F.col("unit_name").alias("src"), F.col("name").alias("dst"))
            reached = checkpoint(closure(wanted.select(F.col("unit_name").alias("seed"), F.col("unit_name").alias("node")), edges).select(F.col("node").alias("unit_name")).distinct())
            more = units.join(broadcast_if_small(reached), "unit_name", "left_semi").join(wanted.select("unit_name"), "unit_name", "left_anti")
            wanted = wanted.select(*units.columns, "ignore_mod_time").unionByName(more.withColumn("ignore_mod_time", F.lit(False)))
        stale = stale_units(stored, wanted.filter(~flag("ignore_mod_time")).select(*units.columns))
        return wanted.filter(flag("ignore_mod_time")).select(*units.columns).unionByName(stale)

    def _merge(self, landing: CodeIndex, last: DataFrame, now_ns: int, outputs: list[str] | None, once: Once) -> dict[str, int]:
        manifest = self._manifest()
        if outputs is not None:
            manifest["outputs"] = sorted(outputs)
        number, tables, folder = manifest["number"] + 1, manifest["tables"], uuid.uuid4().hex
        fresh = once(self._fresh(manifest, self._table(manifest, "units"), landing, last))
        gone = once(last.filter("kind = 'Removed'").select("unit_name").unionByName(fresh.select("unit_name")).distinct())
        bucket = F.pmod(F.xxhash64("unit_name"), F.lit(manifest["buckets"])).cast("int")
        # At most one row a bucket.
        touched = sorted(r[0] for r in gone.select(bucket.alias("b")).distinct().collect())
        deps, includes = landing.of_units(fresh.select("unit_name"), once)
        new_rows = {"units": landing.units.join(fresh.select("unit_name"), "unit_name", "left_semi"), "unit_deps": deps, "unit_includes": includes}
        for t in BUCKETED if touched else ():
            old = self._table(manifest, t, touched).filter(bucket.isin(touched)).join(gone, "unit_name", "left_anti")
            new = new_rows[t].select(*_ALL[t].names)
            # No task holds a bucket: each writes a file for those of its units, so a task stays as small as it was.
            old.unionByName(new).withColumn("bucket", bucket).sortWithinPartitions("bucket", "unit_name").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/{t}")
            there = {s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/{folder}/{t}"))}
            for b in touched:
                tables[t].pop(str(b), None)
                if f"bucket={b}" in there:
                    tables[t][str(b)] = f"{folder}/{t}/bucket={b}"

        needed = deps.filter("kind = 'record'").select(F.col("name").alias("record_name")).distinct()
        needed = once(needed.join(self._table(manifest, "record_symbols").select("record_name").distinct(), "record_name", "left_anti"))
        if needed.limit(1).count():
            for t, rows in zip(("record_symbols", "occurrences"), landing.of_records(needed, once), strict=True):
                # Lookups go by symbol: each lies in one file, in order, and statistics prune.
                rows.select(*_ALL[t].names).sortWithinPartitions("usr").write.parquet(f"{self.path}/{folder}/{t}")
                tables[t].append(f"{folder}/{t}")
        paths = once(deps.filter(F.col("kind").isin("record", "file")).select("path").distinct().join(self._table(manifest, "files"), "path", "left_anti"))
        if paths.limit(1).count():
            paths.write.parquet(f"{self.path}/{folder}/files")
            tables["files"].append(f"{folder}/files")

        # What delegates are told: pending, processed, out of date, completed.
        counts = last.agg(F.count("*"), F.count_if(F.coalesce("is_initial", F.lit(False)))).first()
        # Only explicit outputs bring units that no event names.
        more = 0 if manifest["outputs"] is None else fresh.join(last, "unit_name", "left_anti").count()
        pending, processed = counts[0] + more, fresh.count()
        rows = [(1, "initial_pending", counts[1])] * bool(counts[1]) + [(2, "added_pending", pending)]
        told = [self.spark.createDataFrame(rows, "ord int, kind string, n long"), fresh.withColumn("ord", F.lit(3)).withColumn("kind", F.lit("processed_unit"))]
        stale = 0
        if self.options.watch and landing.file_stats is not None:
            ix = replace(self._index(manifest), file_stats=landing.file_stats)
            # A unit that was imported again starts without triggers.
            known = self._table(manifest, "triggers").join(gone, "unit_name", "left_anti")
            out, triggers = monitor.check_imported(ix, fresh, now_ns, known, initial=bool(counts[1]))
            triggers.write.parquet(f"{self.path}/{folder}/triggers")
            tables["triggers"] = [f"{folder}/triggers"]
            out = checkpoint(out)
            stale = out.count()
            told.append(out.withColumnRenamed("path", "trigger_path").withColumn("ord", F.lit(4)).withColumn("kind", F.lit("out_of_date")))
        told.append(self.spark.createDataFrame([(5, "completed", pending)], "ord int, kind string, n long"))
        self._tell(manifest, number, told, folder, processed + stale)
        self._publish(manifest)
        self.vacuum()
        return {"added_pending": pending, "completed": pending, "processed": processed, "out_of_date": stale}

    def _tell(self, manifest: dict, number: int, told: list[DataFrame], folder: str, rows: int) -> None:
        whole = told[0]
        for t in told[1:]:
            whole = whole.unionByName(t, allowMissingColumns=True)
        columns = [(F.lit(number).cast("long") if f.name == "snapshot" else F.col(f.name) if f.name in whole.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TOLD.fields]
        whole.select(*columns).coalesce(1 + rows // TOLD_ROWS).write.parquet(f"{self.path}/told-{folder}")
        manifest["tables"]["told"].append(f"told-{folder}")

    def check_files(self, landing: CodeIndex, paths: list[str], now_ns: int | None = None, directories: bool = False) -> DataFrame:
        """What is out of date for files (or for what lies in directories) by the times in landing; the triggers are kept, so the same isn't told twice."""
        manifest = self._manifest()
        ix = replace(self._index(manifest), file_stats=map_paths(landing, self.options.prefix_mappings).file_stats)
        check = monitor.check_directories if directories else monitor.check_files
        out, triggers = check(ix, paths, time.time_ns() if now_ns is None else now_ns, self._table(manifest, "triggers"))
        out, folder = checkpoint(out), uuid.uuid4().hex
        if out.limit(1).count() and not self.options.readonly:
            triggers.write.parquet(f"{self.path}/{folder}/triggers")
            manifest["tables"]["triggers"] = [f"{folder}/triggers"]
            self._tell(manifest, manifest["number"] + 1, [out.withColumnRenamed("path", "trigger_path").withColumn("ord", F.lit(4)).withColumn("kind", F.lit("out_of_date"))], folder, out.count())
            self._publish(manifest)
        return out

    def _events(self, units: DataFrame, kind: str, dependency: bool, ignore: bool, initial: bool = False) -> DataFrame:
        return units.select(F.lit(0).cast("long").alias("seq"), F.lit(kind).alias("kind"), "unit_name", F.lit(initial).alias("is_initial"), F.lit(dependency).alias("is_dependency"), F.lit(ignore).alias("ignore_mod_time"))

    def _of_outputs(self, landing: CodeIndex, outputs: list[str]) -> DataFrame:
        return map_paths(landing, self.options.prefix_mappings).units.filter(F.col("out_file").isin(outputs))

    def process_outputs(self, landing: CodeIndex, outputs: list[str]) -> dict[str, int]:
        """Imports the units of output paths again, whatever their times."""
        return self.merge(landing, self._events(self._of_outputs(landing, outputs), "Modified", True, True))

    def add_outputs(self, landing: CodeIndex, outputs: list[str]) -> dict[str, int]:
        """Adds to the explicit outputs, and imports their units with what they depend on."""
        known = self._manifest()["outputs"] or []
        return self.merge(landing, self._events(self._of_outputs(landing, outputs), "Added", False, False, True), outputs=sorted({*known, *outputs}))

    def remove_outputs(self, landing: CodeIndex, outputs: list[str]) -> dict[str, int]:
        """Takes outputs from the explicit ones and removes their units; what only they depended on stays imported."""
        known = self._manifest()["outputs"] or []
        return self.merge(landing, self._events(self._of_outputs(landing, outputs), "Removed", False, False), outputs=sorted({*known} - {*outputs}))

    def poll(self, landing: CodeIndex, before: DataFrame | None = None, initial: bool = False) -> dict[str, int]:
        """Imports what changed since the poll before (unit_name, mod_time_ns); without one, since what is stored."""
        before = self._table(self._manifest(), "units") if before is None else before
        events = poll_events(before, landing.units.select("unit_name", "mod_time_ns"))
        return self.merge(landing, events.select(F.lit(0).cast("long").alias("seq"), "kind", "unit_name", F.lit(initial).alias("is_initial"), F.lit(False).alias("is_dependency"), F.lit(False).alias("ignore_mod_time")))

    def listen(self, landing: CodeIndex, events_path: str, checkpoint: str, max_files: int = 10, once: bool = True) -> StreamingQuery:
        """Unit events as they arrive in a folder of Parquet files; each micro-batch is one snapshot. once: up to what is there now, else until stopped."""
        stream = self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(events_path)
        writer = stream.writeStream.foreachBatch(lambda batch, _: self.merge(landing, batch) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
