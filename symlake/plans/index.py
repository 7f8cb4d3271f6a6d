"""The tables of one snapshot, and the plans that several operators share: file references, visibility, closures."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.functions.exprs import name_searchable
from symlake.model import DECL, DEF, KIND_BUCKETS, UNIT_TEST


#: Rows of a level that are broadcast.
FEW = 10_000


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder; a temporary one only where none is named."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        context, shared = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="symlake-checkpoints-"))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A broadcast hint only behind a count; beyond it the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def closure(seeds: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(seed, node) reachable over edges (src, dst) from seeds (seed, node), those included.

    One join a level for all seeds together, with the visited pairs taken out, so cycles and diamonds
    end. Nodes in stop (node) are reached but not left. A level of few rows is broadcast, counted
    before, so that a walk from a few seeds only scans the edges and doesn't shuffle them.
    """
    frontier = visited = checkpoint(seeds.select("seed", "node").distinct())
    level, width = 0, int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while size := frontier.count():
        small = size <= FEW
        leaving = frontier
        if stop is not None:
            # The stops among few nodes are few as well.
            at = F.broadcast(stop.join(F.broadcast(frontier.select("node").distinct()), "node", "left_semi")) if small else stop
            leaving = frontier.join(at, "node", "left_anti")
        step = edges.join(F.broadcast(leaving) if small else leaving, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(visited, ["seed", "node"], "left_anti"))
        level, visited = level + 1, visited.unionByName(frontier)
        if level % 8 == 0:  # what was visited stays few files, however deep the walk
            visited = checkpoint(visited.coalesce(width))
    return visited


Once = Callable[[DataFrame], DataFrame]
Find = Callable[[DataFrame, Once], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Source:
    """Where tables come from, if there is a shorter way to some units or records than a join with the finished tables.

    of_units: from (unit_name) to unit_deps and unit_includes. of_records: from (record_name) to record_symbols
    and occurrences, all rows of a symbol in one partition. Names are distinct; a function writes what both
    frames are made from.
    """

    tables: tuple[DataFrame, DataFrame, DataFrame, DataFrame]
    of_units: Find
    of_records: Find


@dataclass(frozen=True)
class CodeIndex:
    """The model's tables. visible holds the units that visibility lets through; None: all of them."""

    units: DataFrame
    unit_deps: DataFrame
    unit_includes: DataFrame
    record_symbols: DataFrame
    occurrences: DataFrame
    file_stats: DataFrame | None = None
    visible: DataFrame | None = None
    #: (path) of all files ever imported; None: those of the units that are there.
    files: DataFrame | None = None
    source: Source | None = None

    @property
    def spark(self) -> SparkSession:
        return self.units.sparkSession

    def visible_units(self) -> DataFrame:
        return self.units if self.visible is None else self.units.join(self.visible.select("unit_name"), "unit_name", "left_semi")

    def with_units(self, condition: Column) -> CodeIndex:
        return replace(self, visible=self.units.filter(condition).select("unit_name"))

    def of_units(self, names: DataFrame, once: Once) -> tuple[DataFrame, DataFrame]:
        """unit_deps and unit_includes of units (unit_name, distinct). once writes a frame that both are made from."""
        if self.source is not None and self.source.tables[0] is self.unit_deps and self.source.tables[1] is self.unit_includes:
            return self.source.of_units(names, once)
        return self.unit_deps.join(names, "unit_name", "left_semi"), self.unit_includes.join(names, "unit_name", "left_semi")

    def of_records(self, names: DataFrame, once: Once) -> tuple[DataFrame, DataFrame]:
        """record_symbols and occurrences of records (record_name, distinct), all rows of a symbol in one partition."""
        if self.source is not None and self.source.tables[2] is self.record_symbols and self.source.tables[3] is self.occurrences:
            return self.source.of_records(names, once)
        return tuple(t.join(names, "record_name", "left_semi").repartitionByRange("usr") for t in (self.record_symbols, self.occurrences))

    # Visibility

    def show_main_files(self, paths: list[str]) -> CodeIndex:
        return self._shown("main_file", paths)

    def show_outputs(self, out_files: list[str]) -> CodeIndex:
        """Explicit outputs: with none, nothing is visible."""
        return self._shown("out_file", out_files)

    def _shown(self, key: str, values: list[str]) -> CodeIndex:
        """Units with a main file pass by their own key; mainless ones if one of their root units does."""
        wanted = self.spark.createDataFrame([(v,) for v in values], f"{key} string")
        own = self.units.filter("has_main_file").join(wanted, key, "left_semi").select("unit_name")
        roots = self.roots(self.units.filter("not has_main_file").select("unit_name"))
        through = roots.join(own.withColumnRenamed("unit_name", "root"), "root", "left_semi").select("unit_name").distinct()
        return replace(self, visible=checkpoint(own.unionByName(through).distinct()))

    # Graphs over units

    def roots(self, units: DataFrame) -> DataFrame:
        """(unit_name, root) upwards from each of units (unit_name): a unit with a main file is a root and ends the walk."""
        deps = self.unit_deps.filter("kind = 'unit'").select(F.col("name").alias("src"), F.col("unit_name").alias("dst"))
        main = self.units.filter("has_main_file").select(F.col("unit_name").alias("node"))
        reached = closure(units.select(F.col("unit_name").alias("seed"), F.col("unit_name").alias("node")), deps, main)
        return reached.join(main, "node", "left_semi").select(F.col("seed").alias("unit_name"), F.col("node").alias("root"))

    def dependency_closure(self, units: DataFrame) -> DataFrame:
        """(unit_name, dependency) downwards, each unit itself included."""
        deps = self.unit_deps.filter("kind = 'unit'").select(F.col("unit_name").alias("src"), F.col("name").alias("dst"))
        return closure(units.select(F.col("unit_name").alias("seed"), F.col("unit_name").alias("node")), deps).select(F.col("seed").alias("unit_name"), F.col("node").alias("dependency"))

    # Shared frames

    def file_refs(self, units: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
        """The files of each record among the visible units: the latest unit of a file wins; module and system flag stay those of its first unit.

        One aggregation with map-side combine: a record shared by very many units is no large group.
        records (record_name) are the only ones that are asked for, if given.
        """
        units = self.visible_units() if units is None else units
        wins = F.struct((-F.col("mod_time_ns")).alias("t"), F.col("unit_name"))
        deps = self.unit_deps.filter("kind = 'record'").select(F.col("name").alias("record_name"), "path", "unit_name", F.col("module_name").alias("m"), F.col("is_system").alias("s"))
        if records is not None:
            deps = deps.join(records.select("record_name").distinct(), "record_name", "left_semi")
        return (
            deps.join(units.select("unit_name", "mod_time_ns", "target", "sysroot", "provider_kind"), "unit_name")
            .groupBy("record_name", "path")
            .agg(F.min_by(F.struct("unit_name", "mod_time_ns", "target", "sysroot", "provider_kind"), wins).alias("w"), F.min_by(F.struct("m", "s"), F.col("unit_name")).alias("first"))
            .select("record_name", "path", "w.unit_name", "w.mod_time_ns", F.col("first.m").alias("module_name"), F.col("first.s").alias("is_system"), "w.target", "w.sysroot", "w.provider_kind")
        )

    def symbol_names(self) -> DataFrame:
        """(name, usr): declared or defined, with a name, searchable."""
        found = self.record_symbols.filter((F.col("roles").bitwiseAND(F.lit(DECL | DEF)) != 0) & (F.col("name") != "") & name_searchable("kind", "language"))
        return found.select("name", "usr").distinct()

    def symbol_kinds(self) -> DataFrame:
        """(bucket, usr): C++ structs stand under class, unit tests under testClass and testMethod as well."""
        s = self.record_symbols.filter(F.col("roles").bitwiseAND(F.lit(DECL | DEF)) != 0)
        kind = F.when((F.col("kind") == "struct") & (F.col("language") == "cxx"), F.lit("class")).when(F.col("kind").isin(*KIND_BUCKETS), F.col("kind"))
        test = (F.col("properties").bitwiseAND(F.lit(UNIT_TEST)) != 0) & (F.col("roles").bitwiseAND(F.lit(DEF)) != 0)
        tests = F.when(test & F.col("kind").isin("class", "extension"), F.lit("testClassOrExtension")).when(test & (F.col("kind") == "instanceMethod"), F.lit("testMethod"))
        return s.select(F.explode(F.array_compact(F.array(kind, tests))).alias("bucket"), "usr").distinct()


@dataclass(frozen=True)
class Visibility:
    """What is registered to be visible: main files with a count of registrations, or, if explicit, output files. Edits give a new value."""

    main_files: tuple[tuple[str, int], ...] = ()
    out_files: frozenset[str] = frozenset()
    explicit: bool = False

    def register_main_files(self, paths: Iterable[str], product: str = "") -> Visibility:
        """One registration more for each path; product has no effect."""
        return replace(self, main_files=tuple(sorted((Counter(dict(self.main_files)) + Counter(paths)).items())))

    def unregister_main_files(self, paths: Iterable[str], product: str = "") -> Visibility:
        """One registration less; a path stays while some are left, and unknown ones are passed over."""
        return replace(self, main_files=tuple(sorted((Counter(dict(self.main_files)) - Counter(paths)).items())))

    def add_outputs(self, paths: Iterable[str]) -> Visibility:
        return replace(self, out_files=self.out_files | set(paths))

    def remove_outputs(self, paths: Iterable[str]) -> Visibility:
        return replace(self, out_files=self.out_files - set(paths))

    def apply(self, ix: CodeIndex) -> CodeIndex:
        """The index as it is seen: explicit outputs only if explicit, else registered main files, else everything."""
        if self.explicit:
            return ix.show_outputs(sorted(self.out_files))
        return ix.show_main_files([p for p, _ in self.main_files]) if self.main_files else replace(ix, visible=None)
