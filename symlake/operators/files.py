"""Queries over files, units and includes, and what is out of date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.functions.exprs import base_name, extension, is_swift, matches, parent_dir
from symlake.plans.index import CodeIndex, checkpoint


def units_containing_file(ix: CodeIndex, paths: Sequence[str] | None = None) -> DataFrame:
    """(path, unit_name), for some or all files."""
    deps = ix.unit_deps.filter(F.col("kind").isin("record", "file") & (F.col("path") != ""))
    return (deps if paths is None else deps.filter(F.col("path").isin(list(paths)))).select("path", "unit_name").distinct()


def dependent_units(ix: CodeIndex, units: Sequence[str]) -> DataFrame:
    return ix.unit_deps.filter((F.col("kind") == "unit") & F.col("name").isin(list(units))).select(F.col("name").alias("dependency"), "unit_name").distinct()


def main_units_containing_file(ix: CodeIndex, paths: Sequence[str], cross_language: bool = True) -> DataFrame:
    """(path, unit_name, mod_time_ns, main_file, out_file), one row per root unit; else of the file's own language only."""
    holding = units_containing_file(ix, paths)
    roots = holding.join(ix.roots(holding.select("unit_name").distinct()), "unit_name").select("path", "root").distinct()
    found = roots.join(ix.units.select(F.col("unit_name").alias("root"), "mod_time_ns", "main_file", "out_file"), "root").withColumnRenamed("root", "unit_name")
    return found if cross_language else found.filter(is_swift("path") == F.col("main_file").endswith(".swift"))


def main_files_containing_file(ix: CodeIndex, paths: Sequence[str], cross_language: bool = False) -> DataFrame:
    return main_units_containing_file(ix, paths, cross_language).select("path", "main_file")


def unit_names_containing_file(ix: CodeIndex, paths: Sequence[str]) -> DataFrame:
    """The root units of each file."""
    return main_units_containing_file(ix, paths).select("path", "unit_name")


def _includes(ix: CodeIndex, key: str, other: str, paths: Sequence[str]) -> DataFrame:
    holding = units_containing_file(ix, paths).join(ix.visible_units().select("unit_name"), "unit_name", "left_semi")
    rows = ix.unit_includes.filter(F.col(key).isin(list(paths))).join(holding.withColumnRenamed("path", key), ["unit_name", key], "left_semi")
    return rows.groupBy(key, other).agg(F.min("line").alias("line"))


def files_included_by(ix: CodeIndex, paths: Sequence[str]) -> DataFrame:
    return _includes(ix, "source_path", "target_path", paths)


def files_including(ix: CodeIndex, paths: Sequence[str]) -> DataFrame:
    return _includes(ix, "target_path", "source_path", paths)


def includes_of_unit(ix: CodeIndex, unit: str) -> DataFrame:
    return ix.unit_includes.filter(F.col("unit_name") == unit).orderBy("ord").select("source_path", "target_path", "line")


def known_files(ix: CodeIndex, paths: Sequence[str]) -> DataFrame:
    """(path, known) for each of paths."""
    asked = ix.spark.createDataFrame([(p,) for p in paths], "path string")
    visible = units_containing_file(ix, paths).join(ix.visible_units().select("unit_name"), "unit_name", "left_semi").select("path").distinct().withColumn("known", F.lit(True))
    return asked.join(visible, "path", "left").select("path", F.coalesce("known", F.lit(False)).alias("known"))


def files_of_unit(ix: CodeIndex, units: Sequence[str], follow_dependencies: bool = False) -> DataFrame:
    """(unit_name, path), distinct and in order; with follow_dependencies also of all units that it depends on."""
    asked = ix.spark.createDataFrame([(u,) for u in units], "unit_name string")
    paths = ix.unit_deps.filter(F.col("kind").isin("record", "file")).select(F.col("unit_name").alias("dependency"), "path")
    reach = ix.dependency_closure(asked) if follow_dependencies else asked.select("unit_name", F.col("unit_name").alias("dependency"))
    return reach.join(paths, "dependency").select("unit_name", "path").distinct().orderBy("unit_name", "path")


def all_files(ix: CodeIndex) -> DataFrame:
    """(path, dir, file): files of records and files; a store keeps those of removed units."""
    known = ix.unit_deps.filter(F.col("kind").isin("record", "file")).select("path") if ix.files is None else ix.files
    return known.distinct().select("path", parent_dir("path").alias("dir"), base_name("path").alias("file"))


def files_matching(ix: CodeIndex, pattern: str, **how: bool) -> DataFrame:
    """The pattern is held against the file name; object and module files are passed over."""
    return all_files(ix).filter(matches("file", pattern, **how) & ~extension("path").isin(".o", ".pcm")).select("path")


def files_in_directories(ix: CodeIndex, directories: Sequence[str]) -> DataFrame:
    return all_files(ix).filter(F.col("dir").isin([d.rstrip("/") or "/" for d in directories])).select("path")


def directories(ix: CodeIndex) -> DataFrame:
    return all_files(ix).select("dir").distinct()


def latest_unit_time(ix: CodeIndex, paths: Sequence[str] | None = None) -> DataFrame:
    """(path, mod_time_ns) of the latest unit that holds each file directly."""
    return units_containing_file(ix, paths).join(ix.units.select("unit_name", "mod_time_ns"), "unit_name").groupBy("path").agg(F.max("mod_time_ns").alias("mod_time_ns"))


def unit_time_by_output(ix: CodeIndex, outputs: Sequence[str]) -> DataFrame:
    """(out_file, mod_time_ns), null where no unit has the output."""
    asked = ix.spark.createDataFrame([(o,) for o in outputs], "out_file string")
    return asked.join(ix.units.select("out_file", "mod_time_ns"), "out_file", "left")


def out_of_date(ix: CodeIndex, now_ns: int, dirty: DataFrame | None = None) -> DataFrame:
    """(unit_name, out_file, file_time_ns): units with a newer file. Files without a time aren't there: they count as changed now.

    dirty (path) restricts the files that are looked at.
    """
    deps = ix.unit_deps.filter(F.col("kind").isin("record", "file")).select("unit_name", "path").distinct()
    if dirty is not None:
        deps = deps.join(dirty.select("path").distinct(), "path", "left_semi")
    times = deps.join(ix.file_stats.select("path", "mtime_ns"), "path", "left").groupBy("unit_name").agg(F.max(F.coalesce("mtime_ns", F.lit(now_ns))).alias("file_time_ns"))
    return ix.units.join(times, "unit_name").filter("file_time_ns > mod_time_ns").select("unit_name", "out_file", "file_time_ns")


def is_out_of_date(ix: CodeIndex, output: str, mod_time_ns: int) -> bool:
    """Whether the unit of an output is older than a time; unknown outputs are."""
    row = ix.units.filter(F.col("out_file") == output).agg(F.max("mod_time_ns")).first()
    return row[0] is None or mod_time_ns > row[0]


def outputs_out_of_date(ix: CodeIndex, outputs: Sequence[str], dirty: Sequence[str], now_ns: int) -> DataFrame:
    """(out_file, out_of_date) for each output, against the newest of the dirty files; a file that isn't there is changed now, an unknown unit out of date."""
    asked = ix.spark.createDataFrame([(o,) for o in outputs], "out_file string").distinct()
    files = ix.spark.createDataFrame([(d,) for d in dirty], "path string").join(ix.file_stats.select("path", "mtime_ns"), "path", "left")
    newest = files.agg(F.max(F.coalesce("mtime_ns", F.lit(now_ns)))).first()[0]
    known = asked.join(ix.units.groupBy("out_file").agg(F.max("mod_time_ns").alias("t")), "out_file", "left")
    return known.select("out_file", (F.col("t").isNull() | F.coalesce(F.lit(newest) > F.col("t"), F.lit(False))).alias("out_of_date"))


def unit_test_usrs(ix: CodeIndex) -> DataFrame:
    """(usr): symbols that are searched for as test classes, extensions or methods."""
    return ix.symbol_kinds().filter(F.col("bucket").isin("testClassOrExtension", "testMethod")).select("usr").distinct()


def out_of_date_closure(ix: CodeIndex, triggers: DataFrame) -> DataFrame:
    """(unit_name, trigger_ns, notify): from triggers (unit_name, trigger_ns) to all dependents that are older, step by step.

    The latest trigger of a unit counts. Only units with a main file are notified; the walk goes on through others.
    """
    deps = ix.unit_deps.filter("kind = 'unit'").select(F.col("name").alias("src"), F.col("unit_name").alias("dst"))
    times = ix.units.select(F.col("unit_name").alias("dst"), "mod_time_ns")
    best = frontier = checkpoint(triggers.groupBy("unit_name").agg(F.max("trigger_ns").alias("trigger_ns")))
    while frontier.limit(1).count():
        step = (
            frontier.join(deps, F.col("unit_name") == F.col("src")).join(times, "dst").filter("mod_time_ns < trigger_ns")
            .groupBy(F.col("dst").alias("unit_name")).agg(F.max("trigger_ns").alias("trigger_ns"))
        )
        # The same or an older trigger for a unit changes nothing.
        frontier = checkpoint(step.join(best.withColumnRenamed("trigger_ns", "known"), "unit_name", "left").filter("known is null or trigger_ns > known").drop("known"))
        best = checkpoint(best.unionByName(frontier).groupBy("unit_name").agg(F.max("trigger_ns").alias("trigger_ns")))
    return best.join(ix.units.select("unit_name", F.col("has_main_file").alias("notify")), "unit_name")


