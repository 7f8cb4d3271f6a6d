"""What is out of date: monitored units, the files that made them so, and what delegates are told.

Units that aren't system ones are monitored. A trigger is a file with the time at which it changed;
a unit keeps one for each file, the latest. A trigger that a unit knows already, or a later one of the
same file, changes nothing. A new one marks the unit and goes on to all monitored units that depend
on it and are older than the trigger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.model import TRIGGERS
from symlake.operators.files import files_in_directories, units_containing_file
from symlake.plans.index import FEW, CodeIndex, checkpoint


def no_triggers(ix: CodeIndex) -> DataFrame:
    return ix.spark.createDataFrame([], TRIGGERS)


def _latest(triggers: DataFrame) -> DataFrame:
    return triggers.groupBy("unit_name", "path").agg(F.max("trigger_ns").alias("trigger_ns"))


def _new(found: DataFrame, known: DataFrame | None) -> DataFrame:
    """The latest trigger of each unit and file that isn't known (known: one row each) as late."""
    latest = _latest(found)
    if known is None:
        return latest
    return latest.join(known.withColumnRenamed("trigger_ns", "known").hint("merge"), ["unit_name", "path"], "left").filter("known is null or trigger_ns > known").select("unit_name", "path", "trigger_ns")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """A union of checkpoints. All triggers have a unit; the filter keeps Spark from rewriting constraints that a checkpoint holds on columns of its origin."""
    return a.filter("unit_name is not null").unionByName(b.filter("unit_name is not null"))


def mark(ix: CodeIndex, found: DataFrame, known: DataFrame, synchronous: bool = False) -> tuple[DataFrame, DataFrame]:
    """(told, triggers): what delegates are told of found (unit_name, path, trigger_ns) with all that follows, and the triggers known from now on.

    told: unit_name, main_file, out_file, mod_time_ns, path, trigger_ns, synchronous, of units with a
    main file. One join a level for all triggers together. A level takes out what was known before;
    what the walk itself has seen is only added to, and taken out at levels 1, 2, 4, 8 …, so a walk
    passes over all that it has seen a few times, and cycles still end. No side is broadcast but a
    few rows, counted before.
    """
    monitored = ix.units.filter("not is_system").select("unit_name", "mod_time_ns")
    deps = ix.unit_deps.filter("kind = 'unit'").select(F.col("name").alias("of"), F.col("unit_name").alias("dependent")).distinct()
    known = checkpoint(_latest(known))
    none = not known.limit(1).count()
    frontier = checkpoint(_new(found.join(monitored.hint("merge"), "unit_name", "left_semi"), None if none else known))
    seen, level, edges = frontier, 0, None
    width = int(ix.spark.conf.get("spark.sql.shuffle.partitions"))
    while size := frontier.count():
        if edges is None:
            edges = checkpoint(deps.join(monitored.withColumnRenamed("unit_name", "dependent").hint("merge"), "dependent"))
        few = F.broadcast(frontier) if size <= FEW else frontier.hint("merge")
        step = edges.join(few, F.col("unit_name") == F.col("of")).filter("mod_time_ns < trigger_ns").select(F.col("dependent").alias("unit_name"), "path", "trigger_ns")
        step, level = _new(step, None if none else known), level + 1
        if level & (level - 1) == 0:
            step = _new(checkpoint(step), _latest(seen))
        frontier = checkpoint(step)
        seen = _both(seen, frontier)
        if level % 8 == 0:  # few files, however deep the walk
            seen = checkpoint(_latest(seen).coalesce(width))
    last = _latest(seen)
    told = last.join(ix.units.filter("has_main_file").select("unit_name", "main_file", "out_file", "mod_time_ns").hint("merge"), "unit_name")
    return told.withColumn("synchronous", F.lit(synchronous)), _latest(_both(known, seen))


def _times(ix: CodeIndex, paths: DataFrame, now_ns: int) -> DataFrame:
    """(path, trigger_ns) of paths; a file that isn't there is changed now."""
    return paths.select("path").distinct().join(ix.file_stats.select("path", "mtime_ns"), "path", "left").select("path", F.coalesce("mtime_ns", F.lit(now_ns)).alias("trigger_ns"))


def check_files(ix: CodeIndex, paths: Sequence[str] | DataFrame, now_ns: int, known: DataFrame, synchronous: bool = True) -> tuple[DataFrame, DataFrame]:
    """mark() for the units that hold one of the files and are older than it."""
    # Fixed first: found among the same tables that it is then joined with.
    asked = checkpoint(paths.select("path").distinct()) if isinstance(paths, DataFrame) else ix.spark.createDataFrame([(p,) for p in paths], "path string")
    holding = units_containing_file(ix, None if isinstance(paths, DataFrame) else paths)
    older = holding.join(_times(ix, asked, now_ns), "path").join(ix.units.select("unit_name", "mod_time_ns"), "unit_name").filter("mod_time_ns < trigger_ns")
    return mark(ix, older.select("unit_name", "path", "trigger_ns"), known, synchronous)


def check_directories(ix: CodeIndex, directories: Sequence[str], now_ns: int, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """check_files() for all files right below directories in which something changed."""
    return check_files(ix, files_in_directories(ix, directories), now_ns, known, synchronous=False)


def check_imported(ix: CodeIndex, units: DataFrame, now_ns: int, known: DataFrame, initial: bool = True) -> tuple[DataFrame, DataFrame]:
    """mark() for units (unit_name) just imported: they take over later triggers of the units they depend on (but system ones), and at the first scan their own newest file counts, ties by path."""
    new = ix.units.filter("not is_system").join(units.select("unit_name").distinct(), "unit_name", "left_semi").select("unit_name", "mod_time_ns")
    deps = ix.unit_deps.filter("not is_system").join(new, "unit_name")
    taken = deps.filter("kind = 'unit'").select("unit_name", "mod_time_ns", F.col("name").alias("of")).join(known.withColumnRenamed("unit_name", "of"), "of").filter("trigger_ns > mod_time_ns").select("unit_name", "path", "trigger_ns")
    if initial:
        files = deps.filter(F.col("kind").isin("record", "file") & (F.col("path") != "")).select("unit_name", "mod_time_ns", "path").distinct()
        newest = files.join(_times(ix, files, now_ns), "path").groupBy("unit_name", "mod_time_ns").agg(F.min_by(F.struct("path", "trigger_ns"), F.struct(-F.col("trigger_ns"), F.col("path"))).alias("t"))
        taken = taken.unionByName(newest.filter("t.trigger_ns > mod_time_ns").select("unit_name", "t.path", "t.trigger_ns"))
    return mark(ix, taken, known)
