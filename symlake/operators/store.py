"""The raw store: its tables as they land, and scans of units and records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.functions.exprs import map_prefixes
from symlake.model import SCHEMAS
from symlake.plans.index import CodeIndex

#: The format of the tables, major and minor in one number.
VERSION = 10002


class StoreError(Exception):
    """What the store can't give; without a reason, an unknown error."""

    def __init__(self, reason: str | None = None):
        super().__init__(reason or "Unknown error")


def version(encoded: int = VERSION) -> tuple[int, int]:
    return encoded // 10000, encoded % 10000


def map_paths(ix: CodeIndex, mappings: Sequence[tuple[str, str]]) -> CodeIndex:
    """The index with path prefixes (original, replacement) replaced, the first that fits; a path that is all prefix too."""
    if not mappings:
        return ix

    def mapped(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumns({c: map_prefixes(c, list(mappings)) for c in columns})

    return replace(
        ix, units=mapped(ix.units, "out_file", "main_file", "sysroot", "work_dir"), unit_deps=mapped(ix.unit_deps, "path"), unit_includes=mapped(ix.unit_includes, "source_path", "target_path"),
        file_stats=None if ix.file_stats is None else mapped(ix.file_stats, "path"),
    )


def open_store(spark: SparkSession, path: str, mappings: Sequence[tuple[str, str]] = ()) -> CodeIndex:
    """The landing tables below path (a folder of Parquet files each), with path prefixes mapped. A store that isn't there is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise StoreError(f"index store path does not exist: {path}")
    frames = {t: spark.read.schema(s).parquet(f"{path.rstrip('/')}/{t}") if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, t)) else spark.createDataFrame([], s) for t, s in SCHEMAS.items()}
    return map_paths(CodeIndex(**frames), mappings)


def unit_names(ix: CodeIndex, in_order: bool = False) -> DataFrame:
    names = ix.units.select("unit_name")
    return names.orderBy("unit_name") if in_order else names


def unit_name_from_output(ix: CodeIndex, outputs: Sequence[str]) -> DataFrame:
    """(out_file, unit_name), null where no unit has the output."""
    asked = ix.spark.createDataFrame([(o,) for o in outputs], "out_file string")
    return asked.join(ix.units.select("out_file", "unit_name"), "out_file", "left")


def unit_time(ix: CodeIndex, units: Sequence[str]) -> DataFrame:
    """(unit_name, mod_time_ns) in this store, whatever a database has imported of it."""
    return ix.units.filter(F.col("unit_name").isin(list(units))).select("unit_name", "mod_time_ns")


def dependencies(ix: CodeIndex, unit: str) -> DataFrame:
    return ix.unit_deps.filter(F.col("unit_name") == unit).orderBy("ord")


def record(ix: CodeIndex, name: str) -> CodeIndex:
    """The index of one record; a missing record is an error."""
    symbols = ix.record_symbols.filter(F.col("record_name") == name)
    if not symbols.limit(1).count():
        raise StoreError(f"there is no record {name}")
    return replace(ix, record_symbols=symbols, occurrences=ix.occurrences.filter(F.col("record_name") == name))


def symbols_of_record(ix: CodeIndex, records: Sequence[str], matching: Column | None = None, most: int | None = None) -> DataFrame:
    """The symbols of records, those for which a condition holds if one is given, and no more than asked for."""
    found = ix.record_symbols.filter(F.col("record_name").isin(list(records)))
    found = found if matching is None else found.filter(matching)
    return found if most is None else found.limit(most)


def occurrences_of_record(ix: CodeIndex, records: Sequence[str], lines: tuple[int, int] | None = None, symbols: Sequence[str] = (), related: Sequence[str] = ()) -> DataFrame:
    """The occurrences of records: in lines first..last (from 1, both included), of symbols, with a relation to one of related; an empty list filters nothing, with both either is enough."""
    found = ix.occurrences.filter(F.col("record_name").isin(list(records)))
    if lines is not None:
        found = found.filter(F.col("line").between(*lines))
    of = F.col("usr").isin(list(symbols)) if symbols else None
    to = F.exists("relations", lambda r: r["usr"].isin(list(related))) if related else None
    wanted = of if to is None else to if of is None else of | to
    return found if wanted is None else found.filter(wanted)
