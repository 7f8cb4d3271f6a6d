"""Texts of units, records and index rows."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.exprs import kind_text, property_components, property_text, role_text
from symlake.plans.index import CodeIndex


def unit(ix: CodeIndex, name: str) -> DataFrame:
    """The one row of a unit; missing units are an error."""
    found = ix.units.filter(F.col("unit_name") == name)
    if not found.limit(1).count():
        raise LookupError(f"there is no unit {name}")
    return found


def dependency_text(kind: Column, is_system: Column, module: Column, path: Column, name: Column) -> Column:
    full = lambda c: F.when(c != "", c)
    return F.concat_ws(" | ", F.initcap(kind), F.when(is_system, F.lit("system")).otherwise(F.lit("user")), full(module), full(path), full(name))


def describe_unit(ix: CodeIndex, name: str) -> str:
    """One unit's text: bounded by the unit, so it is put together on the driver."""
    u = unit(ix, name).first()
    deps = ix.unit_deps.filter(F.col("unit_name") == name).orderBy("ord").select(dependency_text(*(F.col(c) for c in ("kind", "is_system", "module_name", "path", "name"))).alias("t")).collect()
    includes = ix.unit_includes.filter(F.col("unit_name") == name).orderBy("ord").select(F.format_string("%s:%d | %s", "source_path", "line", "target_path").alias("t")).collect()
    flag = lambda b: "true" if b else "false"
    heads = {
        "Module": u["module_name"], "Has Main File": flag(u["has_main_file"]), "Main File": u["main_file"] or "", "Output File": u["out_file"], "Target": u["target"], "Sysroot": u["sysroot"] or "",
        "Working Directory": u["work_dir"], "Is System": flag(u["is_system"]), "Is Module": flag(u["is_module"]), "Is Debug": flag(u["is_debug"]), "Provider Identifier": u["provider_kind"],
        "Provider Version": u["provider_version"], "Modification Date": f"{datetime.fromtimestamp(u['mod_time_ns'] // 10**9, UTC):%Y-%m-%d %H:%M:%S +0000}",
    }
    lines = [f"{k}: {v}" for k, v in heads.items()] + ["Dependencies:", *(d["t"] for d in deps)]
    return "\n".join(lines + (["Includes:", *(i["t"] for i in includes)] if includes else []))


def symbol_text(df: DataFrame) -> Column:
    """name | kind.subkind(properties) | usr | roles, from the columns of df."""
    parts = F.array_join(property_components("properties"), ", ")
    kind = F.concat("kind", F.when(F.col("sub_kind") != "none", F.concat(F.lit("."), F.col("sub_kind"))).otherwise(F.lit("")), F.when(parts != "", F.concat(F.lit("("), parts, F.lit(")"))).otherwise(F.lit("")))
    return F.concat_ws(" | ", "name", kind, "usr", role_text("roles", "raw"))


def describe_record(ix: CodeIndex, name: str) -> str:
    symbols = ix.record_symbols.filter(F.col("record_name") == name)
    rows = symbols.select(symbol_text(symbols).alias("t")).collect()
    if not rows:
        raise LookupError(f"there is no record {name}")
    info = symbols.select("usr", "name", "kind", "sub_kind", "properties")
    relations = F.transform("relations", lambda r: F.concat(F.lit("\n  "), role_text(r["roles"], "raw"), F.lit(" | "), r["usr"]))
    found = ix.occurrences.filter(F.col("record_name") == name).join(info, "usr")
    text = F.concat("line", F.lit(":"), "col", F.lit(" | "), symbol_text(found), F.array_join(relations, ""))
    occurrences = [r["t"] for r in found.orderBy("ord").select(text.alias("t")).collect()]
    return "\n".join(["Symbols:", *(r["t"] for r in rows), "", "Occurrences:", *occurrences])


def describe(ix: CodeIndex, name: str) -> str:
    """A unit of that name, else a record."""
    try:
        return describe_unit(ix, name)
    except LookupError:
        return describe_record(ix, name)


def stats(ix: CodeIndex) -> DataFrame:
    """(table, n): rows of each table."""
    out = None
    for table in ("units", "unit_deps", "unit_includes", "record_symbols", "occurrences"):
        row = getattr(ix, table).agg(F.lit(table).alias("table"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def file_associations(ix: CodeIndex) -> DataFrame:
    return ix.file_refs(ix.units).select("record_name", "path", "unit_name", "mod_time_ns").orderBy("record_name", "path")


def file_association_lines(ix: CodeIndex) -> DataFrame:
    """(record_name, path, line): each file of a record in words; a reader prints the record's name above them."""
    flag = F.col("is_system").cast("int").cast("string")
    line = F.concat(F.lit("---- "), "path", F.lit(", "), "unit_name", F.lit(", module: "), "module_name", F.lit(", sys: "), flag, F.lit(", "), F.floor(F.col("mod_time_ns") / 1_000_000_000).cast("string"))
    return ix.file_refs(ix.units).select("record_name", "path", line.alias("line")).orderBy("record_name", "path")


def units_by_file(ix: CodeIndex) -> DataFrame:
    """(path, unit_name, line): every file with every unit that holds it."""
    held = ix.unit_deps.filter(F.col("kind").isin("record", "file") & (F.col("path") != "")).select("path", "unit_name").distinct()
    return held.withColumn("line", F.concat_ws(" -> ", "path", "unit_name")).orderBy("path", "unit_name")


def unit_info(ix: CodeIndex, names: list[str]) -> DataFrame:
    """(asked, unit_name, mod_time_ns, out_file, main_file, valid) for each name; a unit that isn't there has the empty name and isn't valid."""
    asked = ix.spark.createDataFrame([(n,) for n in names], "asked string").distinct()
    there = ix.units.select("unit_name", "mod_time_ns", "out_file", "main_file")
    return asked.join(there, F.col("asked") == F.col("unit_name"), "left").select("asked", F.coalesce("unit_name", F.lit("")).alias("unit_name"), "mod_time_ns", "out_file", "main_file", F.col("unit_name").isNotNull().alias("valid"))


def symbol_value(properties: Column | str = "properties") -> Column:
    """A symbol with its language in words, properties only where there are some."""
    p = F.col(properties) if isinstance(properties, str) else properties
    return F.concat_ws(" | ", "name", F.when(p == 0, F.col("kind")).otherwise(F.concat("kind", F.lit(" ("), property_text(p), F.lit(")"))), "usr", "language")


def location_value() -> Column:
    """module::path:line:col, with a mark on system files."""
    module = F.when(F.col("module_name") != "", F.concat("module_name", F.lit("::"))).otherwise(F.lit(""))
    return F.concat(module, F.col("path"), F.lit(":"), F.col("line"), F.lit(":"), F.col("col"), F.when(F.col("is_system"), F.lit(" [system]")).otherwise(F.lit("")))


def occurrence_texts(ix: CodeIndex, located: DataFrame) -> DataFrame:
    """located occurrences with text (location | symbol | roles, a line for each relation) and short (the terse form without relations)."""
    info = ix.record_symbols.select("record_name", "usr", "name", "kind", "properties", "language").distinct()
    relations = F.array_join(F.transform("relations", lambda r: F.concat(F.lit("\n\t"), role_text(r["roles"]), F.lit(" | "), r["usr"])), "")
    found = located.join(info, ["record_name", "usr"])
    short = F.concat_ws(" | ", F.concat_ws(":", "path", "line", "col"), "name", kind_text("kind"), "usr", role_text("roles", "short"))
    return found.withColumn("text", F.concat(F.concat_ws(" | ", location_value(), symbol_value(), role_text("roles")), relations)).withColumn("short", short)
