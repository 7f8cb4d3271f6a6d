"""Queries over symbols and their occurrences. Each takes one or many keys at once; results are bags, unordered unless said."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from symlake.functions.exprs import any_of, is_callable, matches
from symlake.model import BASE_OF, CALL, CANONICAL, CHILD_OF, DECL, DEF, DYNAMIC, EXTENDED_BY, OVERRIDE_OF, RECEIVED_BY, UNIT_TEST
from symlake.plans.index import CodeIndex, checkpoint, closure

Keys = str | Sequence[str] | DataFrame


def keyed(df: DataFrame, column: str, keys: Keys) -> DataFrame:
    """df where column is among keys: pushed-down literals, or a semi-join with a frame of that column."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin([keys] if isinstance(keys, str) else list(keys)))


def located(ix: CodeIndex, occurrences: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Occurrences once for each visible file of their record."""
    return occurrences.join(ix.file_refs() if refs is None else refs, "record_name")


def occurrences_of(ix: CodeIndex, usrs: Keys, roles: int) -> DataFrame:
    found = keyed(ix.occurrences, "usr", usrs).filter(any_of("roles", roles))
    return located(ix, found) if isinstance(usrs, DataFrame) else _looked_up(ix, found)


def _looked_up(ix: CodeIndex, found: DataFrame) -> DataFrame:
    """located() for a lookup of a few keys: what is found is fixed first, so that only its records' files are put together."""
    found = checkpoint(found)
    return located(ix, found, ix.file_refs(records=found))


def occurrences_related_to(ix: CodeIndex, usrs: Sequence[str], roles: int, strict: bool = False) -> DataFrame:
    """Occurrences with a relation to one of usrs. The roles are looked for on the occurrence; strict: on that relation."""
    wanted = list(usrs)

    def relates(r):
        return r["usr"].isin(wanted) & any_of(r["roles"], roles) if strict else r["usr"].isin(wanted)

    related = ix.occurrences.filter(F.exists("relations", relates))
    # Records in which no relation to the symbol has the roles are passed over as a whole.
    records = related.filter(F.exists("relations", lambda r: r["usr"].isin(wanted) & any_of(r["roles"], roles))).select("record_name").distinct()
    return _looked_up(ix, related.filter(any_of("roles", roles)).join(records, "record_name", "left_semi"))


def canonical(ix: CodeIndex, usrs: DataFrame | None = None, before_visibility: bool = False, workspace_only: bool = False) -> DataFrame:
    """Canonical occurrences of each symbol if a visible record has them, else its declarations and definitions-to-be.

    before_visibility: a canonical record counts even if it isn't visible.
    """
    candidates, refs = canonical_candidates(ix, usrs, before_visibility, workspace_only), ix.file_refs()
    found = ix.occurrences.join(candidates, ["record_name", "usr"])
    found = found.filter(F.when(F.col("is_canonical"), F.col("roles").bitwiseAND(F.lit(CANONICAL)) != 0).otherwise(any_of("roles", DECL | CANONICAL)))
    return located(ix, found.drop("is_canonical"), refs)


def canonical_candidates(ix: CodeIndex, usrs: DataFrame | None = None, before_visibility: bool = False, workspace_only: bool = False) -> DataFrame:
    """(record_name, usr, is_canonical): the visible records to take each symbol from."""
    refs = ix.file_refs().groupBy("record_name").agg(F.min_by("is_system", "path").alias("system"))
    rows = ix.record_symbols.filter(any_of("roles", DECL | CANONICAL)).select("record_name", "usr", (F.col("roles").bitwiseAND(F.lit(CANONICAL)) != 0).alias("is_canonical"))
    if usrs is not None:
        rows = keyed(rows, "usr", usrs)
    seen = rows.join(refs, "record_name")
    # An aggregate and a join, not a window: a symbol in very many records is no single sorted group.
    best = (rows if before_visibility else seen).groupBy("usr").agg(F.max("is_canonical").alias("best"))
    if workspace_only:
        seen = seen.filter("not system")
    return seen.join(best, "usr").filter("is_canonical = best").select("record_name", "usr", "is_canonical")


def canonical_by_name(ix: CodeIndex, name: Keys) -> DataFrame:
    return canonical(ix, keyed(ix.symbol_names(), "name", name))


def canonical_matching(ix: CodeIndex, pattern: str, **how: bool) -> DataFrame:
    """how: anchor_start, anchor_end, subsequence, ignore_case. The pattern is held against distinct names."""
    names = ix.symbol_names()
    return canonical(ix, keyed(names, "name", names.select("name").distinct().filter(matches("name", pattern, **how))))


def canonical_by_usr(ix: CodeIndex, usr: Sequence[str]) -> DataFrame:
    return canonical(ix, ix.record_symbols.filter(F.col("usr").isin(list(usr))).select("usr").distinct(), before_visibility=True)


def canonical_by_kind(ix: CodeIndex, kind: str, workspace_only: bool = False) -> DataFrame:
    return canonical(ix, ix.symbol_kinds().filter(F.col("bucket") == kind), workspace_only=workspace_only)


def count_by_kind(ix: CodeIndex, kinds: Sequence[str] | None = None, workspace_only: bool = False, distinct_usrs: bool = False) -> DataFrame:
    """(bucket, n): pairs of symbol and record, or symbols."""
    buckets = ix.symbol_kinds() if kinds is None else ix.symbol_kinds().filter(F.col("bucket").isin(list(kinds)))
    pairs = buckets.join(canonical_candidates(ix, buckets, workspace_only=workspace_only), "usr")
    return pairs.groupBy("bucket").agg((F.countDistinct("usr") if distinct_usrs else F.count("*")).alias("n"))


def _record_of_file(ix: CodeIndex, paths: Sequence[str]) -> DataFrame:
    """(file, record_name): the first visible record of each file, by unit and its order of dependencies."""
    refs = ix.file_refs().select("record_name").distinct()
    deps = ix.unit_deps.filter((F.col("kind") == "record") & F.col("path").isin(list(paths))).withColumnRenamed("name", "record_name")
    return deps.join(refs, "record_name", "left_semi").groupBy(F.col("path").alias("file")).agg(F.min_by("record_name", F.struct("unit_name", "ord")).alias("record_name"))


def symbols_in_file(ix: CodeIndex, paths: Sequence[str]) -> DataFrame:
    return _record_of_file(ix, paths).join(ix.record_symbols.filter(any_of("roles", DECL | DEF)), "record_name")


def occurrences_in_file(ix: CodeIndex, paths: Sequence[str]) -> DataFrame:
    """All occurrences of the chosen record, at all visible files of it: path may differ from file."""
    return located(ix, _record_of_file(ix, paths).join(ix.occurrences, "record_name"))


def symbol_names(ix: CodeIndex, live_only: bool = False) -> DataFrame:
    """Distinct names in order; those of removed units stay unless live_only."""
    names = ix.symbol_names()
    if live_only:
        names = names.join(ix.record_symbols.join(ix.file_refs(ix.units).select("record_name").distinct(), "record_name", "left_semi").select("usr").distinct(), "usr", "left_semi")
    return names.select("name").distinct().orderBy("name")


def unit_tests(ix: CodeIndex, main_files: Sequence[str] | None = None, out_files: Sequence[str] | None = None) -> DataFrame:
    """Every occurrence of unit-test symbols in records that define one; visibility plays no part."""
    units = ix.units
    if main_files is not None:
        units = units.filter(F.col("main_file").isin(list(main_files)))
    if out_files is not None:
        units = units.filter(F.col("out_file").isin(list(out_files)))
    tests = ix.record_symbols.filter(any_of("properties", UNIT_TEST))
    records = tests.filter(any_of("roles", DEF)).select("record_name").distinct()
    found = ix.occurrences.join(tests.select("record_name", "usr").distinct(), ["record_name", "usr"], "left_semi").join(records, "record_name", "left_semi")
    return located(ix, found, ix.file_refs(units))


def _visible_records(ix: CodeIndex) -> DataFrame:
    """(record_name), not distinct: those that a visible unit has; a semi-join with them needs no files."""
    return ix.unit_deps.filter("kind = 'record'").join(ix.visible_units().select("unit_name"), "unit_name", "left_semi").select(F.col("name").alias("record_name"))


def _edges(ix: CodeIndex, roles: int) -> DataFrame:
    """(usr, related, …) of relations that hold one of roles, in visible records."""
    found = ix.occurrences.filter(F.exists("relations", lambda r: any_of(r["roles"], roles))).select("record_name", "usr", F.explode("relations").alias("r")).filter(any_of("r.roles", roles))
    return found.select("record_name", "usr", F.col("r.usr").alias("related")).join(_visible_records(ix), "record_name", "left_semi").select("usr", "related").distinct()


def related_edges(ix: CodeIndex, roles: int) -> DataFrame:
    """(src, dst): dst has visible occurrences with one of roles that relate to src."""
    found = ix.occurrences.filter(any_of("roles", roles)).select("record_name", F.explode("relations.usr").alias("src"), F.col("usr").alias("dst"))
    return found.join(_visible_records(ix), "record_name", "left_semi").select("src", "dst").distinct()


def related_closure(ix: CodeIndex, usrs: Sequence[str], roles: int, edges: DataFrame | None = None) -> DataFrame:
    """(seed, usr): symbols whose occurrences relate to the seed through roles, step by step; the seed isn't listed. edges: related_edges(), if they are there."""
    seeds = ix.spark.createDataFrame([(u, u) for u in usrs], "seed string, node string")
    return closure(seeds, checkpoint(related_edges(ix, roles)) if edges is None else edges).filter("seed <> node").select("seed", F.col("node").alias("usr"))


def base_edges(ix: CodeIndex) -> DataFrame:
    """(src, dst): what instance methods override, and what other symbols have as bases."""
    # One pass for both: relations are chosen and made distinct before their records are looked for.
    r = F.explode("relations").alias("r")
    found = ix.occurrences.filter(F.exists("relations", lambda r: any_of(r["roles"], OVERRIDE_OF | BASE_OF))).select("record_name", "usr", r).filter(any_of("r.roles", OVERRIDE_OF | BASE_OF))
    seen = found.join(_visible_records(ix), "record_name", "left_semi")
    up, base = F.struct(F.col("usr").alias("src"), F.col("r.usr").alias("dst"), F.lit(1).alias("m")), F.struct(F.col("r.usr").alias("src"), F.col("usr").alias("dst"), F.lit(0).alias("m"))
    # Methods go by what they override, others by their bases.
    edges = seen.select(F.explode(F.array_compact(F.array(F.when(any_of("r.roles", OVERRIDE_OF), up), F.when(any_of("r.roles", BASE_OF), base)))).alias("e")).select("e.*").distinct()
    kinds = ix.record_symbols.groupBy("usr").agg(F.max((F.col("kind") == "instanceMethod").cast("int")).alias("method"))
    return edges.join(kinds.withColumnRenamed("usr", "src"), "src", "left").filter(F.coalesce("method", F.lit(0)) == F.col("m")).select("src", "dst")


def base_hierarchy(ix: CodeIndex, usrs: Sequence[str], edges: DataFrame | None = None) -> DataFrame:
    """(seed, usr): base_edges() (given, if they are there) followed transitively; the seed isn't listed."""
    seeds = ix.spark.createDataFrame([(u, u) for u in usrs], "seed string, node string")
    return closure(seeds, checkpoint(base_edges(ix)) if edges is None else edges).filter("seed <> node").select("seed", F.col("node").alias("usr"))


def with_fields(found: DataFrame, **fields: object) -> DataFrame:
    """Symbols (or occurrences) as they are but for the fields given: columns, or values for all."""
    unknown = set(fields) - set(found.columns)
    if unknown:
        raise ValueError(f"there is no field {sorted(unknown)[0]}")
    return found.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()})


def at_location(found: DataFrame, path: Column | str, line: Column | int, col: Column | int, roles: Column | int) -> DataFrame:
    """An occurrence of each symbol at a place."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.array().cast("array<struct<usr: string, roles: bigint>>")
    return found.withColumns({"path": lit(path), "line": lit(line), "col": lit(col), "roles": lit(roles).cast("long"), "relations": none})


def each(found: DataFrame, receiver: Callable[[Row], bool]) -> bool:
    """Hands rows to receiver, partition by partition, until it returns False; whether it never did."""
    return all(receiver(row) is not False for row in found.toLocalIterator())


def _classes(first: Row) -> list[str]:
    """The receiver classes of a dynamic occurrence: a handful."""
    wanted = RECEIVED_BY if first["roles"] & CALL else CHILD_OF
    return sorted(r["usr"] for r in first["relations"] if r["roles"] & wanted) if first["roles"] & DYNAMIC else []


def _kinds_of(ix: CodeIndex, usrs: Sequence[str]) -> dict[str, Row]:
    """kind and callable of symbols that some record has."""
    if not usrs:
        return {}
    found = ix.record_symbols.filter(F.col("usr").isin(list(usrs))).groupBy("usr").agg(F.min("kind").alias("kind"), F.max(is_callable("kind")).alias("callable"))
    return {r["usr"]: r for r in found.collect()}


def calls_of(ix: CodeIndex, callees: Sequence[str]) -> DataFrame:
    """call_occurrences() of several symbols, with a column callee. Each is a plan of its own, for a handful; their own occurrences, the kinds of them and their receivers and the edges that they follow are made once."""
    callees = list(dict.fromkeys(callees))
    if not callees:
        raise ValueError("no callee is given")
    bases, overrides = checkpoint(base_edges(ix)), checkpoint(related_edges(ix, OVERRIDE_OF))
    own = checkpoint(ix.occurrences.filter(F.col("usr").isin(callees)))
    firsts = own.groupBy("usr").agg(F.min_by(F.struct("roles", "relations"), F.struct("record_name", "ord")).alias("f")).select("f.*").collect()
    kinds = _kinds_of(ix, sorted({*callees, *(c for f in firsts for c in _classes(f))}))
    out = None
    for c in callees:
        found = call_occurrences(ix, c, bases=bases, overrides=overrides, own=own, kinds=kinds).withColumn("callee", F.lit(c))
        out = found if out is None else out.unionByName(found)
    return out


def call_occurrences(ix: CodeIndex, callee: str, record_name: str | None = None, bases: DataFrame | None = None, overrides: DataFrame | None = None, own: DataFrame | None = None, kinds: dict[str, Row] | None = None) -> DataFrame:
    """Calls of a callable symbol, with those that dispatch to it dynamically.

    The callee is the symbol at its first occurrence (in record_name, if given). Protocol methods are
    called through all that override them; other methods through their base methods, on receivers
    that are classes of the callee, or on receivers that aren't known. own (occurrences of the callee
    at least) and kinds (of the callee and its receivers) are looked up if they aren't given.
    """
    own = (ix.occurrences if own is None else own).filter(F.col("usr") == callee)
    at = own if record_name is None else own.filter(F.col("record_name") == record_name)
    first = at.orderBy("record_name", "ord").limit(1).collect()
    direct = _looked_up(ix, own.filter(any_of("roles", CALL)))
    classes = _classes(first[0]) if first else []
    kinds = _kinds_of(ix, [callee, *classes]) if kinds is None else dict(kinds)
    if callee not in kinds or not kinds[callee]["callable"] or not first:
        return direct.limit(0)
    for i, usr in enumerate(classes):
        if usr in kinds and kinds[usr]["kind"] == "extension":
            extended = occurrences_related_to(ix, [usr], EXTENDED_BY).select(F.min("usr")).first()[0]
            classes[i] = extended or usr
    if not classes:
        return direct
    if classes[0] not in kinds:
        kinds |= _kinds_of(ix, classes[:1])
    if classes[0] in kinds and kinds[classes[0]]["kind"] == "protocol":
        overriding = related_closure(ix, [callee], OVERRIDE_OF, overrides).select("usr")
        return direct.unionByName(_looked_up(ix, keyed(ix.occurrences, "usr", overriding).filter(any_of("roles", CALL))))
    known = base_hierarchy(ix, classes, bases).select("usr").unionByName(ix.spark.createDataFrame([(c,) for c in classes], "usr string")).distinct()
    based = base_hierarchy(ix, [callee], bases).select("usr")
    calls = _looked_up(ix, keyed(ix.occurrences, "usr", based).filter(any_of("roles", CALL) & any_of("roles", DYNAMIC)))
    calls = checkpoint(calls.withColumn("row", F.monotonically_increasing_id()))
    to = calls.select("row", F.explode(F.filter("relations", lambda r: any_of(r["roles"], RECEIVED_BY))).alias("r")).select("row", F.col("r.usr").alias("usr")).join(known, "usr", "left_semi").select("row").distinct()
    unknown = calls.filter(~any_of("roles", RECEIVED_BY))
    return direct.unionByName(unknown.unionByName(calls.filter(any_of("roles", RECEIVED_BY)).join(to, "row", "left_semi")).drop("row"))
