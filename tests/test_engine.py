"""The engine against its SQL, and against hand-written index tables."""

from dataclasses import replace

import compare
import markers
import pytest
from pyspark.sql import functions as F

from symlake import catalog
from symlake.functions import exprs
from symlake.model import ALL_ROLES, CALLED_BY, CANONICAL, DEF, REF, SCHEMAS
from symlake.operators import dump, files, store, symbols
from symlake.plans import index
from symlake.plans.index import CodeIndex, closure
from symlake.sources.projection import load
from symlake.streaming import ingest, monitor

SF = "/root/testdata/sf0.001"
SOME = ["d1_file_refs", "f1_main_files", "o1_out_of_date", "s1_delegate_events", "c5_occurrence_text", "d10_unit_info", "h8_codes"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    assert compare.differ(catalog.queries()[name](spark, SF), compare.connect(SF), catalog.oracle_sql()[name]) == ""


def project(spark) -> CodeIndex:
    """Three files that call each other: a() calls b() and c(), b() calls a()."""
    call, by = 73764, 73728
    units = [(f"{x}-1", i + 1, f"/build/{x}.o", f"/src/{x}.swift", True, "", "arm64", "main", "/src", False, False, True, "swift", "5") for i, x in enumerate("abc")]
    deps = [(f"{x}-1", 0, "record", f"{x}-rec", f"/src/{x}.swift", "main", False) for x in "abc"]
    u = {x: f"s:4main1{x}yyF" for x in "abc"}
    occ = [("a-rec", 0, 1, 15, u["a"], DEF | CANONICAL, []), ("a-rec", 1, 2, 13, u["b"], call, [(u["a"], by)]), ("a-rec", 2, 3, 13, u["c"], call, [(u["a"], by)]), ("b-rec", 0, 1, 15, u["b"], DEF | CANONICAL, []), ("b-rec", 1, 2, 13, u["a"], call, [(u["b"], by)]), ("c-rec", 0, 1, 11, u["c"], DEF | CANONICAL, [])]
    o = spark.createDataFrame(occ, SCHEMAS["occurrences"])
    info = spark.createDataFrame([(u[x], f"{x}()", "function", "none", 393216, "swift", "") for x in "abc"], "usr string, name string, kind string, sub_kind string, properties long, language string, codegen_name string")
    return CodeIndex(spark.createDataFrame(units, SCHEMAS["units"]), spark.createDataFrame(deps, SCHEMAS["unit_deps"]), spark.createDataFrame([("a-1", 0, "/src/a.swift", 1, "/src/x.h")], SCHEMAS["unit_includes"]), ingest.record_symbols(o, info).select(*SCHEMAS["record_symbols"].names), o)


def at(df):
    return sorted((r["path"][5:-6], r["line"], r["col"]) for r in df.collect())


def test_small_project(spark):
    ix = project(spark)
    c, a = "s:4main1cyyF", "s:4main1ayyF"
    assert at(symbols.occurrences_of(ix, c, REF | DEF)) == [("a", 3, 13), ("c", 1, 11)]
    assert at(symbols.occurrences_related_to(ix, [a], CALLED_BY)) == [("a", 2, 13), ("a", 3, 13)]
    assert at(symbols.canonical_by_name(ix, "c()")) == [("c", 1, 11)] and at(symbols.canonical_by_name(ix, "c")) == []
    for how, n in (({"anchor_start": True}, 1), ({"anchor_start": True, "anchor_end": True}, 0)):
        assert len(at(symbols.canonical_matching(ix, "c", **how))) == n
    assert len(at(symbols.canonical_matching(ix, "C", anchor_start=True, ignore_case=True))) == 1
    assert at(symbols.canonical_matching(ix, "C", anchor_start=True)) == []
    assert [r["name"] for r in symbols.symbol_names(ix).collect()] == ["a()", "b()", "c()"]
    assert at(symbols.call_occurrences(ix, c)) == [("a", 3, 13)]
    hidden = ix.show_outputs([])
    assert at(symbols.occurrences_of(hidden, c, ALL_ROLES)) == []
    assert at(symbols.occurrences_of(ix.show_outputs(["/build/c.o"]), c, ALL_ROLES)) == [("c", 1, 11)]
    assert [tuple(r) for r in files.known_files(ix, ["/src/a.swift", "/x"]).orderBy("path").collect()] == [("/src/a.swift", True), ("/x", False)]
    with pytest.raises(ValueError):
        symbols.occurrences_of(ix, c, 0)


def test_dump(spark):
    ix = project(spark)
    text = dump.describe(ix, "a-1")
    assert text.startswith("Module: main\nHas Main File: true\nMain File: /src/a.swift\n") and "Record | user | main | /src/a.swift | a-rec" in text and text.endswith("Includes:\n/src/a.swift:1 | /src/x.h")
    assert "2:13 | b() | function(internal) | s:4main1byyF | reference, call, calledBy, containedBy\n  calledBy, containedBy | s:4main1ayyF" in dump.describe(ix, "a-rec")
    with pytest.raises(LookupError):
        dump.describe(ix, "none")


def test_scalar_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first()["x"]

    m = lambda x, p, **k: value(exprs.matches(F.lit(x), p, **k))
    assert m("abcb", "ab", subsequence=True) and not m("abcb", "ab", subsequence=True, anchor_end=True)
    assert m("", "", anchor_end=True) and not m("", "x", subsequence=True) and not m("x", "", subsequence=True)
    assert m("a.b", "a.b", subsequence=True, anchor_start=True, anchor_end=True) and not m("É", "é", ignore_case=True)
    assert value(exprs.role_text(F.lit(DEF | CANONICAL))) == "[def|canon]"
    assert value(exprs.role_text(F.lit(DEF | 1 << 20))) == "[def|<<unknown roles 1048576>]" and value(exprs.role_text(F.lit(0))) == "[]"
    assert value(exprs.role_text(F.lit(256 | 512 | 1 << 19), "raw")) == "implicit, undefinition, childOf" and value(exprs.role_text(F.lit(DEF | CANONICAL), "short")) == "Def"
    assert value(exprs.property_text(F.lit(65536 | 393216))) == "[swift_async|internal]" and value(exprs.property_text(F.lit(0))) == "[]"
    assert value(exprs.property_text(F.lit(1 | 7 << 17 | 1 << 30))) == "[gen|<<unknown properties 917504>>|<<unknown properties 1073741824>>]"
    assert [value(exprs.kind_text(F.lit(k))) for k in ("instanceMethod", "enumConstant", "conversionFunction", "namespaceAlias", "typealias")] == ["instance-method", "enumerator", "conversion-func", "namespace-alias", "typealias"]
    assert value(exprs.decoded(F.unhex(F.lit("61FF62")))) == "a\ufffdb" and store.version() == (1, 2) and store.version(50012) == (5, 12)
    assert value(exprs.properties_contain(F.lit(393216 | 8), 8)) and not value(exprs.properties_contain(F.lit(393216), 3 << 18))
    assert value(exprs.property_components(F.lit(8 | 65536 | 393216))) == ["unitTest", "swiftAsync", "internal"]
    assert value(exprs.parent_dir(F.lit("/a/b.c"))) == "/a" and value(exprs.base_name(F.lit("/a/b.c"))) == "b.c"
    assert value(exprs.map_prefixes(F.lit("/SRC/a.c"), [("/SRC", "/home/x")])) == "/home/x/a.c" and value(exprs.contains_path(F.lit("/a"), F.lit("/ab"))) is False


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1), (9, 9)], "seed long, node long")
    assert sorted(map(tuple, closure(seeds, edges).collect())) == [(1, 1), (1, 2), (1, 3), (9, 9)]


def test_root_units_of_all_units(spark):
    ix = load(spark, SF)
    main = {r["unit_name"]: r["has_main_file"] for r in ix.units.collect()}
    up = {}
    for r in ix.unit_deps.filter("kind = 'unit'").collect():
        up.setdefault(r["name"], set()).add(r["unit_name"])
    want = set()
    for u in main:
        todo, seen = [u], {u}
        while todo:
            x = todo.pop()
            if main.get(x):
                want.add((u, x))
                continue
            new = up.get(x, set()) - seen
            seen |= new
            todo += new
    assert {tuple(r) for r in catalog.queries()["r1_root_units"](spark, SF).select("unit_name", "root").collect()} == want and {u for u, _ in want} > {u for u in main if main[u]}


def test_texts(spark):
    ix = project(spark)
    found = symbols.occurrences_of(ix, "s:4main1cyyF", REF | DEF).orderBy("path")
    texts = [(r["text"], r["short"]) for r in dump.occurrence_texts(ix, found).orderBy("path").collect()]
    assert texts[0] == ("main::/src/a.swift:3:13 | c() | function ([internal]) | s:4main1cyyF | swift | [ref|call|calledBy|contBy]\n\t[calledBy|contBy] | s:4main1ayyF", "/src/a.swift:3:13 | c() | function | s:4main1cyyF | Ref,Call,RelCall,RelCont")
    assert "Modification Date: 1970-01-01 00:00:00 +0000\n" in dump.describe_unit(ix, "a-1")
    assert dump.file_association_lines(ix).first()["line"] == "---- /src/a.swift, a-1, module: main, sys: 0, 0"
    assert [r["line"] for r in dump.units_by_file(ix).collect()] == [f"/src/{x}.swift -> {x}-1" for x in "abc"]
    assert [tuple(r)[1::4] for r in dump.unit_info(ix, ["a-1", "x"]).orderBy("asked").collect()] == [("a-1", True), ("", False)]
    seen = []
    assert symbols.each(found, lambda r: seen.append(r["path"])) and not symbols.each(found, lambda r: False) and seen == ["/src/a.swift", "/src/c.swift"]
    with pytest.raises(store.StoreError, match="there is no record"):
        store.record(ix, "none")
    assert str(store.StoreError(None)) == "Unknown error"
    with pytest.raises(ValueError, match="there is no field"):
        symbols.with_fields(found, colour=1)


def test_markers():
    text = "a /*x*/b\né/*<y*/ 😀/*z*/"
    assert markers.scan(text) == {"x": (1, 8, 8), "y": (2, 3, 2), "z": (2, 19, 16)} and markers.scan("") == {}
    for bad in ("/*a*//*a*/", "/*a/*b*/"):
        with pytest.raises(markers.MarkerError):
            markers.scan(bad)
    rows = [{"path": "a", "roles": 6}, {"path": "b", "roles": 2}]
    assert markers.missing(rows, [{"path": "b"}, {"path": "a", "roles": 2}]) == [] and len(markers.missing(rows, [{"path": "a", "roles": 1}])) == 3


def changed(ix: CodeIndex, unit: str, time: int) -> CodeIndex:
    return replace(ix, units=ix.units.withColumn("mod_time_ns", F.when(F.col("unit_name") == unit, F.lit(time)).otherwise(F.col("mod_time_ns"))))


def test_import_writes_what_is_new(spark, tmp_path):
    ix, db = project(spark), ingest.Store(spark, str(tmp_path / "db"))
    assert db.poll(ix, initial=True) == {"added_pending": 3, "completed": 3, "processed": 3, "out_of_date": 0}
    first = db._manifest()
    # Unchanged units are pending again, but nothing is written for them.
    assert db.poll(ix)["processed"] == 0 and db._manifest()["tables"]["units"] == first["tables"]["units"]
    assert db.poll(changed(ix, "a-1", 99))["processed"] == 1
    now = db._manifest()
    bucket = str(spark.range(1).select(F.pmod(F.xxhash64(F.lit("a-1")), F.lit(64))).first()[0])
    assert {b for b, f in now["tables"]["units"].items() if first["tables"]["units"].get(b) != f} == {bucket}
    assert all(now["tables"][t] == first["tables"][t] for t in ("record_symbols", "occurrences", "files"))
    assert {r["unit_name"]: r["mod_time_ns"] for r in db.current().units.collect()} == {"a-1": 99, "b-1": 2, "c-1": 3}
    kinds = [(r["snapshot"], r["kind"], r["n"]) for r in db.told().filter("kind <> 'processed_unit'").orderBy("snapshot", "ord").collect()]
    assert kinds == [(1, "initial_pending", 3), (1, "added_pending", 3), (1, "completed", 3), (2, "added_pending", 3), (2, "completed", 3), (3, "added_pending", 3), (3, "completed", 3)]
    # Files of units that are gone stay known.
    db.poll(replace(ix, units=ix.units.filter("unit_name <> 'a-1'")))
    assert db.current().units.count() == 2 and "/src/a.swift" in {r["path"] for r in files.all_files(db.current()).collect()}
    db.vacuum(keep=1)
    assert db.current().units.count() == 2 and len(db._pointers()) == 1
    stream = db.told_stream().writeStream.format("memory").queryName("told_to").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("told_to").count() == db.told().count()


def test_of_two_writers_one_reads_again(spark, tmp_path, monkeypatch):
    ix, db = project(spark), ingest.Store(spark, str(tmp_path / "db"))
    other, publish, done = ingest.Store(spark, str(tmp_path / "db")), db._publish, []

    def late(manifest):
        if not done:
            done.append(other.process_outputs(ix, ["/build/a.o"]))
        publish(manifest)

    monkeypatch.setattr(db, "_publish", late)
    assert db.process_outputs(ix, ["/build/b.o"])["processed"] == 1
    assert {r[0] for r in db.current().units.select("unit_name").collect()} == {"a-1", "b-1"} and db._manifest()["number"] == 2
    with pytest.raises(ingest.Conflict):
        publish(db._manifest() | {"number": 1})
    # A pointer whose writer died is no snapshot.
    (tmp_path / "db" / "current-000000000003").write_text("")
    assert db.current().units.count() == 2
    monkeypatch.setattr(ingest, "CLAIM_SECONDS", -1)
    assert ingest.Store(spark, str(tmp_path / "db")).process_outputs(ix, ["/build/c.o"])["processed"] == 1


def test_explicit_outputs(spark, tmp_path):
    ix = project(spark)
    pch = spark.createDataFrame([("p-1", 9, "/build/p.pch", None, False, "", "arm64", "main", "/src", False, False, True, "clang", "5")], SCHEMAS["units"])
    dep = spark.createDataFrame([("b-1", 1, "unit", "p-1", "", "main", False), ("p-1", 0, "record", "c-rec", "/src/h.h", "main", False)], SCHEMAS["unit_deps"])
    ix = replace(ix, units=ix.units.unionByName(pch), unit_deps=ix.unit_deps.unionByName(dep))
    db = ingest.Store(spark, str(tmp_path / "db"), ingest.Options(explicit_outputs=frozenset()))
    c = "s:4main1cyyF"
    assert db.poll(ix, initial=True)["processed"] == 0 and at(symbols.occurrences_of(db.current(), c, ALL_ROLES)) == []
    # Outputs are added and removed one by one; what b depends on comes with it, and stays.
    assert db.add_outputs(ix, ["/build/a.o", "/build/b.o"])["processed"] == 3
    assert at(symbols.occurrences_of(db.current(), c, ALL_ROLES)) == sorted([("", 1, 11), ("a", 3, 13)]) or len(at(symbols.occurrences_of(db.current(), c, ALL_ROLES))) == 2
    db.remove_outputs(ix, ["/build/b.o"])
    assert {r[0] for r in db.imported().units.select("unit_name").collect()} == {"a-1", "p-1"} and db.outputs() == ["/build/a.o"]
    assert at(symbols.occurrences_of(db.current(), c, ALL_ROLES)) == [("a", 3, 13)]


def test_prefix_mappings(spark, tmp_path):
    db = ingest.Store(spark, str(tmp_path / "db"), ingest.Options(prefix_mappings=(("/src", "/home/x"), ("/build", "/out"))))
    db.poll(project(spark))
    assert {r[0] for r in db.current().unit_deps.select("path").collect()} == {f"/home/x/{x}.swift" for x in "abc"}
    assert {(r["out_file"], r["main_file"]) for r in db.current().units.collect()} == {(f"/out/{x}.o", f"/home/x/{x}.swift") for x in "abc"}
    assert db.process_outputs(project(spark), ["/out/a.o"])["processed"] == 1
    for t in SCHEMAS:
        getattr(project(spark), t).write.parquet(str(tmp_path / "landing" / t))
    landed = store.open_store(spark, str(tmp_path / "landing"), [("/src", "/y")])
    assert landed.units.filter("main_file like '/y/%'").count() == 3
    with pytest.raises(store.StoreError, match="index store path does not exist"):
        store.open_store(spark, str(tmp_path / "nowhere"))


def test_out_of_date(spark, tmp_path):
    ix, stats = project(spark), "path string, mtime_ns long"
    more = spark.createDataFrame([("b-1", 1, "unit", "c-1", "", "main", False)], SCHEMAS["unit_deps"])
    times = {"/src/a.swift": 0, "/src/b.swift": 0, "/src/c.swift": 0}
    at_times = lambda **new: replace(ix, unit_deps=ix.unit_deps.unionByName(more), file_stats=spark.createDataFrame(list((times | {f"/src/{k}.swift": v for k, v in new.items()}).items()), stats))
    db = ingest.Store(spark, str(tmp_path / "db"), ingest.Options(watch=True))
    assert db.poll(at_times(), initial=True)["out_of_date"] == 0
    # c is touched: c and, through it, b are out of date, once.
    found = db.check_files(at_times(c=100), ["/src/c.swift"])
    assert sorted((r["unit_name"], r["path"], r["trigger_ns"], r["synchronous"]) for r in found.collect()) == [("b-1", "/src/c.swift", 100, True), ("c-1", "/src/c.swift", 100, True)]
    assert db.check_files(at_times(c=100), ["/src/c.swift"]).count() == 0 and db.check_files(at_times(c=100), ["/src/"], directories=True).count() == 0
    assert {r["unit_name"] for r in db.told().filter("kind = 'out_of_date'").collect()} == {"b-1", "c-1"}
    # c is built again: its trigger is gone. b is not, and a later touch tells of it again. A missing file is changed now.
    rebuilt = changed(at_times(c=100), "c-1", 200)
    assert db.poll(rebuilt)["out_of_date"] == 0 and {r["unit_name"] for r in db.triggers().collect()} == {"b-1"}
    gone = replace(rebuilt, file_stats=rebuilt.file_stats.filter("path <> '/src/c.swift'"))
    assert {(r["unit_name"], r["trigger_ns"]) for r in db.check_files(gone, ["/src/c.swift"], now_ns=500).collect()} == {("b-1", 500), ("c-1", 500)}
    assert [tuple(r) for r in files.outputs_out_of_date(gone, ["/build/a.o", "/x"], ["/src/a.swift"], 500).orderBy("out_file").collect()] == [("/build/a.o", False), ("/x", True)]


def test_import_and_stream(spark, tmp_path):
    ix, db = project(spark), ingest.Store(spark, str(tmp_path / "db"))
    none = db.current().units.select("unit_name", "mod_time_ns")
    assert db.poll(ix, none)["processed"] == 3
    assert db.poll(ix, none)["processed"] == 0  # the times are the same
    c = "s:4main1cyyF"
    assert at(symbols.occurrences_of(db.current(), c, ALL_ROLES)) == [("a", 3, 13), ("c", 1, 11)]
    spark.createDataFrame([(1, "Removed", "a-1", False, False, False)], ingest.EVENTS).write.parquet(str(tmp_path / "events"))
    db.listen(ix, str(tmp_path / "events"), str(tmp_path / "cp")).awaitTermination(60)
    after = db.current()
    assert at(symbols.occurrences_of(after, c, ALL_ROLES)) == [("c", 1, 11)]
    assert [r["name"] for r in symbols.symbol_names(after).collect()] == ["a()", "b()", "c()"]  # names stay
    assert db.process_outputs(ix, ["/build/c.o"])["processed"] == 1
    with pytest.raises(ingest.IndexError_):
        ingest.Store(spark, str(tmp_path / "none"), ingest.Options(readonly=True))


def test_walks_write_what_they_see_once(spark, monkeypatch):
    """F1, F10, F15, F16: what was seen was written again at each level."""
    depth, rows = 16, []
    ix = project(spark)
    units = [(f"u-{i}", 1, f"/build/{i}.o", f"/src/{i}.c", True, "", "arm64", "main", "/src", False, False, True, "clang", "5") for i in range(depth)]
    deps = [(f"u-{i}", 0, "unit", f"u-{i - 1}", "", "main", False) for i in range(1, depth)] + [("u-0", 1, "file", "", "/inc/x.h", "", False), ("u-3", 2, "unit", f"u-{depth - 1}", "", "main", False)]
    ix = replace(ix, units=spark.createDataFrame(units, SCHEMAS["units"]), unit_deps=spark.createDataFrame(deps, SCHEMAS["unit_deps"]), file_stats=spark.createDataFrame([("/inc/x.h", 9)], "path string, mtime_ns long"))
    keep = monitor.checkpoint

    def counted(df):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(monitor, "checkpoint", counted)
    told, triggers = monitor.check_files(ix, ["/inc/x.h"], 99, monitor.no_triggers(ix))
    assert told.count() == triggers.count() == depth and {r["trigger_ns"] for r in triggers.collect()} == {9}
    assert sum(rows) < 7 * depth
    # What is known already, at the same or a later time, is passed over, and what follows it too.
    known = spark.createDataFrame([("u-2", "/inc/x.h", 10)], monitor.TRIGGERS)
    told, triggers = monitor.check_files(ix, ["/inc/x.h"], 99, known)
    assert {r["unit_name"] for r in told.collect()} == {"u-0", "u-1"} and sorted(map(tuple, triggers.collect())) == [("u-0", "/inc/x.h", 9), ("u-1", "/inc/x.h", 9), ("u-2", "/inc/x.h", 10)]


def test_symbols_of_records_are_united_in_fixed_width(spark):
    """rows of occurrences were sorted for their symbols' texts."""
    plan = load(spark, SF).record_symbols.select("record_name", "usr", "name", "roles")._jdf.queryExecution().executedPlan().toString()
    sorts = [x for x in plan.splitlines() if "SortAggregate" in x]
    assert all("key=[p_partkey" in x for x in sorts) and "HashAggregate(keys=[l_orderkey" in plan


def test_import_moves_what_is_chosen_once(spark, tmp_path, monkeypatch):
    """F2 to F5, F7, F8: an import shuffled its landing tables for each use, and a task held a whole bucket, or all that was told."""
    ix = load(spark, SF)
    names = ix.unit_deps.filter("kind = 'record' and ord = 0 and pmod(xxhash64(name), 3) = 0").select(F.col("name").alias("record_name")).unionByName(spark.createDataFrame([("rec-007",), ("rec-", ), ("x",)], "record_name string"))
    units = ix.units.filter("pmod(xxhash64(unit_name), 3) = 0").select("unit_name").unionByName(spark.createDataFrame([("unit-07",)], "unit_name string"))
    plain, rows = replace(ix, source=None), lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for f, asked in (("of_units", units), ("of_records", names)):
        for a, b in zip(getattr(ix, f)(asked, lambda df: df), getattr(plain, f)(asked, lambda df: df), strict=True):
            assert rows(a) == rows(b) and len(rows(a)) > 50
    # A table that was changed is used as it is.
    assert replace(ix, unit_deps=ix.unit_deps.limit(0)).of_units(units, lambda df: df)[0].count() == 0
    monkeypatch.setattr(ingest, "TOLD_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        db = ingest.Store(spark, str(tmp_path / "db"), ingest.Options(buckets=1))
        db.poll(ix)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = lambda folder: len(list((tmp_path / "db").glob(f"{folder}/*.parquet")))
    assert at("*/units/bucket=0") > 1 and at("told-*") > 1 and not list((tmp_path / "db").glob("work-*"))
    assert db.current().units.count() == ix.units.count() == db.told().filter("kind = 'processed_unit'").count()


def test_walks_from_few_seeds_shuffle_no_edges(spark, monkeypatch):
    """each level shuffled all edges."""
    plans, keep = [], index.checkpoint
    monkeypatch.setattr(index, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(1, 99).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
        assert closure(spark.createDataFrame([(3, 3)], "seed long, node long"), edges, spark.createDataFrame([(1,)], "node long")).count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("BroadcastHashJoin [src" in p for p in plans[1:]) and len(plans) > 2


def test_edges_and_kinds_are_found_in_one_pass(spark, monkeypatch):
    """base edges read the occurrences for overrides and bases apart; kinds were looked up for each callee."""
    ix, asked, keep = load(spark, SF), [], symbols._kinds_of
    plan = symbols.base_edges(ix)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in x and "l_orderkey" in x for x in plan.splitlines()) == 2
    monkeypatch.setattr(symbols, "_kinds_of", lambda ix, usrs: asked.append(usrs) or keep(ix, usrs))
    small = project(spark)
    assert at(symbols.calls_of(small, ["s:4main1cyyF", "s:4main1ayyF", "none"])) == [("a", 3, 13), ("b", 2, 13)] and len(asked) == 1
