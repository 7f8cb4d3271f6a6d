"""The engine's queries over the projected tables, each with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.functions.exprs import all_of, any_of, kind_of, language_of, minus, properties_contain, property_components, role_text, sub_kind_of
from symlake.model import CALL, CALLED_BY, CHILD_OF, DEF, OVERRIDE_OF, REF
from symlake.operators import dump, files, store, symbols
from symlake.plans.index import CodeIndex, Visibility, checkpoint
from symlake.sources.projection import duckdb_views, load
from symlake.streaming import ingest, monitor

OUT = ("usr", "path", "line", "col", "roles", "module_name", "mod_time_ns")
CANON = "cast(-9223372036854775808 as bigint)"
_MAIN = ["/src/c7.swift", "/src/c8.swift", "/src/c9.c"]
_OUTS = ["/build/o2.o", "/build/o5.o", "/build/o9.o", "/build/o12.o"]


def _refs(name: str, units: str) -> str:
    return f"""{name} as (select record_name, path, arg_min(unit_name, (-mod_time_ns, unit_name)) as unit_name, max(mod_time_ns) as mod_time_ns, arg_min(module_name, unit_name) as module_name, arg_min(is_system, unit_name) as is_system
  from (select d.name as record_name, d.path, d.unit_name, u.mod_time_ns, d.module_name, d.is_system from m_deps d join {units} u on u.unit_name = d.unit_name where d.kind = 'record') group by record_name, path)"""


_PRE = f"with recursive {duckdb_views()},\n{_refs('d1', 'm_units')}"
_OCC = "select o.usr, f.path, o.line, o.col, o.roles, f.module_name, f.mod_time_ns from {} o join d1 f on f.record_name = o.record_name"
_NAMES = "names as (select distinct name, usr from m_recsym where (roles & 3) <> 0 and name <> '' and not (language = 'swift' and kind = 'extension'))"
_BUCKETS = """buckets as (select distinct case when kind = 'struct' and language = 'cxx' then 'class' else kind end as bucket, usr from m_recsym where (roles & 3) <> 0 and kind in ('class', 'protocol', 'function', 'struct')
  union select case when kind in ('class', 'extension') then 'testClassOrExtension' else 'testMethod' end, usr from m_recsym where (roles & 2) <> 0 and (properties & 8) <> 0 and kind in ('class', 'extension', 'instanceMethod'))"""


def _canonical(producer: str, before: bool = False, workspace: bool = False, refs: str = "d1") -> str:
    """CTEs ending in `k` (record_name, usr, ic) from a producer of usr."""
    system = "where not system" if workspace else ""
    return f"""asked as (select distinct usr from ({producer})),
cand0 as (select rs.record_name, rs.usr, (rs.roles & {CANON}) <> 0 as ic from m_recsym rs join asked a on a.usr = rs.usr where (rs.roles & (1 | {CANON})) <> 0),
vis as (select record_name, arg_min(is_system, path) as system from {refs} group by record_name),
cand as (select c.*, v.system from cand0 c join vis v on v.record_name = c.record_name),
best as (select usr, bool_or(ic) as best from {"cand0" if before else "cand"} group by usr),
k as (select c.record_name, c.usr, c.ic from (select * from cand {system}) c join best b on b.usr = c.usr and c.ic = b.best)"""


_CANON_OUT = f"""select o.usr, f.path, o.line, o.col, o.roles, f.module_name, f.mod_time_ns from k join m_occ o on o.record_name = k.record_name and o.usr = k.usr join d1 f on f.record_name = o.record_name
where case when k.ic then (o.roles & {CANON}) <> 0 else (o.roles & (1 | {CANON})) <> 0 end"""
_EXPLODED = "rel as (select record_name, usr, line, col, roles, rel_usr as ru, rel_roles as rr from m_occ union all select record_name, usr, line, col, roles, rel2_usr, rel2_roles from m_occ where rel2_usr is not null)"
_HOLD = "hold as (select distinct path, unit_name from m_deps where kind in ('record', 'file') and path <> '')"
_UP = """up as (select distinct h.unit_name as seed, h.unit_name as node from {} h union
  select u.seed, d.unit_name from up u join m_units m on m.unit_name = u.node and not m.has_main_file join m_deps d on d.kind = 'unit' and d.name = u.node),
roots as (select u.seed as unit_name, u.node as root from up u join m_units m on m.unit_name = u.node and m.has_main_file)"""
_DOWN = "down as (select unit_name as seed, unit_name as node from m_units where unit_name in ('unit-77', 'unit-450') union select x.seed, d.name from down x join m_deps d on d.kind = 'unit' and d.unit_name = x.node)"
_RECORD = """chosen as (select d.path as file, arg_min(d.name, (d.unit_name, d.ord)) as record_name from m_deps d where d.kind = 'record' and d.path in ('/src/c7.swift', '/inc/h5.h') and d.name in (select record_name from d1) group by d.path)"""
_VISIBLE = """visible as (select unit_name from m_units where has_main_file and {key} union
  select r.unit_name from roots r join m_units u on u.unit_name = r.root where {key})"""
_BITS = "decl def ref read write call dyn addrOf implicit childOf baseOf overrideOf recBy calledBy extendedBy accOf contBy ibTypeOf specializationOf".split()
_ROLE_TEXT = "concat('[', array_to_string(list_filter([" + ", ".join(f"case when (roles & {1 << i}) <> 0 then '{n}' end" for i, n in enumerate(_BITS)) + f", case when (roles & {CANON}) <> 0 then 'canon' end], lambda x: x is not null), '|'), ']')"

Query = Callable[[CodeIndex], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _q(name: str, run: Query, sql: str | None) -> None:
    _ALL[name] = (run, None if sql is None else _PRE + (", " if not sql.startswith("select") else " ") + sql)


def _out(df: DataFrame) -> DataFrame:
    return df.select(*OUT)


def _triggers(ix: CodeIndex) -> DataFrame:
    return ix.units.filter(F.col("unit_name").isin("unit-2", "unit-40")).select("unit_name", (F.col("mod_time_ns") + 40 * 86400000000000).alias("trigger_ns"))


def _snapshots(ix: CodeIndex) -> tuple[DataFrame, DataFrame]:
    """The times of two polls."""
    before, after = (units.select("unit_name", "mod_time_ns") for units in _polled(ix))
    return before, after


def _polled(ix: CodeIndex) -> tuple[DataFrame, DataFrame]:
    """The units at two polls: at the second some are gone, some new and some changed."""
    number = F.substring_index("unit_name", "-", -1).cast("long")
    after = F.when(number % 7 == 0, F.col("mod_time_ns") + 1).otherwise(F.col("mod_time_ns"))
    return ix.units.filter(number % 5 != 1), ix.units.filter(number % 5 != 2).withColumn("mod_time_ns", after)


_q("d1_file_refs", lambda ix: ix.file_refs().select("record_name", "path", "unit_name", "mod_time_ns", "module_name", "is_system"), "select record_name, path, unit_name, mod_time_ns, module_name, is_system from d1")
_q("e1_occurrences_by_usr", lambda ix: _out(symbols.occurrences_of(ix, "s:p101", DEF | REF)), _OCC.format("m_occ") + " where o.usr = 's:p101' and (o.roles & 6) <> 0")
_q("e2_related_occurrences", lambda ix: _out(symbols.occurrences_related_to(ix, ["s:s3"], CALLED_BY)),
   _EXPLODED + ", recs as (select distinct record_name from rel where ru = 's:s3' and (rr & 8192) <> 0) " + _OCC.format("m_occ") + " where (o.rel_usr = 's:s3' or coalesce(o.rel2_usr, '') = 's:s3') and (o.roles & 8192) <> 0 and o.record_name in (select record_name from recs)")
_q("e2_related_strict", lambda ix: _out(symbols.occurrences_related_to(ix, ["s:p50"], OVERRIDE_OF, strict=True)), _OCC.format("m_occ") + " where o.rel2_usr = 's:p50' and (o.rel2_roles & 2048) <> 0")
_q("e3_canonical_by_name", lambda ix: _out(symbols.canonical_by_name(ix, "red widget")), _NAMES + ", " + _canonical("select usr from names where name = 'red widget'") + _CANON_OUT)
_q("e4_canonical_prefix", lambda ix: _out(symbols.canonical_matching(ix, "cold", anchor_start=True)), _NAMES + ", " + _canonical("select usr from names where starts_with(name, 'cold')") + _CANON_OUT)
_q("e4_canonical_suffix_icase", lambda ix: _out(symbols.canonical_matching(ix, "RING", anchor_end=True, ignore_case=True)), _NAMES + ", " + _canonical("select usr from names where ends_with(lower(name), 'ring')") + _CANON_OUT)
_q("e4_canonical_subsequence", lambda ix: _out(symbols.canonical_matching(ix, "rdg", subsequence=True)), _NAMES + ", " + _canonical("select usr from names where regexp_matches(name, '^[^r]*r[^d]*d[^g]*g')") + _CANON_OUT)
_q("e5_canonical_by_usr", lambda ix: _out(symbols.canonical_by_usr(ix.with_units(~F.col("is_system")), ["s:p7", "s:p8", "s:p9"])),
   "m_vis as (select * from m_units where not is_system), " + _refs("d2", "m_vis") + ", " + _canonical("select usr from m_recsym where usr in ('s:p7', 's:p8', 's:p9')", before=True, refs="d2") + _CANON_OUT.replace("d1 f", "d2 f"))
_q("e6_canonical_all", lambda ix: _out(symbols.canonical(ix)), _canonical("select usr from m_recsym") + _CANON_OUT)
_q("e7_canonical_by_kind", lambda ix: _out(symbols.canonical_by_kind(ix, "class")), _BUCKETS + ", " + _canonical("select usr from buckets where bucket = 'class'") + _CANON_OUT)
_q("e7_workspace_only", lambda ix: _out(symbols.canonical_by_kind(ix, "protocol", workspace_only=True)), _BUCKETS + ", " + _canonical("select usr from buckets where bucket = 'protocol'", workspace=True) + _CANON_OUT)
_q("e8_count_by_kind", lambda ix: symbols.count_by_kind(ix), _BUCKETS + ", " + _canonical("select usr from buckets") + "select b.bucket, count(*) as n from buckets b join k on k.usr = b.usr group by b.bucket")
_q("e9_symbols_in_file", lambda ix: symbols.symbols_in_file(ix, ["/src/c7.swift", "/inc/h5.h"]).select("file", "usr", "name", "kind", "roles"),
   _RECORD + "select c.file, s.usr, s.name, s.kind, s.roles from chosen c join m_recsym s on s.record_name = c.record_name where (s.roles & 3) <> 0")
_q("e10_occurrences_in_file", lambda ix: symbols.occurrences_in_file(ix, ["/src/c7.swift", "/inc/h5.h"]).select("file", *OUT),
   _RECORD + "select c.file, o.usr, f.path, o.line, o.col, o.roles, f.module_name, f.mod_time_ns from chosen c join m_occ o on o.record_name = c.record_name join d1 f on f.record_name = c.record_name")
_q("e11_symbol_names", lambda ix: symbols.symbol_names(ix), _NAMES + " select distinct name from names")
_TESTS = "tests as (select record_name, usr from m_recsym where (properties & 8) <> 0), flagged as (select distinct record_name from m_recsym where (properties & 8) <> 0 and (roles & 2) <> 0) "
_IS_TEST = " join tests t on t.record_name = o.record_name and t.usr = o.usr where o.record_name in (select record_name from flagged)"
_q("e12_unit_tests", lambda ix: _out(symbols.unit_tests(ix)), _TESTS + _OCC.format("m_occ") + _IS_TEST)
_q("e13_unit_tests_main_files", lambda ix: _out(symbols.unit_tests(ix, main_files=_MAIN)), f"mf as (select * from m_units where main_file in {tuple(_MAIN)}), " + _refs("d2", "mf") + ", " + _TESTS + _OCC.format("m_occ").replace("d1 f", "d2 f") + _IS_TEST)
_q("e14_unit_tests_out_files", lambda ix: _out(symbols.unit_tests(ix, out_files=_OUTS)), f"mf as (select * from m_units where out_file in {tuple(_OUTS)}), " + _refs("d2", "mf") + ", " + _TESTS + _OCC.format("m_occ").replace("d1 f", "d2 f") + _IS_TEST)
_CALLEES = ["s:p66", "s:p149", "s:p35", "s:p64"]
_q("e15_call_occurrences", lambda ix: symbols.calls_of(ix, _CALLEES).select("callee", *OUT),
   _EXPLODED + f""", seen as (select distinct record_name from d1), kind1 as (select usr, min(kind) as kind from m_recsym group by usr),
able as (select usr from (values {", ".join(f"('{c}')" for c in _CALLEES)}) t(usr) where usr in (select usr from m_recsym where kind in ('function', 'instanceMethod'))),
first as (select usr as callee, unnest(arg_min({{'roles': roles, 'r1': rel_usr, 'm1': rel_roles, 'r2': rel2_usr, 'm2': rel2_roles}}, (record_name, line))) from m_occ where usr in (select usr from able) group by usr),
dyn as (select *, case when (roles & 32) <> 0 then 4096 else 512 end as m from first where (roles & 64) <> 0),
cls0 as (select callee, r1 as c from dyn where (m1 & m) <> 0 union all select callee, r2 from dyn where r2 is not null and (m2 & m) <> 0),
ext as (select x.ru as c, min(x.usr) as usr from rel x where (x.roles & 16384) <> 0 and x.record_name in (select record_name from seen) and x.record_name in (select y.record_name from rel y where y.ru = x.ru and (y.rr & 16384) <> 0) group by x.ru),
cls as (select callee, c, case when k.kind = 'extension' then coalesce(e.usr, c) else c end as usr from cls0 left join kind1 k on k.usr = c left join ext e using (c)),
head as (select callee, k.kind = 'protocol' as proto from (select callee, arg_min(usr, c) as usr from cls group by callee) h left join kind1 k on k.usr = h.usr),
over as (select distinct ru as src, usr as dst from rel where (roles & 2048) <> 0 and record_name in (select record_name from seen)),
down as (select callee, callee as node from head where proto union select d.callee, o.dst from down d join over o on o.src = d.node),
e as (select distinct r.usr as src, r.ru as dst from rel r join kind1 k on k.usr = r.usr and k.kind = 'instanceMethod' where (r.rr & 2048) <> 0 and r.record_name in (select record_name from seen)
  union select distinct r.ru, r.usr from rel r left join kind1 k on k.usr = r.ru where (r.rr & 1024) <> 0 and coalesce(k.kind, '') <> 'instanceMethod' and r.record_name in (select record_name from seen)),
up as (select callee, 'm' as what, callee as node from head where not coalesce(proto, false) union select c.callee, 'c', c.usr from cls c join head h on h.callee = c.callee and not coalesce(h.proto, false)
  union select u.callee, u.what, e.dst from up u join e on e.src = u.node),
hit as (select a.usr as callee, o.* from able a join m_occ o on o.usr = a.usr and (o.roles & 32) <> 0 where a.usr in (select callee from first)
  union all select d.callee, o.* from down d join m_occ o on o.usr = d.node and d.node <> d.callee and (o.roles & 32) <> 0
  union all select u.callee, o.* from up u join m_occ o on u.what = 'm' and u.node <> u.callee and o.usr = u.node and (o.roles & 96) = 96
    where (o.roles & 4096) = 0 or exists (select 1 from up c where c.callee = u.callee and c.what = 'c' and ((c.node = o.rel_usr and (o.rel_roles & 4096) <> 0) or (c.node = o.rel2_usr and (o.rel2_roles & 4096) <> 0))))
select h.callee, h.usr, f.path, h.line, h.col, h.roles, f.module_name, f.mod_time_ns from hit h join d1 f on f.record_name = h.record_name""")
_q("d5_units_containing_file", lambda ix: files.units_containing_file(ix), _HOLD + " select path, unit_name from hold")
_q("d6_dependents", lambda ix: files.dependent_units(ix, ["unit-2", "unit-31"]), "select distinct name as dependency, unit_name from m_deps where kind = 'unit' and name in ('unit-2', 'unit-31')")
_q("d8_related_symbols", lambda ix: symbols._edges(ix, OVERRIDE_OF | CHILD_OF), _EXPLODED + " select distinct usr, ru as related from rel where (rr & 2560) <> 0 and record_name in (select record_name from d1)")
_MAINS = _HOLD + ", seedu as (select distinct unit_name from hold where path in ('/src/c7.swift', '/inc/h5.h', '/inc/f3.h', '/src/c9.c')), " + _UP.format("seedu")
_PATHS = ["/src/c7.swift", "/inc/h5.h", "/inc/f3.h", "/src/c9.c"]
_WIDE = " select distinct h.path, r.root as unit_name, u.mod_time_ns, u.main_file, u.out_file from hold h join roots r on r.unit_name = h.unit_name join m_units u on u.unit_name = r.root where h.path in ('/src/c7.swift', '/inc/h5.h', '/inc/f3.h', '/src/c9.c')"
_q("f1_main_files", lambda ix: files.main_files_containing_file(ix, _PATHS), _MAINS + f" select path, main_file from ({_WIDE}) where regexp_matches(path, '\\.swift(interface|module)?$') = ends_with(main_file, '.swift')")
_q("f1_main_files_cross_language", lambda ix: files.main_files_containing_file(ix, _PATHS, cross_language=True), _MAINS + f" select path, main_file from ({_WIDE})")
_q("f2_unit_names", lambda ix: files.unit_names_containing_file(ix, _PATHS), _MAINS + f" select path, unit_name from ({_WIDE})")
_q("f3_main_units", lambda ix: files.main_units_containing_file(ix, _PATHS), _MAINS + _WIDE)
_q("f4_included_by", lambda ix: files.files_included_by(ix, _MAIN), f"select source_path, target_path, min(line) as line from m_inc where source_path in {tuple(_MAIN)} group by all")
_q("f5_including", lambda ix: files.files_including(ix, ["/inc/h5.h", "/inc/h6.h"]),
   _HOLD + " select i.target_path, i.source_path, min(i.line) as line from m_inc i join hold h on h.path = i.target_path and h.unit_name = i.unit_name where i.target_path in ('/inc/h5.h', '/inc/h6.h') group by all")
_q("f6_includes_of_unit", lambda ix: files.includes_of_unit(ix, "unit-77"), "select source_path, target_path, line from m_inc where unit_name = 'unit-77'")
_q("f7_known_file", lambda ix: files.known_files(ix, ["/src/c7.swift", "/nowhere.c"]), "select p as path, exists (select 1 from m_deps d where d.kind <> 'unit' and d.path = p) as known from (values ('/src/c7.swift'), ('/nowhere.c')) t(p)")
_q("f8_files_of_unit", lambda ix: files.files_of_unit(ix, ["unit-77", "unit-450"]), "select distinct unit_name, path from m_deps where kind <> 'unit' and unit_name in ('unit-77', 'unit-450')")
_q("f8_files_of_unit_closure", lambda ix: files.files_of_unit(ix, ["unit-77", "unit-450"], True), _DOWN + " select distinct x.seed as unit_name, d.path from down x join m_deps d on d.unit_name = x.node and d.kind <> 'unit'")
_q("f9_filenames_pattern", lambda ix: files.files_matching(ix, "C1", anchor_start=True, ignore_case=True), "select distinct path from m_deps where kind <> 'unit' and starts_with(lower(regexp_extract(path, '[^/]*$')), 'c1') and not regexp_matches(path, '\\.(o|pcm)$')")
_q("f10_files_in_dir", lambda ix: files.files_in_directories(ix, ["/inc/"]), "select distinct path from m_deps where kind <> 'unit' and regexp_matches(path, '^/inc/[^/]*$')")
_q("f11_latest_unit_time", lambda ix: files.latest_unit_time(ix), _HOLD + " select h.path, max(u.mod_time_ns) as mod_time_ns from hold h join m_units u on u.unit_name = h.unit_name group by h.path")
_q("f12_unit_time_by_output", lambda ix: files.unit_time_by_output(ix, [*_OUTS, "/build/none.o"]), "select o as out_file, mod_time_ns from (values ('/build/o2.o'), ('/build/o5.o'), ('/build/o9.o'), ('/build/o12.o'), ('/build/none.o')) t(o) left join m_units on out_file = o")
_q("f13_directories", lambda ix: files.directories(ix), "select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from m_deps where kind <> 'unit'")
_q("r1_root_units", lambda ix: ix.roots(ix.units.select("unit_name")), _UP.format("m_units") + " select distinct unit_name, root from roots")
_q("r2_dependency_closure", lambda ix: ix.dependency_closure(ix.units.filter(F.col("unit_name").isin("unit-77", "unit-450"))), _DOWN + " select seed as unit_name, node as dependency from down")
_CLOSE = " select seed, node as usr from c where seed <> node"
_q("r3_base_hierarchy", lambda ix: symbols.base_hierarchy(ix, ["s:p88", "s:p45", "s:p46"]),
   _EXPLODED + """, meth as (select usr, bool_or(kind = 'instanceMethod') as m from m_recsym group by usr),
e as (select distinct r.usr as src, r.ru as dst from rel r join meth on meth.usr = r.usr and meth.m where (r.rr & 2048) <> 0 and r.record_name in (select record_name from d1)
  union select distinct r.ru, r.usr from rel r left join meth on meth.usr = r.ru where (r.rr & 1024) <> 0 and not coalesce(meth.m, false) and r.record_name in (select record_name from d1)),
c as (select s as seed, s as node from (values ('s:p88'), ('s:p45'), ('s:p46')) t(s) union select c.seed, e.dst from c join e on e.src = c.node)""" + _CLOSE)
_q("r4_related_closure", lambda ix: symbols.related_closure(ix, ["s:p3", "s:p20"], OVERRIDE_OF),
   _EXPLODED + """, e as (select distinct ru as src, usr as dst from rel where (roles & 2048) <> 0 and record_name in (select record_name from d1)),
c as (select s as seed, s as node from (values ('s:p3'), ('s:p20')) t(s) union select c.seed, e.dst from c join e on e.src = c.node)""" + _CLOSE)
_q("r5_out_of_date_closure", lambda ix: files.out_of_date_closure(ix, _triggers(ix)),
   """c as (select unit_name, mod_time_ns + 40 * 86400000000000 as t from m_units where unit_name in ('unit-2', 'unit-40') union
  select d.unit_name, c.t from c join m_deps d on d.kind = 'unit' and d.name = c.unit_name join m_units u on u.unit_name = d.unit_name and u.mod_time_ns < c.t)
select c.unit_name, max(t) as trigger_ns, bool_or(u.has_main_file) as notify from c join m_units u on u.unit_name = c.unit_name group by c.unit_name""")
_q("v1_visible_units_main", lambda ix: ix.show_main_files(_MAIN).visible, _UP.format("(select unit_name from m_units where not has_main_file)") + ", " + _VISIBLE.format(key=f"main_file in {tuple(_MAIN)}") + " select distinct unit_name from visible")
_q("v3_visible_units_explicit", lambda ix: ix.show_outputs(_OUTS).visible, _UP.format("(select unit_name from m_units where not has_main_file)") + ", " + _VISIBLE.format(key=f"out_file in {tuple(_OUTS)}") + " select distinct unit_name from visible")
_NUM = "cast(substr(unit_name, 6) as bigint)"
_POLL = f"b as (select unit_name, mod_time_ns from m_units where {_NUM} % 5 <> 1), a as (select unit_name, case when {_NUM} % 7 = 0 then mod_time_ns + 1 else mod_time_ns end as mod_time_ns from m_units where {_NUM} % 5 <> 2) "
_q("b2_stale_units", lambda ix: ingest.stale_units(*_snapshots(ix)), _POLL + "select a.unit_name, a.mod_time_ns from a left join b on b.unit_name = a.unit_name where b.unit_name is null or b.mod_time_ns <> a.mod_time_ns")
_FACTS = ("usr", "name", "kind", "sub_kind", "properties", "language", "codegen_name")
_q("b5_record_symbols", lambda ix: ingest.record_symbols(ix.occurrences, ix.record_symbols.select(*_FACTS, F.col("record_name").alias("ord"))).select("record_name", "usr", "name", "kind", "properties", "language", "roles", "related_roles"),
   "select r.record_name, r.usr, r.name, r.kind, r.properties, r.language, r.roles, coalesce(x.related_roles, 0)::bigint as related_roles from m_recsym r left join m_rel x on x.record_name = r.record_name and x.usr = r.usr")
_q("b6_name_index", lambda ix: ix.symbol_names(), _NAMES + " select name, usr from names")
_q("b6_kind_index", lambda ix: ix.symbol_kinds(), _BUCKETS + " select bucket, usr from buckets")
_q("b11_poll_diff", lambda ix: ingest.poll_events(*_snapshots(ix)),
   _POLL + "select coalesce(a.unit_name, b.unit_name) as unit_name, case when b.unit_name is null then 'Added' when a.unit_name is null then 'Removed' when a.mod_time_ns = b.mod_time_ns then 'Added' else 'Modified' end as kind from a full join b on a.unit_name = b.unit_name")
_REC = "('rec-77', 'rec-450', 'rec-1')"
_RECS = ["rec-77", "rec-450", "rec-1"]
_q("a3_unit_names", lambda ix: store.unit_names(ix, in_order=True), "select unit_name from m_units")
_q("a5_dependencies", lambda ix: store.dependencies(ix, "unit-450").select("ord", "kind", "name", "path", "module_name", "is_system"), "select ord, kind, name, path, module_name, is_system from m_deps where unit_name = 'unit-450'")
_q("a7_record", lambda ix: store.record(ix, "rec-77").record_symbols.select("usr", "name", "roles"), "select usr, name, roles from m_recsym where record_name = 'rec-77'")
_q("a8_record_symbols", lambda ix: store.symbols_of_record(ix, _RECS).select("record_name", "usr", "name", "kind", "properties", "language", "roles", "related_roles"),
   f"select r.record_name, r.usr, r.name, r.kind, r.properties, r.language, r.roles, coalesce(x.related_roles, 0)::bigint as related_roles from m_recsym r left join m_rel x on x.record_name = r.record_name and x.usr = r.usr where r.record_name in {_REC}")
_q("a9_symbols_matching", lambda ix: store.symbols_of_record(ix, _RECS, F.col("name").contains("e") & any_of("roles", DEF | REF)).select("record_name", "usr", "name"), f"select record_name, usr, name from m_recsym where record_name in {_REC} and contains(name, 'e') and (roles & 6) <> 0")
_q("a10_record_occurrences", lambda ix: store.occurrences_of_record(ix, _RECS).select("record_name", "usr", "line", "col", "roles"), f"select record_name, usr, line, col, roles from m_occ where record_name in {_REC}")
_q("a11_line_range", lambda ix: store.occurrences_of_record(ix, ["rec-77"], lines=(1, 2)).select("usr", "line", "col"), "select usr, line, col from m_occ where record_name = 'rec-77' and line between 1 and 2")
_SUPPLIERS = [f"s:{k}{i}" for i in range(1, 60) for k in "ps"]
_q("a12_symbol_filter", lambda ix: store.occurrences_of_record(ix, _RECS, symbols=["s:p101", "s:p7"], related=_SUPPLIERS).select("record_name", "usr", "line"),
   f"select record_name, usr, line from m_occ where record_name in {_REC} and (usr in ('s:p101', 's:p7') or rel_usr in {tuple(_SUPPLIERS)} or coalesce(rel2_usr, '') in {tuple(_SUPPLIERS)})")
_q("a15_relations", lambda ix: store.occurrences_of_record(ix, _RECS).select("record_name", "line", F.explode("relations").alias("r")).select("record_name", "line", "r.usr", "r.roles"), _EXPLODED + f" select record_name, line, ru as usr, rr as roles from rel where record_name in {_REC}")
_q("a16_unit_name_from_output", lambda ix: store.unit_name_from_output(ix, [*_OUTS, "/build/none.o"]), "select o as out_file, unit_name from (values ('/build/o2.o'), ('/build/o5.o'), ('/build/o9.o'), ('/build/o12.o'), ('/build/none.o')) t(o) left join m_units on out_file = o")
_q("a17_unit_time", lambda ix: store.unit_time(ix, ["unit-77", "unit-450"]), "select unit_name, mod_time_ns from m_units where unit_name in ('unit-77', 'unit-450')")
_MAPS = [("/src", "/home/x/src"), ("/inc/", "/usr/include/"), ("/build/o2.o", "/out")]
_q("a20_prefix_mappings", lambda ix: store.map_paths(ix, _MAPS).unit_deps.select("path").distinct().unionByName(store.map_paths(ix, _MAPS).units.select(F.col("out_file").alias("path"))),
   """select distinct case when path = '/src' or starts_with(path, '/src/') then '/home/x/src' || substr(path, 5) when starts_with(path, '/inc/') then '/usr/include/' || substr(path, 6) else path end as path from m_deps
   union all select case when out_file = '/build/o2.o' then '/out' else out_file end from m_units""")
_q("c4_dependency_text", lambda ix: ix.unit_deps.select(dump.dependency_text(*(F.col(c) for c in ("kind", "is_system", "module_name", "path", "name"))).alias("text")).distinct(),
   "select distinct array_to_string(list_filter([upper(kind[1]) || kind[2:], case when is_system then 'system' else 'user' end, module_name, path, name], lambda x: x <> ''), ' | ') as text from m_deps")
_SHORTS = "Decl Def Ref Read Writ Call Dyn Addr Impl RelChild RelBase RelOver RelRec RelCall RelExt RelAcc RelCont RelIBType RelSpecializationOf".split()
_LONGS = "declaration definition reference read write call dynamic addressOf implicit childOf baseOf overrideOf receivedBy calledBy extendedBy accessorOf containedBy ibTypeOf specializationOf".split()
_IN_WORDS = lambda words, roles, by: f"array_to_string(list_filter([{', '.join(f"case when ({roles} & {1 << i}) <> 0 then '{n}' end" for i, n in enumerate(words))}], lambda x: x is not null), '{by}')"
_PROPS = "case when properties = 0 then s.kind else s.kind || ' ([' || array_to_string(list_filter([case when (properties & 8) <> 0 then 'test' end, case when (properties & 917504) = 393216 then 'internal' end], lambda x: x is not null), '|') || '])' end"
_q("c5_occurrence_text", lambda ix: dump.occurrence_texts(ix, symbols.occurrences_of(ix, ["s:p7", "s:p101"], DEF | REF)).select("text"),
   f"""select case when f.module_name <> '' then f.module_name || '::' else '' end || f.path || ':' || o.line || ':' || o.col || case when f.is_system then ' [system]' else '' end || ' | ' || s.name || ' | ' || {_PROPS} || ' | ' || o.usr || ' | ' || s.language || ' | ' || {_ROLE_TEXT.replace("(roles &", "(o.roles &")}
  || chr(10) || chr(9) || '[' || {_IN_WORDS(_BITS, "o.rel_roles", "|")} || '] | ' || o.rel_usr || case when o.rel2_usr is null then '' else chr(10) || chr(9) || '[' || {_IN_WORDS(_BITS, "o.rel2_roles", "|")} || '] | ' || o.rel2_usr end as text
  from m_occ o join d1 f on f.record_name = o.record_name join m_sym s on s.usr = o.usr where o.usr in ('s:p7', 's:p101') and (o.roles & 6) <> 0""")
_q("c6_terse_text", lambda ix: dump.occurrence_texts(ix, symbols.occurrences_of(ix, ["s:p7", "s:p101"], DEF | REF)).select("short"),
   f"""select f.path || ':' || o.line || ':' || o.col || ' | ' || s.name || ' | ' || case s.kind when 'instanceMethod' then 'instance-method' else s.kind end || ' | ' || o.usr || ' | ' || {_IN_WORDS(_SHORTS, "o.roles", ",")} as short
  from m_occ o join d1 f on f.record_name = o.record_name join m_sym s on s.usr = o.usr where o.usr in ('s:p7', 's:p101') and (o.roles & 6) <> 0""")
_q("c7_file_associations", dump.file_association_lines, "select record_name, path, '---- ' || path || ', ' || unit_name || ', module: ' || module_name || ', sys: ' || is_system::int || ', ' || mod_time_ns // 1000000000 as line from d1")
_q("c8_stats", dump.stats, "select 'units' as \"table\", count(*) as n from m_units union all select 'unit_deps', count(*) from m_deps union all select 'unit_includes', count(*) from m_inc union all select 'record_symbols', count(*) from m_recsym union all select 'occurrences', count(*) from m_occ")
_q("c9_units_by_file", dump.units_by_file, _HOLD + " select path, unit_name, path || ' -> ' || unit_name as line from hold")
_q("d10_unit_info", lambda ix: dump.unit_info(ix, ["unit-77", "unit-0", "nothing"]), "select a as asked, coalesce(unit_name, '') as unit_name, mod_time_ns, out_file, main_file, unit_name is not null as valid from (values ('unit-77'), ('unit-0'), ('nothing')) t(a) left join m_units on unit_name = a")
_q("f14_test_usrs", files.unit_test_usrs, _BUCKETS + " select distinct usr from buckets where bucket in ('testClassOrExtension', 'testMethod')")
_q("h4_role_text_raw_short", lambda ix: ix.record_symbols.select("roles").distinct().select("roles", role_text("roles", "raw").alias("raw"), role_text("roles", "short").alias("short")), f"select roles, {_IN_WORDS(_LONGS, 'roles', ', ')} as raw, {_IN_WORDS(_SHORTS, 'roles', ',')} as short from (select distinct roles from m_recsym)")
_KINDS = "unknown module namespace namespaceAlias macro enum struct class protocol extension union typealias function variable field enumConstant instanceMethod classMethod staticMethod instanceProperty classProperty staticProperty constructor destructor conversionFunction parameter unknown concept".split()
_q("h8_codes", lambda ix: ix.spark.range(0, 1020).select("id", kind_of("id").alias("kind"), sub_kind_of("id").alias("sub_kind"), language_of("id").alias("language")),
   f"""select id, case when id = 1000 then 'commentTag' when id < {len(_KINDS)} then {_KINDS!r}[id + 1] else 'unknown' end as kind,
  case when id between 1 and 4 then ['cxxCopyConstructor', 'cxxMoveConstructor', 'accessorGetter', 'accessorSetter'][id] when id between 1000 and 1013 then ['swiftAccessorWillSet', 'swiftAccessorDidSet', 'swiftAccessorAddressor', 'swiftAccessorMutableAddressor', 'swiftExtensionOfStruct', 'swiftExtensionOfClass', 'swiftExtensionOfEnum', 'swiftExtensionOfProtocol', 'swiftPrefixOperator', 'swiftPostfixOperator', 'swiftInfixOperator', 'swiftSubscript', 'swiftAssociatedType', 'swiftGenericTypeParam'][id - 999] else 'none' end as sub_kind,
  case id when 1 then 'objc' when 2 then 'cxx' when 100 then 'swift' else 'c' end as language from range(0, 1020) t(id)""")
_q("h11_symbol_at", lambda ix: symbols.at_location(symbols.with_fields(store.symbols_of_record(ix, ["rec-77"]), name="other", properties=0), "/x.c", 3, F.length("usr"), DEF).select("usr", "name", "properties", "kind", "path", "line", "col", "roles"),
   "select usr, 'other' as name, 0 as properties, kind, '/x.c' as path, 3 as line, length(usr) as col, 2::bigint as roles from m_recsym where record_name = 'rec-77'")
_q("v2_registered_main_files", lambda ix: Visibility().register_main_files(_MAIN + _MAIN[:1]).unregister_main_files(_MAIN[:2] + ["/none"]).apply(ix).visible,
   _UP.format("(select unit_name from m_units where not has_main_file)") + ", " + _VISIBLE.format(key=f"main_file in {(_MAIN[0], _MAIN[2])}") + " select distinct unit_name from visible")
_q("v3_outputs_removed", lambda ix: Visibility(explicit=True).add_outputs(_OUTS).remove_outputs(_OUTS[2:3]).apply(ix).visible,
   _UP.format("(select unit_name from m_units where not has_main_file)") + ", " + _VISIBLE.format(key=f"out_file in {tuple(_OUTS[:2] + _OUTS[3:])}") + " select distinct unit_name from visible")
_q("h3_role_masks", lambda ix: ix.record_symbols.select("record_name", "usr", any_of("roles", DEF | CALL).alias("any_of"), all_of("roles", DEF | CHILD_OF).alias("all_of"), minus("roles", DEF).alias("without")),
   "select record_name, usr, (roles & 34) <> 0 as any_of, (roles & 514) = 514 as all_of, roles & ~cast(2 as bigint) as without from m_recsym")
_q("h4_role_text", lambda ix: ix.record_symbols.select("roles").distinct().select("roles", role_text("roles").alias("text")), f"select roles, {_ROLE_TEXT} as text from (select distinct roles from m_recsym)")
_q("h5_property_contains", lambda ix: ix.record_symbols.filter(properties_contain("properties", 8 | 393216)).select("record_name", "usr"), "select record_name, usr from m_recsym where (properties & 917504) = 393216 and (properties & 8) = 8")
_q("h7_property_components", lambda ix: ix.record_symbols.select("usr", F.array_join(property_components("properties"), ",").alias("parts")).distinct(),
   "select distinct usr, array_to_string(list_filter([case when (properties & 8) <> 0 then 'unitTest' end, case when (properties & 917504) = 393216 then 'internal' end], lambda x: x is not null), ',') as parts from m_recsym")
_NOW = 10592 * 86400000000000  # past all times in the tables
_q("o1_out_of_date", lambda ix: files.out_of_date(ix, _NOW),
   f"select u.unit_name, u.out_file, max(coalesce(s.mtime_ns, {_NOW})) as file_time_ns from m_units u join (select distinct unit_name, path from m_deps where kind <> 'unit') d on d.unit_name = u.unit_name left join m_stats s on s.path = d.path group by u.unit_name, u.out_file, u.mod_time_ns having max(coalesce(s.mtime_ns, {_NOW})) > u.mod_time_ns")
_q("o1_outputs_with_dirty_files", lambda ix: files.outputs_out_of_date(ix, [*_OUTS, "/build/none.o"], ["/src/c7.swift", "/src/c8.swift"], _NOW),
   f"select o as out_file, u.mod_time_ns is null or (select max(coalesce(s.mtime_ns, {_NOW})) from (values ('/src/c7.swift'), ('/src/c8.swift')) t(p) left join m_stats s on s.path = p) > u.mod_time_ns as out_of_date from (values ('/build/o2.o'), ('/build/o5.o'), ('/build/o9.o'), ('/build/o12.o'), ('/build/none.o')) t(o) left join m_units u on out_file = o")
_TOLD = ("unit_name", "main_file", "out_file", "path", "trigger_ns")


def _sql_told(seeds: str, known: str = "select '' as unit_name, '' as path, 0 as t where false") -> str:
    """What is told of seeds (unit_name, path, t), past what is known."""
    return f"""times as (select p.path, coalesce(s.mtime_ns, {_NOW}) as t from (select distinct path from m_deps where kind <> 'unit' and path <> '') p left join m_stats s on s.path = p.path),
hold as (select distinct path, unit_name, is_system from m_deps where kind <> 'unit' and path <> ''), known as ({known}), seed as ({seeds}),
mark as (select x.unit_name, x.path, x.t from seed x join m_units u on u.unit_name = x.unit_name and not u.is_system left join known k on k.unit_name = x.unit_name and k.path = x.path and k.t >= x.t where k.t is null
  union select u.unit_name, m.path, m.t from mark m join m_deps d on d.kind = 'unit' and d.name = m.unit_name join m_units u on u.unit_name = d.unit_name and not u.is_system and u.mod_time_ns < m.t
  left join known k on k.unit_name = u.unit_name and k.path = m.path and k.t >= m.t where k.t is null)
select u.unit_name, u.main_file, u.out_file, m.path, max(m.t) as trigger_ns from mark m join m_units u on u.unit_name = m.unit_name and u.has_main_file group by all"""


_OLDER = "select h.unit_name, h.path, t.t from hold h join times t on t.path = h.path join m_units u on u.unit_name = h.unit_name and u.mod_time_ns < t.t where h.path in {}"
_q("o3_check_files", lambda ix: monitor.check_files(ix, _MAIN + ["/inc/h5.h"], _NOW, monitor.no_triggers(ix))[0].select(*_TOLD), _sql_told(_OLDER.format((*_MAIN, "/inc/h5.h"))))


def _known(ix: CodeIndex) -> DataFrame:
    return ix.units.filter(F.col("unit_name").isin("unit-2", "unit-40")).select("unit_name", F.lit("/x.h").alias("path"), (F.col("mod_time_ns") + 4000 * 86400000000000).alias("trigger_ns"))


_KNOWN = "select unit_name, '/x.h' as path, mod_time_ns + 4000 * 86400000000000 as t from m_units where unit_name in ('unit-2', 'unit-40')"
_q("o4_check_imported", lambda ix: monitor.check_imported(ix, ix.units, _NOW, _known(ix))[0].select(*_TOLD),
   _sql_told("select u.unit_name, k.path, k.t from m_units u join m_deps d on d.unit_name = u.unit_name and d.kind = 'unit' and not d.is_system join known k on k.unit_name = d.name and k.t > u.mod_time_ns where not u.is_system "
             "union select unit_name, path, t from (select u.unit_name, u.mod_time_ns, arg_min(h.path, (-t.t, h.path)) as path, max(t.t) as t from m_units u join hold h on h.unit_name = u.unit_name and not h.is_system join times t on t.path = h.path where not u.is_system group by all) where t > mod_time_ns", _KNOWN))
_q("o5_check_directories", lambda ix: monitor.check_directories(ix, ["/inc/"], _NOW, monitor.no_triggers(ix))[0].select(*_TOLD),
   _sql_told("select h.unit_name, h.path, t.t from hold h join times t on t.path = h.path join m_units u on u.unit_name = h.unit_name and u.mod_time_ns < t.t where regexp_matches(h.path, '^/inc/[^/]*$')"))
_q("o6_triggers_once", lambda ix: monitor.check_files(ix, _MAIN, _NOW, monitor.check_files(ix, _MAIN[:2], _NOW, monitor.no_triggers(ix))[1])[0].select(*_TOLD), _sql_told(_OLDER.format(f"('{_MAIN[2]}')")))


_STORES: dict[tuple, ingest.Store] = {}


def _imported(ix: CodeIndex) -> ingest.Store:
    """A store after two polls, the second as in _snapshots(): one for each session and index, in the shared folder."""
    key = (ix.spark.sparkContext.applicationId, ix.units.inputFiles()[0])
    if key not in _STORES:
        checkpoint(ix.spark.range(1))  # names the shared folder
        stored = ingest.Store(ix.spark, f"{ix.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}", ingest.Options(buckets=4))
        before, after = _polled(ix)
        stored.poll(replace(ix, units=before), initial=True)
        stored.poll(replace(ix, units=after), before)
        _STORES[key] = stored
    return _STORES[key]


_EXPLICIT: dict[tuple, list[CodeIndex]] = {}


def _explicit(ix: CodeIndex, removed: bool) -> CodeIndex:
    """A store with explicit outputs, after some were added, and after one was taken away again."""
    key = (ix.spark.sparkContext.applicationId, ix.units.inputFiles()[0])
    if key not in _EXPLICIT:
        checkpoint(ix.spark.range(1))
        stored = ingest.Store(ix.spark, f"{ix.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}", ingest.Options(explicit_outputs=frozenset(), buckets=4))
        stored.add_outputs(ix, _OUTS)
        added = stored.imported()
        stored.remove_outputs(ix, _OUTS[2:3])
        _EXPLICIT[key] = [added, stored.imported()]
    return _EXPLICIT[key][removed]


_CHASE = f"chase as (select unit_name from m_units where out_file in {tuple(_OUTS)} union select u.unit_name from chase c join m_deps d on d.kind = 'unit' and d.unit_name = c.unit_name join m_units u on u.unit_name = d.name)"
_EVER = "ever as (select distinct d.* from m_deps d where d.unit_name in (select unit_name from a union select unit_name from b))"
_q("b1_units_imported", lambda ix: _imported(ix).current().units.select("unit_name", "mod_time_ns", "out_file", "main_file"), _POLL + "select a.unit_name, a.mod_time_ns, u.out_file, u.main_file from a join m_units u on u.unit_name = a.unit_name")
_q("b3_dependencies_replaced", lambda ix: _imported(ix).current().unit_deps.select("unit_name", "ord", "kind", "name", "path"), _POLL + "select d.unit_name, d.ord, d.kind, d.name, d.path from m_deps d join a on a.unit_name = d.unit_name")
_q("b4_records_once", lambda ix: _imported(ix).current().record_symbols.select("record_name", "usr").repartition("record_name").groupBy("record_name").agg(F.count("*").alias("n"), F.countDistinct("usr").alias("symbols")), _POLL + f", {_EVER} select r.record_name, count(*) as n, count(distinct r.usr) as symbols from m_recsym r where r.record_name in (select name from ever where kind = 'record') group by r.record_name")
_q("b8_names_stay", lambda ix: _imported(ix).current().symbol_names(), _POLL + f", {_EVER} select distinct name, usr from m_recsym where (roles & 3) <> 0 and name <> '' and not (language = 'swift' and kind = 'extension') and record_name in (select name from ever where kind = 'record')")
_q("b9_files_stay", lambda ix: files.all_files(_imported(ix).current()), _POLL + f", {_EVER} select distinct path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '[^/]*$') as file from ever where kind <> 'unit'")
_q("b12_outputs_removed", lambda ix: _explicit(ix, True).units.select("unit_name"), _CHASE + " select unit_name from chase where unit_name <> 'unit-9'")
_q("b13_dependencies_chased", lambda ix: _explicit(ix, False).units.select("unit_name"), _CHASE + " select unit_name from chase")
_q("s1_delegate_events", lambda ix: _imported(ix).told().groupBy("snapshot", "kind").agg(F.count("*").alias("told"), F.max("n").alias("n")),
   _POLL + """, k as (select count(*) as b, (select count(*) from (select unit_name from a union select unit_name from b)) as bt, (select count(*) from a left join b on a.unit_name = b.unit_name where b.unit_name is null or a.mod_time_ns <> b.mod_time_ns) as stale from b)
select 1::bigint as snapshot, 'initial_pending' as kind, 1 as told, b as n from k union all select 1, 'added_pending', 1, b from k union all select 1, 'processed_unit', b, null from k union all select 1, 'completed', 1, b from k
union all select 2, 'added_pending', 1, bt from k union all select 2, 'processed_unit', stale, null from k union all select 2, 'completed', 1, bt from k""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, run=run: run(load(spark, sf_dir))) for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}


