"""The driver's star schema read as a code index: one SQL text for both engines, and the frames made from it."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.plans.index import CodeIndex, Once, Source

_CANON = "cast(-9223372036854775808 as bigint)"
VIEWS = {
    "m_units": """select o_orderkey as k, concat('unit-', cast(o_orderkey as string)) as unit_name, DAYS(o_orderdate) * 86400000000000 as mod_time_ns,
      concat('/build/o', cast(o_orderkey as string), '.o') as out_file, o_orderstatus <> 'P' as has_main_file,
      case when o_orderstatus <> 'P' then concat('/src/c', cast(o_custkey as string), case when o_custkey % 3 = 0 then '.c' else '.swift' end) end as main_file,
      concat('/src/c', cast(o_custkey as string), case when o_custkey % 3 = 0 then '.c' else '.swift' end) as src, o_orderpriority = '5-LOW' as is_system from orders""",
    "m_deps": """select unit_name, 0 as ord, 'record' as kind, concat('rec-', cast(k as string)) as name, src as path, 'main' as module_name, is_system from m_units
      union all select unit_name, 1, 'record', concat('rec-', cast(k - 1 as string)), concat('/inc/h', cast((k - 1) % 97 as string), '.h'), concat('m', cast(k % 5 as string)), is_system from m_units where k % 3 = 0 and k > 0
      union all select unit_name, 2, 'unit', concat('unit-', cast(k DIV 2 as string)), '', '', is_system from m_units where k > 0
      union all select unit_name, 3, 'file', '', concat('/inc/f', cast(k % 53 as string), '.h'), '', is_system from m_units where k % 2 = 0""",
    "m_sym": """select p_partkey, concat('s:p', cast(p_partkey as string)) as usr, p_name as name,
      case p_type when 'ECONOMY' then 'class' when 'LARGE' then 'instanceMethod' when 'MEDIUM' then 'function' when 'PROMO' then 'protocol' when 'SMALL' then 'struct' else 'extension' end as kind,
      case p_size % 4 when 0 then 'cxx' when 1 then 'objc' else 'swift' end as language,
      cast(case when p_size % 7 = 0 then 8 else 0 end + case when p_size % 2 = 0 then 393216 else 0 end as bigint) as properties from part""",
    "m_raw": """select concat('rec-', cast(l_orderkey as string)) as record_name, l_partkey, l_linenumber as line, cast(l_quantity as int) as col,
      cast(case l_returnflag when 'A' then 2 when 'R' then 1 else 36 end + case when l_linestatus = 'F' then 64 else 0 end as bigint) as own,
      concat(case when l_linenumber % 4 = 3 then 's:p' else 's:s' end, cast(l_suppkey as string)) as rel_usr, cast(case l_returnflag when 'N' then case when l_linenumber % 4 = 3 then 77824 else 73728 end else 512 end as bigint) as rel_roles,
      case when l_linenumber % 2 = 1 and l_returnflag = 'A' then concat('s:p', cast(l_partkey DIV 2 as string)) when l_linenumber % 2 = 1 and l_returnflag = 'R' then concat('s:p', cast(l_partkey + 1 as string)) when l_linenumber = 4 then concat('s:p', cast(l_partkey % 40 as string)) end as rel2_usr,
      cast(case when l_linenumber % 2 = 1 and l_returnflag = 'A' then 2048 when l_linenumber % 2 = 1 and l_returnflag = 'R' then 1024 when l_linenumber = 4 then 16384 else 0 end as bigint) as rel2_roles from lineitem""",
    "m_occ": f"""select record_name, usr, line, col, rel_usr, rel_roles, rel2_usr, rel2_roles,
      own | rel_roles | rel2_roles | case when (own & case when language = 'objc' and kind in ('class', 'extension') then 1 else 2 end) <> 0 then {_CANON} else 0 end as roles
      from m_raw join m_sym on l_partkey = p_partkey""",
    "m_recsym": """select o.record_name, o.usr, min(s.name) as name, min(s.kind) as kind, min(s.language) as language, min(s.properties) as properties, bit_or(o.roles) as roles
      from m_occ o join m_sym s on s.usr = o.usr group by o.record_name, o.usr""",
    "m_rel": """select record_name, usr, bit_or(roles) as related_roles from (select record_name, rel_usr as usr, rel_roles as roles from m_occ union all
      select record_name, rel2_usr, rel2_roles from m_occ where rel2_usr is not null) group by record_name, usr""",
    "m_inc": """select u.unit_name, u.src as source_path, concat('/inc/h', cast(l.l_suppkey as string), '.h') as target_path, l.l_linenumber as line from lineitem l join m_units u on u.k = l.l_orderkey""",
    "m_stats": "select concat('/src/c', cast(user_id as string), '.swift') as path, max(DAYS(ts)) * 86400000000000 as mtime_ns from events group by user_id",
}


def duckdb_views() -> str:
    """The views as common table expressions."""
    out = []
    for name, text in VIEWS.items():
        text = text.replace(" DIV ", " // ").replace("DAYS(o_orderdate)", "date_diff('day', DATE '1970-01-01', cast(o_orderdate as date))").replace("DAYS(ts)", "date_diff('day', DATE '1970-01-01', cast(ts as date))")
        out.append(f"{name} as ({text})")
    return ",\n".join(out)


def _columns(view: str, table: str) -> str:
    """What a view selects from its one table."""
    return VIEWS[view].removeprefix("select ").removesuffix(f" from {table}")


def _facts(spark: SparkSession, part: DataFrame) -> DataFrame:
    """What m_recsym tells of a symbol, once for each, and the bits (deciding) that make an occurrence of it canonical."""
    return spark.sql(f"""select p_partkey, min(usr) as usr, min(name) as name, min(kind) as kind, min(language) as language, min(properties) as properties,
      bit_or(cast(case when language = 'objc' and kind in ('class', 'extension') then 1 else 2 end as bigint)) as deciding from (select {_columns("m_sym", "part")} from {{part}}) group by p_partkey""", part=part)


def _symbols(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """m_recsym with l_orderkey for record_name: roles are united by keys as numbers, in fixed width and with one shuffle.

    Some occurrence is canonical if one of its symbol's deciding bits is among all their own roles together.
    """
    own = raw.repartition("l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.bit_or(F.expr("own | rel_roles | rel2_roles")).alias("all_roles"), F.bit_or("own").alias("own"))
    roles = F.expr(f"all_roles | case when (own & deciding) <> 0 then {_CANON} else 0 end").alias("roles")
    return own.join(facts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "usr", "name", "kind", "language", "properties", roles)


def _view(spark: SparkSession, text: str, frames: dict[str, DataFrame]) -> DataFrame:
    text = text.replace(" DIV ", " div ").replace("DAYS(o_orderdate)", "cast(unix_date(cast(o_orderdate as date)) as bigint)").replace("DAYS(ts)", "cast(unix_date(cast(ts as date)) as bigint)")
    used = {t: df for t, df in frames.items() if f" {t} " in f" {text.replace('(', ' ').replace(')', ' ')} "}
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def _relation(n: str) -> Column:
    return F.struct(F.col(f"{n}_usr").alias("usr"), F.col(f"{n}_roles").alias("roles"))


def _occurrences(spark: SparkSession, lines: DataFrame, part: DataFrame) -> DataFrame:
    both = spark.sql(f"select {_columns('m_raw', 'lineitem')}, {_columns('m_sym', 'part')} from {{lines}} join {{part}} on l_partkey = p_partkey".replace(" DIV ", " div "), lines=lines, part=part)
    return spark.sql(VIEWS["m_occ"].replace("m_raw join m_sym on l_partkey = p_partkey", "{both}"), both=both).select(
        "record_name", F.col("line").alias("ord"), "line", "col", "usr", "roles", F.array_compact(F.array(_relation("rel"), F.when(F.col("rel2_usr").isNotNull(), _relation("rel2")))).alias("relations")
    )


def _record_symbols(found: DataFrame) -> DataFrame:
    record = F.expr("concat('rec-', cast(l_orderkey as string))").alias("record_name")
    return found.select(record, "usr", "name", "kind", F.lit("none").alias("sub_kind"), "properties", "language", F.lit("").alias("codegen_name"), "roles", F.coalesce("related_roles", F.lit(0).cast("long")).alias("related_roles"))


def _keys(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """(of): the numbers in names that are made of a prefix and a number."""
    return names.select(column, F.expr(f"try_cast(substring({column}, {len(prefix) + 1}) as bigint)").alias("of")).filter(f"{column} = concat('{prefix}', cast(of as string))").select("of")


def _of_units(spark: SparkSession, orders: DataFrame, lineitem: DataFrame, names: DataFrame, once: Once) -> tuple[DataFrame, DataFrame]:
    """unit_deps and unit_includes of some units: their orders are chosen by key, once for both."""
    wanted = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    frames = {"orders": once(wanted.join(_keys(names, "unit_name", "unit-"), F.col("o_orderkey") == F.col("of"), "left_semi")), "lineitem": lineitem}
    for name in ("m_units", "m_deps", "m_inc"):
        frames[name] = _view(spark, VIEWS[name], frames)
    return frames["m_deps"], _includes(frames["m_inc"])


def _includes(found: DataFrame) -> DataFrame:
    return found.withColumn("ord", F.col("line"))


def _of_records(spark: SparkSession, lineitem: DataFrame, part: DataFrame, names: DataFrame, once: Once) -> tuple[DataFrame, DataFrame]:
    """record_symbols and occurrences of some records: lines are chosen by their key, once for both, and lie by their part from then on.

    What is united is the roles of a symbol in its record, and apart from them those of relations to it.
    """
    wanted = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    lines = once(wanted.join(_keys(names, "record_name", "rec-"), F.col("l_orderkey") == F.col("of"), "left_semi"))
    raw = spark.sql(f"select l_orderkey, {_columns('m_raw', 'lineitem')} from {{lines}}".replace(" DIV ", " div "), lines=lines)
    facts, n, zero = _facts(spark, part), int(spark.conf.get("spark.sql.shuffle.partitions")), F.lit(0).cast("long")
    is_part = lambda df: df.repartition(n, "l_partkey").join(facts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    own = raw.select("l_orderkey", "l_partkey", "own", F.expr("own | rel_roles | rel2_roles").alias("all_roles"))
    own = is_part(own).select("l_orderkey", "l_partkey", F.expr(f"all_roles | case when (own & deciding) <> 0 then {_CANON} else 0 end").alias("roles"), zero.alias("related_roles"), F.lit(True).alias("is_own"))
    # Of the lines of parts, relations to parts.
    to = F.expr("filter(transform(array(struct(rel_usr as usr, rel_roles as roles), struct(rel2_usr as usr, rel2_roles as roles)), r -> struct(case when startswith(r.usr, 's:p') then cast(substring(r.usr, 4) as bigint) end as key, r.roles as roles)), r -> r.key is not null)")
    related = is_part(raw.select("l_orderkey", "l_partkey", to.alias("to")).filter("size(to) > 0")).select("l_orderkey", F.explode("to").alias("r"))
    related = related.select("l_orderkey", F.col("r.key").alias("l_partkey"), zero.alias("roles"), F.col("r.roles").alias("related_roles"), F.lit(False).alias("is_own")).repartition(n, "l_partkey")
    # Both lie by part, and so does their union: nothing is shuffled for the groups or the facts.
    united = own.unionByName(related).groupBy("l_orderkey", "l_partkey").agg(F.bit_or("roles").alias("roles"), F.bit_or("related_roles").alias("related_roles"), F.max("is_own").alias("is_own")).filter("is_own")
    symbols = united.join(facts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    return _record_symbols(symbols), _occurrences(spark, lines, part)


def load(spark: SparkSession, sf_dir: str) -> CodeIndex:
    """The index over the driver's tables. Only columns that a query needs reach its scans.

    Joins and aggregations of lineitem go by its keys as they are; texts are made behind them, so that they aren't shuffled.
    """
    frames: dict[str, DataFrame] = {t: spark.read.parquet(str(Path(sf_dir) / f"{t}.parquet")) for t in ("orders", "lineitem", "part", "events")}
    for name, text in VIEWS.items():
        if name in ("m_raw", "m_sym", "m_occ", "m_recsym", "m_rel"):
            continue
        frames[name] = _view(spark, text, frames)
    lineitem, part = frames["lineitem"], frames["part"]
    raw = spark.sql(f"select l_orderkey, {_columns('m_raw', 'lineitem')} from {{lines}}".replace(" DIV ", " div "), lines=lineitem)
    facts = _facts(spark, part)
    # Only parts are symbols of records, so relations to suppliers are none of theirs.
    known = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    related = spark.sql(f"select l_orderkey, {_columns('m_raw', 'lineitem')} from {{lines}}".replace(" DIV ", " div "), lines=known)
    related = related.select("l_orderkey", F.inline(F.array(_relation("rel"), _relation("rel2")))).filter("startswith(usr, 's:p')").groupBy("l_orderkey", "usr").agg(F.bit_or("roles").alias("related_roles"))
    # The sizes of files say little of the rows in them: no side of such a join is broadcast.
    symbols = _record_symbols(_symbols(raw, facts).join(related.hint("merge"), ["l_orderkey", "usr"], "left"))
    units = frames["m_units"].select(
        "unit_name", "mod_time_ns", "out_file", "main_file", "has_main_file", F.lit("").alias("sysroot"), F.lit("arm64").alias("target"), F.lit("main").alias("module_name"), F.lit("/").alias("work_dir"),
        "is_system", F.lit(False).alias("is_module"), F.lit(True).alias("is_debug"), F.lit("swift").alias("provider_kind"), F.lit("").alias("provider_version"),
    )
    occurrences = _occurrences(spark, lineitem, part)
    tables = frames["m_deps"], _includes(frames["m_inc"]), symbols, occurrences
    source = Source(tables, lambda names, once: _of_units(spark, frames["orders"], lineitem, names, once), lambda names, once: _of_records(spark, lineitem, part, names, once))
    return CodeIndex(units, *tables, frames["m_stats"], source=source)
