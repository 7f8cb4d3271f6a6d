"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal them.

The patterns find e-mail addresses, IP addresses, card and phone numbers. Their values are the
protected entities, each of them, also one that a single document holds. A term's disclosure of an
entity is P(entity | term): of the documents that hold the term, the share that holds the entity too.
It is held against the entity's own rarity, pointwise mutual information as a share of the entity's
information content. A term that passes both thresholds tells a reader who knows the corpus which
entity was removed. It is a span in every document that holds it: generalised where some other term
could stand there (numbers, capitalised names), else removed. So a word that no other document has
is a span where it shares its document with an entity.

All of it is DataFrame functions. Positions come from the gaps between matches: a pattern's split and
its extraction together give every start in one pass over the gaps, without a collected window. Passes
over the matches of a text go in blocks, so their work grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.llm.common import broadcast_if_small, cut, prepare, stored

KINDS = ("email", "ip", "card", "phone")
#: A term discloses an entity if P(entity | term) reaches the one share and the information the other.
DISCLOSURE, INFORMATION = 0.8, 0.8
#: So many of the terms that are too common to disclose anything are broadcast, to keep them out of the shuffles.
COMMON = 50_000
#: Matches in a block of a pass, characters in a block of a text.
MATCHES, CHARS = 128, 4096
#: Buckets of the row filter that is broadcast: its size is bounded by this, not by the data.
ROW_BUCKETS = 1 << 18

# The same matches as the plain forms, without their backtracking: quantifiers are possessive where what
# follows can't be inside, and a match starts at the head of its run or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
_HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: A run of letters and digits, but for one or two small Latin letters.
TERM = r"(?<![\p{L}\p{N}])(?![a-z]{1,2}(?![\p{L}\p{N}]))[\p{L}\p{N}]++"


def _good(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<kind: string, start: int, end: int, value: string>>"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once: an array of one binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, kind: str, step, context=None) -> Column:
    """What step(at, item, c) -> (next at, array of kind) gives over the items, joined; at begins with 0; c is context(block) of the item's block. Null without items.

    In blocks: appending to one long array would copy it for every item.
    """
    none = F.array().cast(kind)

    def of_block(state: Column, block: Column) -> Column:
        def run(c: Column) -> Column:
            def one(inner: Column, x: Column) -> Column:
                at, out = step(inner["at"], x, c)
                return F.struct(at.cast("int").alias("at"), F.concat(inner["out"], out).alias("out"))

            done = F.aggregate(block, F.struct(state["at"].alias("at"), none.alias("out")), one)
            return bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

        return run(F.lit(0)) if context is None else bound(context(block), run)

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / MATCHES).cast("int")), lambda b: F.slice(xs, b * MATCHES + 1, F.lit(MATCHES)))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), of_block, lambda s: F.flatten(s["out"]))

    return F.when(F.size(items) > 0, bound(items, whole))


def _walk(text: Column, pattern: str, kind: str, good, context=None) -> Column:
    """The spans of the pattern's matches that are good(match, c), in order; the others are passed over and not tried again."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(at: Column, x: Column, c: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["match"].alias("value")))
        return end, F.when(good(x["match"], c), span).otherwise(F.array().cast(_SPANS))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"))
    return scan(pairs, _SPANS, step, context)


def _spans(text: Column, kind: str) -> Column:
    found = _walk(text, PATTERNS[kind], kind, lambda m, _: _good(kind, m))
    if kind in _HINTS:
        found = F.when(F.contains(text, F.lit(_HINTS[kind])), found)
    return F.coalesce(found, F.array().cast(_SPANS))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def redact(text: Column, spans: Column, blank: bool = False) -> Column:
    """The text with a mark in place of each span; overlapping spans share one. Terms: numbers and names are generalised, others removed. blank: as many blanks instead, so that places stay."""

    def mark(s: Column) -> Column:
        return (
            F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            .when(s["value"].rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).when(s["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit(""))
        )

    def step(at: Column, s: Column, _: Column) -> tuple[Column, Column]:
        put = F.repeat(F.lit(" "), (s["end"] - F.greatest(s["start"], at)).cast("int")) if blank else F.when(s["start"] >= at, mark(s)).otherwise(F.lit(""))
        piece = F.struct(at.alias("from"), F.greatest(s["start"] - at, F.lit(0)).alias("n"), put.alias("put"))
        return F.greatest(at, s["end"]), F.array(piece)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    pieces = scan(ordered, "array<struct<from: int, n: int, put: string>>", step)
    last = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("from"), (F.length(text) - F.array_max(F.transform(spans, lambda s: s["end"]))).alias("n"), F.lit("").alias("put"))

    def join(blocks: Column) -> Column:
        """A piece is looked for in the blocks it touches: finding a place in a long text would read all before it."""

        def cut_out(p: Column) -> Column:
            first = F.floor(p["from"] / CHARS).cast("int")
            n = (F.floor((p["from"] + p["n"] - 1) / CHARS) - first + 1).cast("int")
            there = F.when(p["n"] > 0, F.substring(F.array_join(F.slice(blocks, first + 1, F.greatest(n, F.lit(0))), ""), p["from"] - first * CHARS + 1, p["n"])).otherwise(F.lit(""))
            return F.concat(there, p["put"])

        return F.array_join(F.transform(F.concat(pieces, F.array(last)), cut_out), "")

    return F.when(F.size(spans) > 0, bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)), join)).otherwise(text)


def find(docs: DataFrame) -> DataFrame:
    """docs with two more columns, `spans` (kind, start, end, value; by kind as listed, then start) and `redacted`.

    docs needs text; its other columns stay as they are. Text null is taken as empty. Rows stand for
    themselves, so null and repeated doc_ids change nothing. Terms are read from what the patterns'
    spans leave of a text. An empty table gives no rows. Columns named spans or redacted are replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("spans", "redacted")
    columns = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"))
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    # Row numbers are fixed by the table; the patterns run once.
    found = stored(inner.withColumn("base", F.concat(*(_spans(text, k) for k in KINDS))).withColumn("row", F.monotonically_increasing_id()))
    of_row = cut(
        found.select("row", F.explode(F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))))).alias("entity"))
    )
    # Entities that the same documents hold (by 128 bits of hash) stand for each other: pairs with terms are made of one of them.
    held_by = of_row.groupBy("entity").agg(F.count("*").alias("de"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    entities = cut(held_by.groupBy("de", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "de"))
    n, most = found.count(), entities.agg(F.max("de")).first()[0]
    if most is None:
        return found.select(*(F.col("doc")[c].alias(c) for c in columns), F.col("base").alias("spans"), text.alias("redacted"))
    holds = found.select("row", (F.size("base") > 0).alias("held"), F.explode(_terms(redact(text, F.col("base"), blank=True))).alias("term"))
    # Counted in each task before the shuffle: what moves is bounded by the distinct terms.
    spread = cut(holds.groupBy("term").agg(F.count("*").alias("dt")))
    # dj <= de, so a term in more documents than de / DISCLOSURE discloses no entity that is in de.
    common = spread.filter(F.col("dt") * DISCLOSURE > most).orderBy(F.desc("dt"), "term").limit(COMMON).select("term")
    rest = holds.join(F.broadcast(cut(common)), "term", "left_anti")
    able = spread.filter(F.col("dt") * DISCLOSURE <= most)
    candidates = cut(rest.filter("held").select("row", "term").join(able, "term"))
    known = of_row.join(entities.filter(F.col("de") < n), "entity")
    # A term of one document is in all of what that document discloses; only terms of several are counted with entities.
    alone = candidates.filter("dt = 1").join(known.select("row").distinct(), "row", "left_semi").select("term", F.lit(0).cast("long").alias("beyond"))
    shared = (
        candidates.filter("dt > 1").join(known, "row").filter(F.col("dt") * DISCLOSURE <= F.col("de"))
        .groupBy("entity", "de", "term", "dt").agg(F.count("*").alias("dj"))
    )
    rarity = F.log2(n / F.col("de"))
    share = F.col("dj") / F.col("dt")
    several = shared.filter((share >= DISCLOSURE) & (F.log2(share * n / F.col("de")) >= INFORMATION * rarity)).groupBy("term").agg(F.max(F.col("dt") - F.col("dj")).alias("beyond"))
    telling = cut(several.unionByName(alone))
    # In documents without an entity, only terms that some such document holds are looked for.
    beyond = broadcast_if_small(cut(telling.filter("beyond > 0").select("term")))
    marked = cut(
        candidates.select("row", "term").join(telling, "term", "left_semi").unionByName(rest.filter("not held").select("row", "term").join(beyond, "term", "left_semi"))
        .groupBy("row").agg(F.collect_list("term").alias("terms"))
    )
    # Texts move only where their row can be among the marked ones.
    found = found.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(ROW_BUCKETS)))
    wanted = F.broadcast(cut(marked.select(F.pmod(F.xxhash64("row"), F.lit(ROW_BUCKETS)).alias("bucket")).distinct()))
    joined = found.join(wanted, "bucket", "left_semi").join(marked, "row", "left")
    masked = redact(text, F.col("base"), blank=True)
    # Of a block's words, those among the row's terms are found by hash.
    here = lambda block: F.array_intersect(F.transform(block, lambda x: F.lower(x["match"])), F.col("terms"))
    hits = F.when(F.size("terms") > 0, _walk(masked, TERM, "term", lambda m, own: F.array_contains(own, F.lower(m)), here))
    near = joined.select("doc", F.concat("base", F.coalesce(hits, F.array().cast(_SPANS))).alias("spans"))
    far = found.join(wanted, "bucket", "left_anti").select("doc", F.col("base").alias("spans"))
    whole = near.unionByName(far).withColumn("redacted", redact(text, F.col("spans")))
    return whole.select(*(F.col("doc")[c].alias(c) for c in columns), "spans", "redacted")


def digests(found: DataFrame) -> DataFrame:
    """The result of the query: doc_id, counts, base_sha256 and spans of find()'s rows."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of(k) for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *count, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
