"""Scalar predicates and functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from symlake.model import ACCESS, ACCESS_MASK, CALLABLE, CANONICAL, DECL, DECLARED_CANONICAL, DEF, PROPERTIES, RAW_KINDS, RAW_LANGUAGES, RAW_SUB_KINDS, ROLES, UNDEFINITION

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(roles: Column | str, mask: int) -> Column:
    """Some bit of mask is set. A mask of 0 is a mistake of the caller."""
    if not mask:
        raise ValueError("an empty role set matches nothing")
    return col(roles).bitwiseAND(F.lit(mask)) != 0


def all_of(roles: Column | str, mask: int) -> Column:
    return col(roles).bitwiseAND(F.lit(mask)) == mask


def minus(roles: Column | str, mask: int) -> Column:
    return col(roles).bitwiseAND(F.bitwise_not(F.lit(mask)))


def with_canonical(roles: Column | str, kind: Column | str, language: Column | str) -> Column:
    """roles with the canonical bit where the declaration (some Objective-C kinds) or definition is."""
    declared = (col(language) == "objc") & col(kind).isin(*DECLARED_CANONICAL)
    deciding = F.when(declared, F.lit(DECL)).otherwise(F.lit(DEF))
    return F.when(col(roles).bitwiseAND(deciding) != 0, col(roles).bitwiseOR(F.lit(CANONICAL))).otherwise(col(roles))


def is_callable(kind: Column | str) -> Column:
    return col(kind).isin(*CALLABLE)


def name_searchable(kind: Column | str, language: Column | str) -> Column:
    return ~((col(language) == "swift") & (col(kind) == "extension"))


def ascii_lower(x: Column | str) -> Column:
    return F.translate(col(x), UPPER, LOWER)


def _class(c: str) -> str:
    return "\\" + c if c in "\\]^-[&" else c


def subsequence_pattern(pattern: str, anchor_start: bool = False, anchor_end: bool = False) -> str:
    """The regular expression of the leftmost subsequence match; with anchor_end that match must use up the input."""
    parts = [("" if anchor_start and not i else f"[^{_class(c)}]*") + (re.escape(c) if not c.isalnum() else c) for i, c in enumerate(pattern)]
    return r"(?s)\A" + "".join(parts) + (r"\z" if anchor_end else "")


def matches(x: Column | str, pattern: str, anchor_start: bool = False, anchor_end: bool = False, subsequence: bool = False, ignore_case: bool = False) -> Column:
    """Name matching: substring with anchors, or subsequence. Case folding is that of ASCII."""
    text = ascii_lower(x) if ignore_case else col(x)
    if ignore_case:
        pattern = pattern.translate(str.maketrans(UPPER, LOWER))
    if subsequence:
        return text.rlike(subsequence_pattern(pattern, anchor_start, anchor_end)) if pattern else F.lit(False)
    if anchor_start and anchor_end:
        return text == pattern
    if anchor_start or anchor_end:
        return text.startswith(pattern) if anchor_start else text.endswith(pattern)
    return text.contains(pattern)


_WORDS = {
    "brackets": "decl def ref read write call dyn addrOf implicit childOf baseOf overrideOf recBy calledBy extendedBy accOf contBy ibTypeOf specializationOf",
    "raw": "declaration definition reference read write call dynamic addressOf implicit childOf baseOf overrideOf receivedBy calledBy extendedBy accessorOf containedBy ibTypeOf specializationOf",
    "short": "Decl Def Ref Read Writ Call Dyn Addr Impl RelChild RelBase RelOver RelRec RelCall RelExt RelAcc RelCont RelIBType RelSpecializationOf",
}


def role_words(style: str) -> dict[int, str]:
    """The bits that a vocabulary names, in its order."""
    words = dict(zip(ROLES.values(), _WORDS[style].split(), strict=True))
    if style == "raw":  # the only one that knows undefinitions; they stand after implicit ones
        items = list(words.items())
        at = items.index((ROLES["implicit"], "implicit")) + 1
        words = dict([*items[:at], (UNDEFINITION, "undefinition"), *items[at:]])
    return words | ({CANONICAL: "canon"} if style == "brackets" else {})


def role_text(roles: Column | str, style: str = "brackets") -> Column:
    """A role set in words: 'brackets' [a|b], 'raw' a, b or 'short' A,B. Only brackets show bits without a name, as a number."""
    r, words = col(roles), role_words(style)
    parts = [F.when(r.bitwiseAND(F.lit(bit)) != 0, F.lit(n)) for bit, n in words.items()]
    if style != "brackets":
        return F.array_join(F.array_compact(F.array(*parts)), "," if style == "short" else ", ")
    rest = r.bitwiseAND(F.bitwise_not(F.lit(sum(ROLES.values()) | CANONICAL)))
    # The last sign before the bracket is dropped as if it were a separator, also behind a number.
    parts.append(F.when(rest != 0, F.concat(F.lit("<<unknown roles "), rest.cast("string"), F.lit(">"))))
    return F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*parts)), "|"), F.lit("]"))


def properties_contain(p: Column | str, q: int) -> Column:
    """The access level, a field of three bits, is equal if q names one; all other bits of q are set."""
    level, rest = q & ACCESS_MASK, q & ~ACCESS_MASK
    has = all_of(p, rest) if rest else F.lit(True)
    return has & (col(p).bitwiseAND(F.lit(ACCESS_MASK)) == level) if level else has


def raw_properties_contain(p: Column | str, q: int) -> Column:
    """The raw layer's rule: an access level alone is compared as a field, other sets by any bit, and both together never match."""
    level, rest = q & ACCESS_MASK, q & ~ACCESS_MASK
    if level and rest:
        return F.lit(False)
    return col(p).bitwiseAND(F.lit(ACCESS_MASK)) == level if level else col(p).bitwiseAND(F.lit(rest)) != 0


def property_components(p: Column | str) -> Column:
    """The flags in order, then the access level as one, then what is left as a number."""
    level = col(p).bitwiseAND(F.lit(ACCESS_MASK))
    rest = col(p).bitwiseAND(F.bitwise_not(F.lit(sum(PROPERTIES.values()) | ACCESS_MASK)))
    parts = [F.when(col(p).bitwiseAND(F.lit(bit)) != 0, F.lit(n)) for n, bit in PROPERTIES.items()]
    parts += [F.when(level == bit, F.lit(n)) for n, bit in ACCESS.items()]
    parts += [F.when((level != 0) & ~level.isin(*ACCESS.values()), F.concat(F.lit("access:"), level.cast("string"))), F.when(rest != 0, rest.cast("string"))]
    return F.array_compact(F.array(*parts))


_PROPERTY_WORDS = dict(zip(PROPERTIES, "gen tps ts test ib ib_coll gki local protocol swift_async".split(), strict=True)) | {"lessThanFilePrivate": "less_than_fileprivate"}


def property_text(p: Column | str) -> Column:
    """[a|b]: the flags in short, the access level, and what is left as a number."""
    unknown = lambda x: F.concat(F.lit("<<unknown properties "), x, F.lit(">>"))
    word = lambda x: F.when(x.startswith("access:"), unknown(F.substring(x, 8, 20))).when(x.rlike("^-?[0-9]+$"), unknown(x)).otherwise(F.coalesce(F.element_at(names, x), x))
    names = F.create_map(*[F.lit(x) for pair in _PROPERTY_WORDS.items() for x in pair])
    return F.concat(F.lit("["), F.array_join(F.transform(property_components(p), word), "|"), F.lit("]"))


def kind_text(kind: Column | str) -> Column:
    """A kind with a hyphen between its words."""
    words = {"enumConstant": "enumerator", "conversionFunction": "conversion-func", "typealias": "typealias"}
    out = F.lower(F.regexp_replace(col(kind), "([a-z])([A-Z])", "$1-$2"))
    for k, text in words.items():
        out = F.when(col(kind) == k, F.lit(text)).otherwise(out)
    return out


def coded(x: Column | str, table: dict[int, str], otherwise: str) -> Column:
    """The name of a raw code; codes that the table doesn't hold are `otherwise`."""
    names = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(names, col(x).cast("int")), F.lit(otherwise))


def kind_of(raw: Column | str) -> Column:
    return coded(raw, RAW_KINDS, "unknown")


def sub_kind_of(raw: Column | str) -> Column:
    return coded(raw, RAW_SUB_KINDS, "none")


def language_of(raw: Column | str) -> Column:
    return coded(raw, RAW_LANGUAGES, "c")


def decoded(x: Column | str) -> Column:
    """Bytes as text; what isn't UTF-8 becomes the replacement sign."""
    return F.make_valid_utf8(col(x).cast("string"))


def parent_dir(path: Column | str) -> Column:
    return F.when(col(path).contains("/"), F.regexp_replace(F.regexp_extract(col(path), r"(?s)\A(.*)/[^/]*\z", 1), r"\A\z", "/")).otherwise(F.lit(""))


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def extension(path: Column | str) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]*)\z", 1)


def contains_path(directory: Column | str, path: Column | str) -> Column:
    """path is below directory: a prefix that ends at a separator."""
    d = F.regexp_replace(col(directory), r"(?<=.)/+\z", "")
    return col(path).startswith(F.concat(d, F.when(d == "/", F.lit("")).otherwise(F.lit("/"))))


def without_sysroot(path: Column | str, sysroot: Column | str) -> Column:
    return F.when((col(sysroot) != "") & contains_path(sysroot, path), F.substring(col(path), F.length(F.regexp_replace(col(sysroot), r"/+\z", "")) + 1, F.length(col(path)))).otherwise(col(path))


def absolute(path: Column | str, work_dir: Column | str) -> Column:
    return F.when(col(path).startswith("/"), col(path)).otherwise(F.concat_ws("/", work_dir, path))


def map_prefixes(path: Column | str, mappings: list[tuple[str, str]]) -> Column:
    """The first mapping whose prefix fits is applied; separators at the ends of prefixes don't count."""
    out, p = None, col(path)
    for old, new in mappings:
        fits = (p == old) | p.startswith(old.rstrip("/") + "/")
        to = F.concat(F.lit(new.rstrip("/")), F.substring(p, F.lit(len(old.rstrip("/")) + 1), F.length(p)))
        out = F.when(fits, to) if out is None else out.when(fits, to)
    return p if out is None else out.otherwise(p)


def is_swift(path: Column | str) -> Column:
    return col(path).rlike(r"\.swift(interface|module)?\z")


