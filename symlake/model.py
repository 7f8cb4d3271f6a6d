"""Schemas and code tables of the code-index model."""

from __future__ import annotations

from pyspark.sql import types as T

ROLES = {
    "decl": 1, "def": 2, "ref": 4, "read": 8, "write": 16, "call": 32, "dyn": 64, "addrOf": 128, "implicit": 256, "childOf": 512, "baseOf": 1024, "overrideOf": 2048,
    "recBy": 4096, "calledBy": 8192, "extendedBy": 16384, "accessorOf": 32768, "contBy": 65536, "ibTypeOf": 131072, "specializationOf": 262144,
}
CANONICAL, UNDEFINITION, ALL_ROLES = -(1 << 63), 1 << 19, -1
DECL, DEF, REF, CALL, DYNAMIC, CHILD_OF, BASE_OF, OVERRIDE_OF, RECEIVED_BY, CALLED_BY, EXTENDED_BY = (ROLES[r] for r in ("decl", "def", "ref", "call", "dyn", "childOf", "baseOf", "overrideOf", "recBy", "calledBy", "extendedBy"))
PROPERTIES = {
    "generic": 1, "templatePartialSpecialization": 2, "templateSpecialization": 4, "unitTest": 8, "ibAnnotated": 16, "ibOutletCollection": 32, "gkInspectable": 64,
    "local": 128, "protocolInterface": 256, "swiftAsync": 65536,
}
UNIT_TEST, ACCESS_MASK = 8, 0xE0000
ACCESS = {"lessThanFilePrivate": 1 << 17, "fileprivate": 1 << 18, "internal": 3 << 17, "package": 1 << 19, "spi": 5 << 17, "public": 6 << 17}
CALLABLE = ("function", "instanceMethod", "classMethod", "staticMethod", "constructor", "destructor", "conversionFunction")
DECLARED_CANONICAL = ("class", "extension", "instanceProperty", "classProperty")
#: Symbol kinds that can be searched by kind; the importer files C++ structs under class.
KIND_BUCKETS = ("class", "protocol", "function", "struct", "union", "enum", "typealias", "variable", "commentTag", "concept")
#: Codes of the raw store. What isn't here (using declarations, the read and modify accessors) has no counterpart: it becomes unknown, none, or the language C.
RAW_KINDS = {0: "unknown", 1: "module", 2: "namespace", 3: "namespaceAlias", 4: "macro", 5: "enum", 6: "struct", 7: "class", 8: "protocol", 9: "extension", 10: "union", 11: "typealias", 12: "function", 13: "variable", 14: "field", 15: "enumConstant", 16: "instanceMethod", 17: "classMethod", 18: "staticMethod", 19: "instanceProperty", 20: "classProperty", 21: "staticProperty", 22: "constructor", 23: "destructor", 24: "conversionFunction", 25: "parameter", 27: "concept", 1000: "commentTag"}
RAW_SUB_KINDS = {1: "cxxCopyConstructor", 2: "cxxMoveConstructor", 3: "accessorGetter", 4: "accessorSetter"} | dict(enumerate("swiftAccessorWillSet swiftAccessorDidSet swiftAccessorAddressor swiftAccessorMutableAddressor swiftExtensionOfStruct swiftExtensionOfClass swiftExtensionOfEnum swiftExtensionOfProtocol swiftPrefixOperator swiftPostfixOperator swiftInfixOperator swiftSubscript swiftAssociatedType swiftGenericTypeParam".split(), 1000))
RAW_LANGUAGES = {0: "c", 1: "objc", 2: "cxx", 100: "swift"}


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "relations": T.ArrayType(T.StructType().add("usr", "string").add("roles", "long"))}


def _struct(text: str) -> T.StructType:
    """A schema from name and type pairs; no session is needed."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(", "))])


SCHEMAS = {
    "units": _struct("unit_name string, mod_time_ns long, out_file string, main_file string, has_main_file boolean, sysroot string, target string, module_name string, work_dir string, is_system boolean, is_module boolean, is_debug boolean, provider_kind string, provider_version string"),
    "unit_deps": _struct("unit_name string, ord int, kind string, name string, path string, module_name string, is_system boolean"),
    "unit_includes": _struct("unit_name string, ord int, source_path string, line int, target_path string"),
    "record_symbols": _struct("record_name string, usr string, name string, kind string, sub_kind string, properties long, language string, codegen_name string, roles long, related_roles long"),
    "occurrences": _struct("record_name string, ord int, line int, col int, usr string, roles long, relations relations"),
}
#: Of a store: files once seen, what was told to delegates, triggers of units that are out of date.
FILES = _struct("path string")
TOLD = _struct("snapshot long, ord int, kind string, n long, unit_name string, main_file string, out_file string, mod_time_ns long, trigger_path string, trigger_ns long, synchronous boolean")
TRIGGERS = _struct("unit_name string, path string, trigger_ns long")
EVENTS = _struct("seq long, kind string, unit_name string, is_initial boolean, is_dependency boolean, ignore_mod_time boolean")
