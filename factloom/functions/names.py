"""Names, enumerations and patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of directions, roles, view kinds and accesses.
DIRECTIONS = {
    "input": "input", "in": "input", "output": "output", "out": "output", "inout": "inout", "bidir": "inout", "bidirectional": "inout",
    "internal": "internal", "feedthru": "feedthrough", "feedthrough": "feedthrough",
}
ROLES = {
    "signal": "signal", "clock": "clock", "clk": "clock", "reset": "reset", "power": "power", "primary_power": "power", "internal_power": "power", "backup_power": "power",
    "ground": "ground", "primary_ground": "ground", "internal_ground": "ground", "analog": "analog", "tie": "tie", "tie_high": "tie", "tie_low": "tie",
}
VIEW_KINDS = {
    "sv": "rtl", "systemverilog": "rtl", "verilog": "rtl", "lib": "liberty", "pinmap": "csv", "pin_map": "csv", "pin-map": "csv", "ip_xact": "ipxact", "ip-xact": "ipxact", "spirit": "ipxact",
    "c_header": "header", "c-header": "header", "cheader": "header", "software": "header", "spice": "cdl", "sp": "cdl", "circuit": "cdl", "gdsii": "gds", "gds2": "gds", "stream": "gds",
    "rdl": "systemrdl", "system_rdl": "systemrdl", "system-rdl": "systemrdl", "conn": "connectivity", "connectivity_spec": "connectivity", "connectivity-spec": "connectivity",
}
ACCESSES = {"ro": "readonly", "read": "readonly", "wo": "writeonly", "write": "writeonly", "rw": "readwrite"}
GROUNDS, POWERS = ("vss", "gnd", "vssa", "vssd", "vssio", "vgnd"), ("vdd", "vcc", "vdda", "vddd", "vddio", "vpwr")


def lookup(table: dict[str, str], key: Column, other: Column) -> Column:
    """A literal map; constant-folded."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), other)


def direction(c: Column, other: str | None = "unknown") -> Column:
    return lookup(DIRECTIONS, F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "-_", ""), F.lit(other).cast("string"))


def role(c: Column, other: str | None = "unknown") -> Column:
    return lookup(ROLES, F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "-", "_"), F.lit(other).cast("string"))


def view_kind(c: Column) -> Column:
    """The kind that a kind's other spellings stand for."""
    key = F.lower(F.trim(c))
    return lookup(VIEW_KINDS, key, key)


def access(c: Column) -> Column:
    key = F.translate(F.lower(F.trim(c)), "-_", "")
    return F.when(c.isNotNull(), lookup(ACCESSES, key, key))


def decoded(c: Column) -> Column:
    """An identifier without the escape of its language: a leading backslash."""
    return F.when(F.trim(c).startswith("\\"), F.rtrim(F.substring(F.trim(c), 2, 1 << 30))).otherwise(F.trim(c))


def register_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(decoded(c))), "_reg$", "")


#: In order: a role, whole names, first words, words anywhere.
ROLE_RULES = (
    ("ground", GROUNDS, ("vss", "gnd"), ()),
    ("power", POWERS, ("vdd", "vcc", "vpwr"), ()),
    ("clock", (), (), ("clk", "clock")),
    ("reset", (), (), ("rst", "reset", "rstn", "resetn")),
)


def role_from_name(c: Column) -> Column:
    """The first role whose rule a name fits; a hint only: callers mark it as tainted."""
    name = F.lower(F.trim(F.translate(c, "\\-", " _")))
    words = F.filter(F.split(name, "[_/]+"), lambda w: w != "")
    out = F.lit("unknown")
    for role, whole, first, anywhere in reversed(ROLE_RULES):
        some = F.arrays_overlap(words, F.array(*map(F.lit, anywhere))) if anywhere else F.lit(False)
        fits = name.isin(*whole) | F.coalesce(F.get(words, F.lit(0)).isin(*first), F.lit(False)) | some
        out = F.when(fits, role).otherwise(out)
    return out


def hinted(ports: DataFrame) -> DataFrame:
    """Ports whose source says no role get the one that their name hints at, tainted: it is shown, never judged."""
    told, hint = role(F.col("role")) != "unknown", role_from_name(F.coalesce("native_name", F.lit("")))
    states = F.map_concat(F.map_filter(F.coalesce("field_states", F.create_map().cast("map<string,string>")), lambda k, _: k != "role"), F.create_map(F.lit("role"), F.lit("tainted")))
    use = ~told & (hint != "unknown")
    return ports.withColumns({"role": F.when(use, hint).otherwise(F.col("role")), "field_states": F.when(use, states).otherwise(F.col("field_states"))})


def variants(name: Column, scope: Column | None = None) -> Column:
    """All spellings of a hierarchical name: with / and with ., with and without its scope."""
    strip = lambda c: F.trim(F.trim(decoded(c)), F.lit("/"))
    raw = strip(name)
    out = F.array(raw, F.translate(raw, ".", "/"))
    if scope is not None:
        s = F.coalesce(strip(scope), F.lit(""))
        within = F.concat(out, F.transform(out, lambda v: F.concat(s, F.lit("/"), v)))
        bare = F.transform(F.filter(within, lambda v: v.startswith(F.concat(s, F.lit("/")))), lambda v: F.substring(v, F.length(s) + 2, F.length(v)))
        out = F.when(s != "", F.concat(within, bare)).otherwise(out)
    out = F.concat(out, F.transform(out, lambda v: F.translate(v, "/", ".")))
    return F.array_distinct(F.filter(out, lambda v: v.isNotNull() & (v != "")))


def glob_regex(c: Column) -> Column:
    """A shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored Java pattern.

    Characters are quoted first; brackets that close become classes again.
    """
    q = F.regexp_replace(c, r"([\\^$.|+(){}&~#\-])", r"\\$1")
    q = F.regexp_replace(q, r"\[(?![^\]]+\])", r"\\[")
    q = F.regexp_replace(q, r"\[!", "[^")
    q = F.regexp_replace(q, r"(\[[^\]]*\])|\*", "$1\u0000")
    q = F.regexp_replace(q, "(\\[[^\\]]*\\])\u0000", "$1")
    q = F.regexp_replace(F.translate(q, "\u0000", "\u0001"), "\u0001", ".*")
    q = F.regexp_replace(q, r"(\[[^\]]*\])|\?", "$1\u0000")
    q = F.regexp_replace(q, "(\\[[^\\]]*\\])\u0000", "$1")
    q = F.regexp_replace(q, "\u0000", ".")
    q = F.regexp_replace(q, r"(\[[^\]]*)\\-([^\]]*\])", "$1-$2")
    return F.concat(F.lit("(?s)\\A"), q, F.lit("\\z"))


def glob(text: Column, pattern: Column) -> Column:
    return F.when(pattern.rlike(r"[*?\[]"), F.regexp_like(text, glob_regex(pattern))).otherwise(text == pattern)


def selector_rank(view: Column, kind: Column, selector: Column) -> Column:
    """How exactly a selector names a view: 0 the view, 1 its kind, 2 a pattern, 3 any; null if it doesn't."""
    s = F.lower(F.trim(selector))
    return F.when(s == F.lower(view), 0).when((s == kind) | (view_kind(s) == view_kind(kind)), 1).when(s == "*", 3).when(glob(F.lower(view), s), 2)


def state_for(field: str) -> Column:
    """The state of a port's field: its row's status if not known, what the field says, unknown for an unknown value."""
    stated = F.element_at("field_states", field)
    absent = {"direction": F.coalesce(F.col("direction"), F.lit("unknown")) == "unknown", "role": F.coalesce(F.col("role"), F.lit("unknown")) == "unknown", "shape": F.col("width").isNull()}[field]
    return F.when(F.coalesce("status", F.lit("known")) != "known", F.col("status")).when(stated.isNotNull(), stated).when(absent, "unknown").otherwise("known")


def safe_regexp(pattern: str) -> str | None:
    """The pattern if it is of the small class that is searched for: no groups, alternatives, counts or back references."""
    bare = re.sub(r"\\\D|\[(?:\\.|[^\[\]])+\]", "x", pattern)
    if len(pattern) > 512 or re.search(r"[(){}|+\[\]\\]|(?<!^)\^|\$(?!$)|^\^?[*?]|[*?][*?]", bare) or bare.count("*") > 2 or bare.count("?") > 8:
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern
