"""Scalar text functions as Columns: word splitting, signatures, keys, padding, encodings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = r"^<([^:>]+): (\S+) ([^\s(]+)(?:\((.*)\))?>$"


def split_words(name: Column) -> Column:
    """Lower-case words of an identifier: at `_` if there is one, else at camel-case borders (acronyms stay whole)."""
    snake = F.trim(F.lower(F.regexp_replace(name, "_", " ")))
    camel = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2")
    # neighbours share a letter in runs such as ABc: the second pass meets what the first one left
    return F.when(F.contains(name, F.lit("_")), snake).otherwise(F.trim(F.lower(camel)))


def split_class_words(name: Column) -> Column:
    """Words of each part of a nested class name, innermost first."""
    return F.transform(F.reverse(F.split(name, r"\$")), split_words)


def signature_parts(sig: Column) -> Column:
    """struct(full_class, package, class, type, name, args) of `<pkg.Cls: type name(args)>`; null if it has not that form."""
    get = lambda i: F.regexp_extract(sig, SIGNATURE, i)
    cls = get(1)
    dotted = F.contains(cls, F.lit("."))
    package = F.when(dotted, F.regexp_extract(cls, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))
    args = F.when(get(4) == "", F.array().cast("array<string>")).otherwise(F.split(get(4), ","))
    return F.when(sig.rlike(SIGNATURE), F.struct(cls.alias("full_class"), package.alias("package"), F.substring_index(cls, ".", -1).alias("class"), get(2).alias("type"), get(3).alias("name"), args.alias("args")))


def case_order(x: Column) -> list[Column]:
    """Sort keys: case-insensitive, then case-sensitive, nulls first."""
    return [F.lower(x).asc_nulls_first(), x.asc_nulls_first()]


def member_order(sig: Column) -> list[Column]:
    """Sort keys of methods and fields: class, name, arguments, type; case-insensitive first; nulls first."""
    p = signature_parts(sig)
    return [k for x in (p["full_class"], p["name"], F.array_join(p["args"], ","), p["type"]) for k in case_order(x)]


def with_key(name: Column, key: Column) -> Column:
    return F.concat(name, F.lit("_"), key)


def key_of(name: Column) -> Column:
    """struct(name, key) of `name_KEY`, split at the last underscore."""
    cut = F.substring_index(name, "_", -1)
    return F.struct(F.substring(name, F.lit(1), F.length(name) - F.length(cut) - 1).alias("name"), cut.alias("key"))


def joined_keys(keys: Column) -> Column:
    return F.concat_ws("|", F.sort_array(keys))


def unbase64_url(x: Column) -> Column:
    return F.decode(F.unbase64(F.translate(x, "-_", "+/")), "UTF-8")


def pad_number(x: Column, digits: int) -> Column:
    return F.lpad(x.cast("string"), digits, "0")


def round_down(x: Column, digits: int) -> Column:
    """Decimal rounding toward zero."""
    m = 10**digits
    return F.signum(x) * F.floor(F.abs(x) * m) / m


def largest_remainder(values: list[float], total: int = 100) -> list[int]:
    """Whole shares of `total` that add up to it: floors, then one more for the largest remainders."""
    whole = sum(values)
    if not whole:
        return [0] * len(values)
    exact = [v * total / whole for v in values]
    out = [int(e) for e in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def abbreviate(x: Column, width: int) -> Column:
    """At most `width` characters, the last three as dots where some are left out."""
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, max(0, width - 3)), F.lit("..."))).otherwise(x)


def capitalize(x: Column) -> Column:
    """The first letter of each word in upper case, the others as they are."""
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def capitalize_fully(x: Column) -> Column:
    return F.initcap(F.lower(x))


def center(x: Column, width: int, fill: str = " ") -> Column:
    left = F.floor((F.lit(width) - F.length(x)) / 2).cast("int")
    return F.when(F.length(x) >= width, x).otherwise(F.rpad(F.concat(F.repeat(F.lit(fill), left), x), width, fill))


def left_pad(x: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, fill))


def right_pad(x: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(x) >= width, x).otherwise(F.rpad(x, width, fill))


def remove_end(x: Column, end: str) -> Column:
    return F.when(F.endswith(x, F.lit(end)), F.substring(x, F.lit(1), F.length(x) - len(end))).otherwise(x)


# Names of the primitive types.
PRIMITIVES = ("boolean", "byte", "char", "short", "int", "long", "float", "double")


def type_of_text(x: Column) -> Column:
    """struct(kind, base, dims) of a type's text: primitive, void, null or class, with [] as dimensions of an array."""
    base = F.regexp_replace(x, r"(\[\])+$", "")
    dims = ((F.length(x) - F.length(base)) / 2).cast("int")
    kind = F.when(base.isin(*PRIMITIVES), "primitive").when(base == "void", "void").when(base == "null_type", "null").otherwise("class")
    return F.struct(F.when(dims > 0, "array").otherwise(kind).alias("kind"), base.alias("base"), dims.alias("dims"))


def typed_value(x: Column, typ: str) -> Column:
    """A text as a value of a type (as its text again); null if it is none."""
    carrier = {"boolean": "boolean", "byte": "tinyint", "short": "smallint", "char": "int", "int": "int", "long": "bigint", "float": "float", "double": "double"}[typ]
    return x.try_cast(carrier).cast("string")


def sorted_entries(pairs: Column, by: str = "key", falling: bool = False) -> Column:
    """A map's entries as an array, by key or by value then key, rising or falling."""
    rows = F.transform(F.map_entries(pairs), lambda e: F.struct(*([e["value"].alias("value")] if by == "value" else []), e["key"].alias("key"), e["value"].alias("v")))
    return F.transform(F.sort_array(rows, asc=not falling), lambda e: F.struct(e["key"].alias("key"), e["v"].alias("value")))


def swap_case(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def initials(x: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(x, r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def contains_all_words(x: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & x.rlike(r"\b" + re.escape(w) + r"\b")
    return out


def wrap(x: Column, width: int) -> Column:
    """Lines of at most `width` characters, broken at spaces where there is one."""
    return F.rtrim(F.regexp_replace(x, rf"(.{{1,{width}}})(?:\s+|$)|(.{{{width}}})", "$1$2\n"))


def glob_to_regex(glob: str) -> str:
    """`**` is anything, `*` anything but a dot; capture groups number the wild cards for renames."""
    out = []
    for part in re.split(r"(\*\*|\*)", glob):
        out.append("(.+?)" if part == "**" else "([^.]+)" if part == "*" else re.escape(part))
    return "^" + "".join(out) + "$"


def rename(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Class names under (pattern, result) renames; @1.. in the result are the pattern's wild cards; the first fits."""
    out = x
    for pattern, result in reversed(rules):
        regex = glob_to_regex(pattern)
        out = F.when(x.rlike(regex), F.regexp_replace(x, regex, re.sub(r"@(\d)", r"$\1", result))).otherwise(out)
    return out


# Primitive codes of type descriptors.
DESCRIPTORS = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


def descriptor_to_type(x: Column) -> Column:
    """`[Lcom/a/B;` to `com.a.B[]`."""
    base, dims = F.regexp_replace(x, r"^\[+", ""), F.length(F.regexp_extract(x, r"^(\[*)", 1))
    name = F.when(F.startswith(base, F.lit("L")), F.regexp_replace(F.regexp_replace(base, "^L|;$", ""), "/", "."))
    for code, typ in DESCRIPTORS.items():
        name = F.when(base == code, typ).otherwise(name)
    return F.concat(name, F.repeat(F.lit("[]"), dims))


def depth_color(depth: Column, colors: tuple[str, ...] = ("red", "orange", "yellow", "green", "blue")) -> Column:
    """One color for each depth from 0; deeper ones have the last."""
    out = F.lit(colors[-1])
    for i in range(len(colors) - 2, -1, -1):
        out = F.when(depth == i, colors[i]).otherwise(out)
    return out


# Public platform API levels and the DEX format version of each.
DEX_VERSIONS = {13: "035", 24: "037", 26: "038", 28: "039", 30: "040", 34: "041"}


def dex_version(api: Column) -> Column:
    out = F.lit(None).cast("string")
    for level, version in sorted(DEX_VERSIONS.items()):
        out = F.when(api >= level, version).otherwise(out)
    return out
