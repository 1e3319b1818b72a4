"""Definitions and uses of locals: reaching definitions over each method's flow, and what aliases add to them.

A method's reaching definitions are a gen/kill problem over bit vectors, and which definitions lead to which over aliases
(`x = y`, `x = (T) y`, `x = a[i]`) is a closure over links. A method is small, so it is one row of arrays; Python gets batches
of methods.

Tables. flow: method, src, tgt (null behind a method's ends); defs: method, stmt, local, kind, source: what a statement
defines, kind "local", "cast" or "array" if it copies, casts or reads an element of the local `source`, anything else if it
makes a value; uses: method, stmt, local.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.operators.graph import components, union_all

ALIASES = ("local", "cast", "array")


def _bits(bits: int) -> list[int]:
    out = []
    while bits:
        out.append((bits & -bits).bit_length() - 1)
        bits &= bits - 1
    return out


def _solved(flow: list[tuple], defs: list[tuple]) -> tuple[list[tuple], dict[str, int], dict[int, int]]:
    """Definitions (stmt, local) in order, the bits of each local's, and the bits that reach the entry of each statement."""
    made = sorted(set(defs))
    of_local: dict[str, int] = {}
    gen: dict[int, int] = {}
    kill: dict[int, int] = {}
    for k, (_, v) in enumerate(made):
        of_local[v] = of_local.get(v, 0) | 1 << k
    for k, (s, v) in enumerate(made):
        gen[s] = gen.get(s, 0) | 1 << k
        kill[s] = kill.get(s, 0) | of_local[v]
    after: dict[int, set[int]] = {}
    for a, b in flow:
        after.setdefault(a, set()).add(b)
    come: dict[int, int] = {}
    todo = sorted(gen)
    while todo:
        s = todo.pop()
        out = come.get(s, 0) & ~kill.get(s, 0) | gen.get(s, 0)
        for t in after.get(s, ()):
            if out & ~come.get(t, 0):
                come[t] = come.get(t, 0) | out
                todo.append(t)
    return made, of_local, come


def _by_method(flow: DataFrame, defs: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """A row for each method: src, tgt of its flow; stmt, local, kind, source of its definitions; use, used of its uses."""
    long = lambda c: F.col(c).cast("long")
    none = lambda t: F.lit(None).cast(t)
    f, d, u = "struct<src:bigint,tgt:bigint>", "struct<stmt:bigint,local:string,kind:string,source:string>", "struct<use:bigint,used:string>"
    extra = [F.col(c) if c in defs.columns else none("string").alias(c) for c in ("kind", "source")]
    parts = [
        flow.where("src is not null and tgt is not null").select("method", F.struct(long("src").alias("src"), long("tgt").alias("tgt")).alias("f"), none(d).alias("d"), none(u).alias("u")),
        defs.where("stmt is not null and local is not null").select("method", none(f).alias("f"), F.struct(long("stmt").alias("stmt"), "local", *extra).alias("d"), none(u).alias("u")),
    ]
    if uses is not None:
        parts.append(uses.where("stmt is not null and local is not null").select("method", none(f).alias("f"), none(d).alias("d"), F.struct(long("stmt").alias("use"), F.col("local").alias("used")).alias("u")))
    one = union_all(parts).where("method is not null").groupBy("method").agg(*[F.collect_list(c).alias(c) for c in ("f", "d", "u")])
    return one.select("method", "f.src", "f.tgt", "d.stmt", "d.local", "d.kind", "d.source", "u.use", "u.used")


def _over_methods(rows: DataFrame, solve) -> DataFrame:
    """(method, stmt, local, def) of every method: `solve` takes its lists and gives (stmt, local, def)."""
    names = rows.columns[1:]

    def run(batches):
        # small methods often look alike
        solved = lru_cache(maxsize=1 << 14)(solve)
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for method, *lists in zip(b.column("method").to_pylist(), *[b.column(c).to_pylist() for c in names], strict=True):
                for s, v, k in solved(*map(tuple, lists)):
                    for column, x in zip(out, (method, s, v, k), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["method", "stmt", "local", "def"])

    return rows.mapInArrow(run, "method string, stmt long, local string, def long")


def reaching_definitions(flow: DataFrame, defs: DataFrame) -> DataFrame:
    """(method, stmt, local, def): the definitions of each local that reach the entry of each statement."""

    def solve(src, tgt, stmt, local, *_):
        made, _, come = _solved(zip(src, tgt, strict=True), zip(stmt, local, strict=True))
        return [(t, made[k][1], made[k][0]) for t, bits in come.items() for k in _bits(bits)]

    return _over_methods(_by_method(flow, defs.select("method", "stmt", "local")), solve)


def local_definitions(flow: DataFrame, defs: DataFrame, uses: DataFrame, aliases: bool = False, arrays: bool = False, remove: tuple[str, ...] = (), remove_uses: tuple[str, ...] = ()) -> DataFrame:
    """(method, stmt, local, def): the definitions of each used local where it is used. With `aliases` also those of the locals
    that these copy or cast, and so on (with `arrays` those of arrays they read from as well); `remove` names the kinds of
    aliasing definitions that are left out of the result, but not out of the way; `remove_uses` those of statements whose uses
    are. A method is one row, so definitions, aliases and uses meet within it, without a join."""
    kinds = (ALIASES if arrays else ALIASES[:2]) if aliases or arrays else ()

    def solve(src, tgt, stmt, local, kind, source, use, used):
        made, of_local, come = _solved(zip(src, tgt, strict=True), zip(stmt, local, strict=True))
        at = lambda s, v: {made[k][0] for k in _bits(come.get(s, 0) & of_local.get(v, 0))}
        gone = {s for s, k in zip(stmt, kind, strict=True) if k in remove}
        unused = {s for s, k in zip(stmt, kind, strict=True) if k in remove_uses}
        links: dict[int, set[int]] = {}
        for s, k, v in zip(stmt, kind, source, strict=True):
            if k in kinds and v is not None:
                links.setdefault(s, set()).update(at(s, v))
        out = []
        for s, v in set(zip(use, used, strict=True)):
            if s in unused:
                continue
            seen = at(s, v)
            stack = list(seen)
            while stack:
                for t in links.get(stack.pop(), ()):
                    if t not in seen:
                        seen.add(t)
                        stack.append(t)
            out += [(s, v, k) for k in seen if k not in gone]
        return out

    return _over_methods(_by_method(flow, defs, uses), solve)


def local_uses(flow: DataFrame, defs: DataFrame, uses: DataFrame, aliases: bool = False, arrays: bool = False, remove: tuple[str, ...] = ()) -> DataFrame:
    """(method, def, stmt, local): where what a statement defines is used, by itself or over aliases; `remove` names the kinds of
    aliasing statements that do not count as uses, but are followed."""
    found = local_definitions(flow, defs, uses, aliases, arrays, remove_uses=remove)
    return found.select("method", "def", "stmt", "local")


def may_aliases(defs: DataFrame, arrays: bool = False) -> DataFrame:
    """(method, local, alias_set): locals that copies and casts connect, wherever they stand, share the least of their names."""
    kinds = ALIASES if arrays else ALIASES[:2]
    key = lambda c: F.concat_ws("\x01", "method", c)
    every = defs.select("method", "local").union(defs.where("source is not null").select("method", "source")).distinct()
    linked = components(defs.where(F.col("kind").isin(*kinds) & F.col("source").isNotNull()).select(key("local").alias("a"), key("source").alias("b")))
    return every.withColumn("id", key("local")).join(linked, "id", "left").select("method", "local", F.coalesce(F.substring_index("component", "\x01", -1), "local").alias("alias_set"))
