"""The matcher language: S-expressions compiled to boolean Columns.

`(and (starts-with-package com.a) (not (regex-name-words `^get (a|b)$`)))`. Back-ticks quote arguments that hold
spaces or parentheses; a suffix `_i` makes a string operator ignore case. Null input never matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from checkloom.functions.text import signature_parts, split_class_words, split_words


class MatcherError(ValueError):
    """Malformed expression or unknown operator."""


@dataclass
class Node:
    op: str
    args: list = field(default_factory=list)  # str for leaves, Node for and / or / not

    def __str__(self) -> str:
        return "(" + " ".join([self.op, *(quote(a) if isinstance(a, str) else str(a) for a in self.args)]) + ")"


def quote(text: str) -> str:
    """The argument as the language writes it."""
    if "`" in text:
        raise MatcherError(f"a back-tick cannot be quoted: {text}")
    return f"`{text}`" if text == "" or any(c in text for c in " \t\n()") else text


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) tokens: open, close, word, quoted."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append(("open" if c == "(" else "close", c))
            i += 1
        elif c == "`":
            end = text.find("`", i + 1)
            if end < 0:
                raise MatcherError("unbalanced back-tick")
            out.append(("quoted", text[i + 1 : end]))
            i = end + 1
        else:
            j = i
            while j < len(text) and not text[j].isspace() and text[j] not in "()`":
                j += 1
            out.append(("word", text[i:j]))
            i = j
    return out


def parse(text: str) -> Node:
    """The expression's tree, by an explicit stack."""
    stack: list[Node] = []
    done: Node | None = None
    want_op = False
    for kind, value in tokens(text):
        if done is not None:
            raise MatcherError("text after the expression")
        if kind == "open":
            if want_op:
                raise MatcherError("an operator must follow (")
            want_op = True
        elif kind == "close":
            if want_op or not stack:
                raise MatcherError("unbalanced parentheses")
            node = stack.pop()
            if stack:
                stack[-1].args.append(node)
            else:
                done = node
        elif want_op:
            stack.append(Node(value))
            want_op = False
        elif stack:
            stack[-1].args.append(value)
        else:
            raise MatcherError("an expression begins with (")
    if done is None:
        raise MatcherError("unbalanced parentheses")
    return done


STRING_OPS: dict[str, Callable[[Column, str], Column]] = {
    "equal": lambda x, p: x == F.lit(p),
    "contain": lambda x, p: F.contains(x, F.lit(p)),
    "starts-with": lambda x, p: F.startswith(x, F.lit(p)),
    "ends-with": lambda x, p: F.endswith(x, F.lit(p)),
    "regex": lambda x, p: x.rlike(p),
}


def _string_op(op: str, x: Column, pattern: str) -> Column | None:
    base, ignore = (op[:-2], True) if op.endswith("_i") else (op, False)
    if base not in STRING_OPS:
        return None
    if ignore and base == "regex":
        return x.rlike("(?i)" + pattern)
    return STRING_OPS[base](F.lower(x) if ignore else x, pattern.lower() if ignore else pattern)


def _leaf_string(x: Column):
    def leaf(op: str, args: list[str]) -> Column | None:
        return _string_op(op, x, args[0]) if len(args) == 1 else None

    return leaf


def _leaf_member(signature: Column, name: Column, package: Column, cls: Column, full_class: Column):
    fields = {"name": name, "full-class": full_class, "class": cls, "package": package}

    def leaf(op: str, args: list[str]) -> Column | None:
        if op == "signature" and len(args) == 1:
            return signature == F.lit(args[0])
        if op == "regex-name-words" and len(args) == 1:
            return split_words(name).rlike(args[0])
        if op == "regex-class-words" and len(args) in (1, 2):
            words, at = split_class_words(cls), int(args[1]) if len(args) == 2 else -1
            return F.exists(words, lambda w: w.rlike(args[0])) if at < 0 else F.coalesce(F.get(words, F.lit(at)).rlike(args[0]), F.lit(False))
        base, ignore = (op[:-2], "_i") if op.endswith("_i") else (op, "")
        for suffix in ("full-class", "class", "package", "name"):
            if base.endswith("-" + suffix) and len(args) == 1:
                return _string_op(base[: -len(suffix) - 1] + ignore, fields[suffix], args[0])
        return None

    return leaf


# Numeric types of the language and the Spark type that carries each.
NUMBER_TYPES = {"integer": "int", "long": "bigint", "byte": "tinyint", "short": "smallint", "double": "double", "float": "float", "big-integer": "decimal(38,0)", "big-decimal": "decimal(38,18)", "atomic-integer": "int", "atomic-long": "bigint"}


def _leaf_number(value: Column, kind: Column | None):
    """`kind` names the value's own type; a literal of another type never equals it. NaN never matches."""
    def typed(name: str, test: Column) -> Column:
        return test if kind is None else (kind == F.lit(name)) & test

    def leaf(op: str, args: list[str]) -> Column | None:
        if op in ("integer-mask", "long-mask") and len(args) == 1:
            mask = 0
            for part in args[0].split("|"):
                mask |= int(part, 0)
            # the bits of the mask's type; a wider value is not cast to that, which could fail
            mask &= 0xFFFFFFFF if op == "integer-mask" else -1
            return typed(op[:-5], value.cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")) != 0)
        if op in NUMBER_TYPES and len(args) == 1:
            wanted = F.lit(args[0]).cast(NUMBER_TYPES[op])
            # a value that the type cannot hold is another number, with ANSI on or off
            same = value.try_cast(NUMBER_TYPES[op]) == wanted
            return typed(op, same & ~F.isnan(wanted) if op in ("double", "float") else same)
        return None

    return leaf


def compile_node(node: Node, leaf: Callable[[str, list[str]], Column | None]) -> Column:
    if node.op in ("and", "or", "not"):
        if not node.args or any(isinstance(a, str) for a in node.args) or (node.op == "not" and len(node.args) != 1):
            raise MatcherError(f"wrong operands of {node.op}")
        parts = [compile_node(a, leaf) for a in node.args]
        if node.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return out
    if any(isinstance(a, Node) for a in node.args):
        raise MatcherError(f"{node.op} takes text")
    out = leaf(node.op, node.args)
    if out is None:
        raise MatcherError(f"unknown operator or operands: {node}")
    return F.coalesce(out, F.lit(False))


def string_matcher(text: str, x: Column) -> Column:
    return compile_node(parse(text), _leaf_string(x)) & x.isNotNull()


type_matcher = string_matcher


def number_matcher(text: str, value: Column, kind: Column | None = None) -> Column:
    return compile_node(parse(text), _leaf_number(value, kind)) & value.isNotNull()


def member_matcher(text: str, signature: Column) -> Column:
    """Matcher on a method's or field's signature and the parts taken from it."""
    p = signature_parts(signature)
    leaf = _leaf_member(signature, p["name"], p["package"], p["class"], p["full_class"])
    return compile_node(parse(text), leaf) & signature.isNotNull()


def any_of(expressions: list[str]) -> str:
    return str(Node("or", [parse(e) for e in expressions]))


def all_of(expressions: list[str]) -> str:
    return str(Node("and", [parse(e) for e in expressions]))


def negated(expression: str) -> str:
    return str(Node("not", [parse(expression)]))
