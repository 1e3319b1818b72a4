"""Checks as text: unordered pairs, their quoting, and simplified forms without call arguments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pair(a: Column, b: Column) -> Column:
    """struct(op1, op2) of an unordered pair: case-insensitive order, then case-sensitive; a missing operand is last."""
    swap = (b.isNotNull()) & (a.isNull() | (F.lower(b) < F.lower(a)) | ((F.lower(b) == F.lower(a)) & (b < a)))
    return F.struct(F.when(swap, b).otherwise(a).alias("op1"), F.when(swap, a).otherwise(b).alias("op2"))


def pair_text(p: Column) -> Column:
    """`` `a` `` or ``{`a`, `b`}``; a back-tick in an operand is an error."""
    bad = F.contains(F.concat_ws("", p["op1"], p["op2"]), F.lit("`"))
    q = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    out = F.when(p["op2"].isNull(), q(p["op1"])).otherwise(F.concat(F.lit("{"), q(p["op1"]), F.lit(", "), q(p["op2"]), F.lit("}")))
    return F.when(bad, F.raise_error(F.lit("a value holds a back-tick"))).otherwise(out)


def parse_pair(text: Column) -> Column:
    ops = F.regexp_extract_all(text, F.lit("`([^`]*)`"), F.lit(1))
    return pair(F.get(ops, F.lit(0)), F.get(ops, F.lit(1)))


def split_arguments(text: str) -> list[str]:
    """Top-level arguments of the inside of a call's parentheses; quotes, <signatures> and brackets nest."""
    out, depth, angle, quoted, start = [], 0, False, False, 0
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif c == "<" and not angle and (depth, i) >= (0, 0) and text[i : i + 2] not in ("<<", "<=", "< "):
            angle = True
        elif c == ">" and angle:
            angle = False
        elif angle:
            continue
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    tail = text[start:].strip()
    return [*out, tail] if tail or out else []


def split_call(text: str) -> tuple[str, str, str] | None:
    """Signature, inside of the parentheses, and rest of a call `<sig>(args)rest`; None if it is no call."""
    if not text.startswith("<") or ">" not in text or "(" not in text:
        return None
    end = text.index(">") + 1
    depth, quoted = 0, False
    for i in range(end, len(text)):
        c = text[i]
        if c == '"':
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
        if depth == 0:
            return (text[:end], text[end + 1 : i], text[i + 1 :]) if i > end else (text[:end], "", text[end:])
    return text[:end], "", ""


def simplify(text: str | None, keep: dict[str, tuple[int, ...]] | None = None) -> str | None:
    """A check's operand without call arguments; `keep` gives, by signature, the positions (from 1) that stay."""
    call = split_call(text) if text is not None else None
    if call is None:
        return text
    signature, inside, rest = call
    wanted = (keep or {}).get(signature)
    if not wanted:
        return signature + rest
    args = split_arguments(inside)
    shown, last = [], 0
    for p in wanted:
        if p > last + 1:
            shown.append("...")
        shown.append(args[p - 1] if p <= len(args) else "ALL")
        last = p
    if last < len(args):
        shown.append("...")
    return f"{signature}({', '.join(shown)}){rest}"


def simplified(x: Column, keep: dict[str, tuple[int, ...]] | None = None) -> Column:
    """simplify() as a Column: calls without nested parentheses by pattern, the others by an Arrow UDF."""
    def slow(s: pd.Series) -> pd.Series:
        return s.map(lambda t: simplify(t, keep), na_action="ignore")

    udf = F.pandas_udf(slow, T.StringType())
    plain = ~(F.startswith(x, F.lit("<")) & F.contains(x, F.lit("(")))
    return udf(x) if keep else F.when(plain, x).when(x.rlike(r"^<[^>]*>\([^()\"]*\)[^()]*$"), F.regexp_replace(x, r"^(<[^>]*>)\([^()]*\)", "$1")).otherwise(udf(x))


def value_masked(x: Column, signature: str) -> Column:
    """Arguments of calls to `signature` as ALL."""
    def mask(s: pd.Series) -> pd.Series:
        def one(t):
            call = split_call(t)
            if call is None or call[0] != signature:
                return t
            return f"{call[0]}({', '.join(['ALL'] * len(split_arguments(call[1])))}){call[2]}"

        return s.map(one, na_action="ignore")

    return F.pandas_udf(mask, T.StringType())(x)


# Calls of which a comparison with a constant says no more than the call itself.
PERMISSION_CALLS = (
    "<com.android.server.pm.PackageManagerService: int checkUidPermission(java.lang.String,int)>",
    "<com.android.server.pm.PackageManagerService: int checkPermission(java.lang.String,java.lang.String,int)>",
    "<android.app.ApplicationPackageManager: int checkSignatures(java.lang.String,java.lang.String)>",
    "<com.android.server.pm.PackageManagerService: int checkSignatures(java.lang.String,java.lang.String)>",
    "<android.app.AppOpsManager: int checkOpNoThrow(int,int,java.lang.String)>",
    "<android.app.AppOpsManager: int noteOpNoThrow(int,int,java.lang.String)>",
    "<android.app.AppOpsManager: int permissionToOpCode(java.lang.String)>",
    "<com.android.server.am.ActivityManagerService$IntentFirewallInterface: int checkComponentPermission(java.lang.String,int,int,int,boolean)>",
    "<com.android.server.pm.PackageManagerService: int checkUidSignatures(int,int)>",
    "<com.android.server.firewall.IntentFirewall$AMSInterface: int checkComponentPermission(java.lang.String,int,int,int,boolean)>",
    "<com.android.server.AppOpsService: int noteOperation(int,int,java.lang.String)>",
    "<com.android.server.AppOpsService: int startOperation(android.os.IBinder,int,int,java.lang.String)>",
    "<com.android.server.AppOpsService: int checkOperation(int,int,java.lang.String)>",
    "<android.content.pm.PackageManager: int checkSignatures(java.lang.String,java.lang.String)>",
)


def unwrap_permission_check(op1: Column, op2: Column, calls: tuple[str, ...] = PERMISSION_CALLS) -> Column:
    """The operand that calls one of `calls`, if the other one is a constant number; null for other pairs."""
    number = lambda x: x.rlike(r"^-?\d+(\.\d+)?$")
    listed = lambda x: F.exists(F.array(*[F.lit(c) for c in calls]), lambda c: F.contains(x, c))
    return F.when(number(op1) & listed(op2), op2).when(listed(op1) & number(op2), op1)
