"""Look-ups from the command line: `python -m checkloom.query -d [KEY;]folder [-e ep;ep] [-p base64 of a check] [--stats]`."""

from __future__ import annotations

import argparse
import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkloom.operators import lookup
from checkloom.session import session
from checkloom.sources import check_text, reports


def load(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Checks (key, stub, ep, op1, op2) of several folders of check files, `KEY;path` or a path, whose key is then empty."""
    parts = {}
    for f in folders:
        key, _, path = f.rpartition(";")
        parts[key] = check_text.read_checks(spark, path)
    return reports.keyed(parts)


def answer(checks: DataFrame, eps: list[str] | None = None, check: str | None = None, stats: bool = False) -> DataFrame:
    """Statistics, or the checks of some entry points, or the entry points of a check (`` `a` `` or ``{`a`, `b`}``)."""
    if stats:
        return lookup.statistics(checks.select("stub", "ep"), checks.where("op1 is not null"))
    out = checks.where("op1 is not null").withColumn("check", check_text.check_column())
    out = out if eps is None else out.where(F.col("ep").isin(eps))
    out = out if check is None else out.where(F.col("check") == check)
    return out.groupBy("stub", "ep", "check").agg(F.array_join(F.sort_array(F.collect_set("key")), "|").alias("keys")).orderBy("stub", "ep", "check")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-d", action="append", required=True, help="folder of check files, with KEY; before it if there are several")
    p.add_argument("-e", help="entry points, separated by ;")
    p.add_argument("-p", help="a check, base64-url")
    p.add_argument("--stats", action="store_true")
    a = p.parse_args(argv)
    check = base64.urlsafe_b64decode(a.p).decode() if a.p else None
    answer(load(session("query"), a.d), a.e.split(";") if a.e else None, check, a.stats).show(1000, truncate=False)


if __name__ == "__main__":
    main()
