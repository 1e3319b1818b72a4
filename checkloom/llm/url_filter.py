"""URL filters: rules first, then a character language-model ratio for the URLs that no rule fits.

Two smoothed variable-order Markov models over the characters of host and path, one of accepted and one of rejected
URLs, are counted over every URL on which a rule decides. A character's probability is interpolated from order ORDER
down to uniform (Witten-Bell). The score is the difference of the log-likelihoods for each character; its threshold is
calibrated on the held-out fifth of the decided URLs, balancing both error rates. Counts are exact: a table of contexts
and the characters after them, which grows with the corpus and is aggregated before the shuffle. URLs are scored by
chunks of so many rows or bytes: the distinct windows of a chunk are joined to their log-ratios, which are computed once for each
distinct window, order by order, so that a key has at most ALPHABET rows.

Cases: a null URL or one without `://` has empty host and path, no rule, score 0; very long URLs are scored whole;
repeated rows count as often as they occur; without any decided URL the models are uniform and every verdict is allow;
rows with a score at the threshold are allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkloom.llm.common import cut

ORDER = 4
#: Entries that a task counts before it sends them on.
HELD = 1 << 18
#: Rows and bytes of URLs of a chunk; a longer URL is one alone.
CHUNK_ROWS, CHUNK_BYTES = 1 << 14, 1 << 20
ALPHABET = 256
FOLDS = 5
BINS = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule's (rule, verdict); null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def windows(url: str) -> list[bytes]:
    """Each character of `url`, and its end, after the ORDER bytes before it."""
    b = b"\x02" * ORDER + url.encode() + b"\x03"
    return [b[i - ORDER : i + 1] for i in range(ORDER, len(b))]


def _count(batches):
    held: dict[tuple[int, bytes], int] = {}

    def send():
        rows = [(*k, n) for k, n in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64()), strict=True)], ["accepted", "window", "n"])

    for batch in batches:
        for accepted, url in zip(batch.column("accepted").to_pylist(), batch.column("url").to_pylist(), strict=True):
            for w in windows(url):
                held[accepted, w] = held.get((accepted, w), 0) + 1
            if len(held) > HELD:
                yield send()
    if held:
        yield send()


def train(decided: DataFrame) -> DataFrame:
    """The models of the accepted (1) and rejected (0) rows (accepted int, url string): for each context of 0..ORDER bytes
    and class c its count n<c>, its number of different next characters k<c>, and next: their counts by character."""
    counts = decided.mapInArrow(_count, "accepted int, window binary, n long").groupBy("accepted", "window").agg(F.sum("n").alias("n"))
    counts = cut(counts, "counts")
    # suffixes of the windows are the grams of lower order
    grams = counts.select("accepted", "n", F.explode(F.array(*[F.substring("window", i + 1, ORDER + 1 - i) for i in range(ORDER + 1)])).alias("gram"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("accepted") == c, F.col("n"))), F.lit(0).cast("long")).alias(f"g{c}")
    grams = grams.groupBy("gram").agg(of(0), of(1)).withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)")).withColumn("char", F.expr("hex(substring(gram, length(gram), 1))"))
    seen = lambda c: F.sum((F.col(f"g{c}") > 0).cast("long")).alias(f"k{c}")
    return cut(grams.groupBy("context").agg(F.sum("g0").alias("n0"), F.sum("g1").alias("n1"), seen(0), seen(1), F.map_from_entries(F.collect_list(F.struct("char", F.struct("g0", "g1")))).alias("next")), "contexts")


def ratios(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """window, d: the log of the classes' probabilities of the last byte of each window of `wanted` (distinct)."""
    orders = [wanted.select(F.col("window").alias("gram"))]
    for _ in range(ORDER):
        orders.append(orders[-1].select(F.expr("substring(gram, 2, length(gram) - 1)").alias("gram")).distinct())
    known = None
    for grams in reversed(orders):
        x = grams.select("gram", F.expr("substring(gram, 1, length(gram) - 1)").alias("context")).join(models, "context", "left")
        if known is None:
            x = x.withColumn("q0", F.lit(1 / ALPHABET)).withColumn("q1", F.lit(1 / ALPHABET))
        else:
            x = x.withColumn("lower", F.expr("substring(gram, 2, length(gram) - 1)")).join(known, "lower")
        x = x.withColumn("g", F.expr("try_element_at(next, hex(substring(gram, length(gram), 1)))"))
        p = lambda c: F.when(F.col(f"n{c}") > 0, (F.coalesce(F.col("g")[f"g{c}"], F.lit(0)) + F.col(f"k{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"k{c}"))).otherwise(F.col(f"q{c}"))
        known = x.select(F.col("gram").alias("lower"), p(0).alias("q0"), p(1).alias("q1"))
    return known.select(F.col("lower").alias("window"), F.ln(F.col("q1") / F.col("q0")).alias("d"))


def _chunks(batches):
    """Numbers the chunks of a partition's rows, which are cut by rows and by bytes."""
    chunk, n, size = TaskContext.get().partitionId() << 33, 0, 0
    for batch in batches:
        out = []
        for b in pc.fill_null(pc.binary_length(batch.column("__url")), 0).to_pylist():
            if n and (n == CHUNK_ROWS or size + b > CHUNK_BYTES):
                chunk, n, size = chunk + 1, 0, 0
            out.append(chunk)
            n, size = n + 1, size + b
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "__chunk"])


def _wanted(batches):
    chunk, held = None, set()

    def send():
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(held), pa.int64()), pa.array(list(held), pa.binary())], ["__chunk", "window"])

    for batch in batches:
        for c, url in zip(batch.column("__chunk").to_pylist(), batch.column("__url").to_pylist(), strict=True):
            if c != chunk or len(held) > HELD:
                if held:
                    yield send()
                chunk, held = c, set()
            if url:
                held.update(windows(url))
    if held:
        yield send()


def _score(rows: pa.Table, ratio: pa.Table) -> pa.Table:
    d = dict(zip(ratio.column("window").to_pylist(), ratio.column("d").to_pylist(), strict=True))
    out = []
    for url in rows.column("__url").to_pylist():
        w = windows(url) if url else []
        out.append(math.fsum(d[x] for x in w) / max(1, len(w)))
    return rows.drop_columns(["__chunk"]).append_column("score", pa.array(out, pa.float64()))


def score(rows: DataFrame, models: DataFrame) -> DataFrame:
    """`rows` (with a string column __url) and score, the log-likelihood difference for each character."""
    typed = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    chunks = cut(rows.mapInArrow(_chunks, f"{typed}, __chunk long"), "urls")
    wanted = cut(chunks.select("__chunk", "__url").mapInArrow(_wanted, "__chunk long, window binary").distinct(), "windows")
    found = wanted.join(ratios(wanted.select("window").distinct(), models), "window").select("__chunk", "window", "d")
    return chunks.groupBy("__chunk").cogroup(found.groupBy("__chunk")).applyInArrow(_score, f"{typed}, score double")


def calibrate(scored: DataFrame) -> float:
    """The threshold that balances the error rates of rows (accepted, score), from a histogram of BINS bins."""
    low, high = -6.0, 6.0
    b = F.least(F.greatest(F.floor((F.col("score") - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    count = np.zeros((2, BINS))
    for r in scored.groupBy("accepted", b.alias("bin")).count().collect():
        count[r.accepted, r.bin] = r["count"]
    if not count[0].sum() or not count[1].sum():
        return 0.0
    lost = np.concatenate([[0], np.cumsum(count[1])]) / count[1].sum()
    let = 1 - np.concatenate([[0], np.cumsum(count[0])]) / count[0].sum()
    worst = lost + let
    good = np.flatnonzero(worst == worst.min())
    return low + (high - low) * float(good[len(good) // 2]) / BINS


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of `pages`."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("own"), F.concat("host", "path").alias("__url"))
    decided = rows.where("own is not null").select((F.col("own") == "allow").cast("int").alias("accepted"), F.col("__url").alias("url"))
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    threshold = calibrate(score(decided.where(fold == 0).withColumnRenamed("url", "__url"), train(decided.where(fold != 0))))
    out = score(rows, train(decided))
    verdict = F.coalesce("own", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
