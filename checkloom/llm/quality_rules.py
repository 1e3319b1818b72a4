"""Quality rules: a threshold table compiled into one projection; built-in SQL functions only.

Words are runs of other than space and \\t..\\r. Nulls and empty texts have zero words and zero counts and fail the
base rule (fewer than 20 words). Every row is judged alone, so ties, repeated rows and copies need no care; extra
columns, also ones named like the measures, are kept by `keep_good` and ignored by `judge`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[ \t-\r]+"
WINDOW = 8

# Common function words of the four languages.
STOP_WORDS = (
    "the of and to a in is that it was for on with as be at by this are from or an not "
    "le la les de des et en un une du que qui est pas par pour sur dans avec au "
    "der die das und in zu den von mit ist im nicht ein eine auf für sich dem als auch "
    "el los las y del una se por con para su al lo como más es no o"
).split()


@dataclass(frozen=True)
class Rule:
    """Rows fail when they have at least `from_words` words and measure < low or measure > high."""

    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The production thresholds; ratios are per word, per character or per non-empty line.
RULES = (
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.30),
    Rule("dup_line_ratio", high=0.30),
    Rule("stop_ratio", low=0.02, from_words=60),
    Rule("bar_ratio", high=0.20),
)


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text.

    Window hashes tell texts without any repeat (equal windows have equal hashes); only the others compare the windows
    themselves, sorted so that equal ones are neighbours.
    """
    def windows(of):
        return lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: of(w, i))

    hashed = windows(lambda h, i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
    spelled = windows(lambda w, i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("s"), i.alias("i")))

    def covered(places):
        step = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s):
        twice = F.filter(s, lambda x, k: F.coalesce(x["s"] == F.get(s, k + 1)["s"], F.lit(False)) | F.coalesce((k > 0) & (x["s"] == F.get(s, k - 1)["s"]), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    exact = lambda w: let(let(F.sort_array(spelled(w)), repeated), covered)
    once = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(hashed(h), lambda z: F.size(F.array_distinct(z)) == F.size(z)))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).when(once(words), F.lit(0).cast("long")).otherwise(exact(words))


def _parts(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    return F.struct(text.alias("t"), words_of(text).alias("w"), lines.alias("l"))


def _measured(parts: Column) -> Column:
    text, w, lines = parts["t"], parts["w"], parts["l"]
    chars = F.length(F.regexp_replace(text, SPACES, "")).cast("long")
    n = F.size(w).cast("long")
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    bars = F.length(F.regexp_replace(text, r"[^|]+", "")).cast("long")
    dup = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    stop = F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return F.struct(
        n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"), ratio(chars, n).alias("mean_word_chars"),
        ratio(symbols, chars).alias("symbol_ratio"), ratio(dup, F.size(lines)).alias("dup_line_ratio"),
        ratio(stop, n).alias("stop_ratio"), ratio(bars, n).alias("bar_ratio"),
    )


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def passes(q: Column, rules=RULES) -> Column:
    """The threshold table as one boolean expression over the measures."""
    out = F.lit(True)
    for r in rules:
        m, bad = q[r.measure], F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        out = out & ~((q["n_words"] >= r.from_words) & bad)
    return out


def verdict(text: Column, body) -> Column:
    """body(measures of `text`), in one expression that computes words, lines and measures once, wherever it stands."""
    return let(let(_parts(F.coalesce(text, F.lit(""))), _measured), body)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the five base counts, base_failed, kept (base rule and threshold table), one row per input row."""
    row = lambda q: F.struct(*[q[c].alias(c) for c in COUNTS], base_failed(q).alias("base_failed"), (~base_failed(q) & passes(q, rules)).alias("kept"))
    q = docs.select("doc_id", verdict(F.col("text"), row).alias("q"))
    return q.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in (*COUNTS, "base_failed", "kept")])


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of `docs` that pass, with their columns as they were."""
    return docs.where(verdict(F.col("text"), lambda q: ~base_failed(q) & passes(q, rules)))
