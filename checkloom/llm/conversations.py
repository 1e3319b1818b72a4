"""Conversation structure repair: the cheapest edits that give a legal order of roles, by a tight-arc graph.

A conversation is legal if its role initials spell (s?(ua)+)?. A row may be kept, given another role (user or assistant)
or deleted; an empty user or assistant row may be inserted anywhere. The states of the automaton, by position between
rows, are the nodes of an acyclic graph, edits its arcs. Forward and backward minimum costs tell which arcs are on a
cheapest path (tight: forward + cost + backward = total); a frontier set of nodes then goes from left to right over tight
arcs and takes the least letter of Delete, Insert, Keep, Rerole at each step, which spells the ASCII-least audit. Letters
and initials fix the roles of all rows that stay: an optional system row, then user and assistant in turn.

Plan: one range-partitioned sort numbers all rows, so a conversation of any length is many chunks of at most 2^CHUNK
consecutive rows. A chunk is a min-plus matrix (state in, state out); matrices travel in order through a scan in both
directions, 20 numbers a chunk, and give each chunk its costs on both sides. Chunks are then walked in parallel from each
state, a second scan picks the state in which each one starts, and edits go back to their rows. No task holds more than a
chunk; what a digest needs in order (the audit, a hash over texts) is streamed.

Cases: null roles and texts are one space; null turns come first; rows of one turn are ordered by a digest of role and
text, so repeats are adjacent; equal roles and texts are told by their SHA-256; a row of an empty role, or of one whose
initial is not s, u or a, is never kept; a null conv_id is a conversation of its own; very long texts count in whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkloom.llm.common import cut

#: A chunk has 2^CHUNK rows at most.
CHUNK = 14
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
#: Where an inserted or rerolled row leads, and a kept one by initial.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
OWN = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FAULTS = ("none", "blank", "duplicate", "truncated")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage that a fifth of them takes, by crc32 of conv_id:turn."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20).alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def key(conv_id: Column) -> Column:
    """conv_id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, c, h and id, which numbers the rows in order: consecutive within a partition."""
    one = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n)
    x = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text")).withColumn("c", key(F.col("conv_id")))
    x = x.withColumn("h", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).withColumn("salt", F.monotonically_increasing_id())
    order = ["c", F.col("turn").asc_nulls_first(), "h", "salt"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(x.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).drop("salt"), "conversations")


def faults(rows: DataFrame) -> DataFrame:
    """c, id, turn, initial and fault, the place in FAULTS of a row's first fault."""
    firsts = rows.groupBy("c", "h").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    own = rows.select("c", "id", "turn", F.substring("role", 1, 1).alias("initial"), last.alias("last"))
    fault = F.when(F.col("last") == "", 1).when(F.col("first").isNull(), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    return own.join(firsts, "id", "left").select("c", "id", "turn", "initial", fault.alias("fault"))


def arcs(initial: str, fault: int) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of a row's edits. A kept system row has the letter S."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if FAULTS[fault] in ("blank", "duplicate"):
        return out
    more = TRUNCATED * (FAULTS[fault] == "truncated")
    out += [("S" if initial == "s" else "K", q, r, KEEP + more) for q, r in OWN.get(initial, {}).items()]
    return out + [("R", q, r, REROLE + more) for q, r in NEXT.items()]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of matrices."""
    return np.minimum((a[:, :, None] + b[None]).min(1), INF)


ONE = np.where(np.eye(4, dtype=bool), 0, INF).astype(np.int64)
_ONCE = ONE.copy()
for _q, _r in NEXT.items():
    _ONCE[_q, _r] = INSERT
#: Any inserts at one place: three lead from any state to any other.
INSERTS = times(times(_ONCE, _ONCE), _ONCE)
#: Cost from a state to a legal end, by inserts.
END = INSERTS[:, [START, ASSISTANT]].min(1)


def _row_matrix(initial: str, fault: int) -> np.ndarray:
    m = np.full((4, 4), INF, np.int64)
    for _, q, r, cost in arcs(initial, fault):
        m[q, r] = min(m[q, r], cost)
    return m


#: What a row can do, by initial (others alike) and fault.
INITIALS = ("s", "u", "a", "")
ARCS = {(i, f): arcs(i, f) for i in INITIALS for f in range(4)}
ROWS = {k: _row_matrix(*k) for k in ARCS}


def kind(initial: str, fault: int) -> tuple[str, int]:
    return (initial if initial in OWN else "", fault)


class Part:
    """Some consecutive rows of a conversation: their matrix, how many they are, the first and the last initial, and pairs of
    neighbours that are illegal. Parts join in order."""

    def __init__(self, costs=ONE, n=0, first="", last="", illegal=0):
        self.costs, self.n, self.first, self.last, self.illegal = costs, n, first, last, illegal

    def __add__(self, other: Part) -> Part:
        if not self.n or not other.n:
            return other if not self.n else self
        wrong = (self.last, other.first) not in LEGAL
        return Part(times(self.costs, other.costs), self.n + other.n, self.first, other.last, self.illegal + other.illegal + wrong)

    @staticmethod
    def of(rows: list[tuple[str, int]]) -> Part:
        """Of rows (initial, fault), with what may be inserted before each."""
        costs = ONE
        for r in rows:
            costs = times(times(costs, INSERTS), ROWS[kind(*r)])
        return Part(costs, len(rows), rows[0][0], rows[-1][0], sum((a[0], b[0]) not in LEGAL for a, b in zip(rows, rows[1:], strict=False)))

    def fields(self) -> tuple:
        return (self.costs.ravel().tolist(), self.n, self.first, self.last, self.illegal)

    @staticmethod
    def read(costs, n, first, last, illegal) -> Part:
        return Part(np.array(costs, np.int64).reshape(4, 4), n, first, last, illegal)


_PART = "costs array<long>, n long, first string, last string, illegal long"
_PART_TYPES = (pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.int64())


def walk(rows: list[tuple[str, int]], before: np.ndarray, after: np.ndarray, ends: bool) -> list[tuple[int, str] | None]:
    """(state at the end, letters) for each state in which the rows may be entered on a cheapest path, else None.

    before: costs from the start to each state before the rows; after: from each state behind them to a legal end, inserts
    included; ends: whether the conversation ends here.
    """
    n = len(rows)
    forward, backward = [np.minimum((before[:, None] + INSERTS).min(0), INF)], [after]
    for r in rows:
        step = (forward[-1][:, None] + ROWS[kind(*r)]).min(0)
        forward.append(np.minimum((step[:, None] + INSERTS).min(0), INF))
    for r in reversed(rows):
        step = np.minimum((ROWS[kind(*r)] + backward[-1][None]).min(1), INF)
        backward.append(np.minimum((INSERTS + step[None]).min(1), INF))
    backward.reverse()
    total = int((forward[0] + backward[0]).min())
    out: list[tuple[int, str] | None] = []
    for start in range(4):
        if before[start] + backward[0][start] != total or before[start] >= INF:
            out.append(None)
            continue
        letters, i, frontier = [], 0, {start}
        while i < n or (ends and not any(q in (START, ASSISTANT) and forward[i][q] == total for q in frontier)):
            best, reached = "~", set()
            choices = [("I", q, NEXT[q], INSERT) for q in frontier]
            if i < n:
                choices += [x for x in ARCS[kind(*rows[i])] if x[1] in frontier]
            for letter, q, r, cost in choices:
                j = i + (letter != "I")
                # S is written K
                if forward[i][q] + cost + backward[j][r] == total and ("K" if letter == "S" else letter) <= best:
                    as_read = "K" if letter == "S" else letter
                    if as_read < best:
                        best, reached = as_read, set()
                    reached.add((letter, r))
            letters.append(min(x for x, _ in reached))
            i += best != "I"
            frontier = {r for _, r in reached}
        # letters and initials fix the state: nothing, or a system row alone, or by the parity of what stays
        out.append((min(frontier), "".join(letters)))
    return out


def _matrices(rows: pa.Table) -> pa.Table:
    """Parts of one chunk, by conversation."""
    out = []
    for c, own in groupby(_sorted(rows), lambda r: r[0]):
        own = list(own)
        out.append((c, own[0][1] >> CHUNK, own[0][1], *Part.of([r[2:] for r in own]).fields()))
    return _table(out, ("c", "k", "id", "costs", "n", "first", "last", "illegal"), (pa.string(), pa.int64(), pa.int64(), *_PART_TYPES))


def _sorted(rows: pa.Table) -> list[tuple[str, int, str, int]]:
    return sorted(zip(*(rows.column(n).to_pylist() for n in ("c", "id", "initial", "fault")), strict=True), key=lambda r: r[1])


def _table(rows: list[tuple], names: tuple, types: tuple) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def _scan(forward: bool):
    """Carries the joined parts of each conversation along; batches come sorted by conversation and chunk, or the reverse."""
    name = "before" if forward else "after"

    def run(batches):
        here, held = None, Part()
        for batch in batches:
            out = []
            for c, *own in zip(*(batch.column(n).to_pylist() for n in ("c", "costs", "n", "first", "last", "illegal")), strict=True):
                if c != here:
                    here, held = c, Part()
                out.append(dict(zip(("costs", "n", "first", "last", "illegal"), held.fields(), strict=True)))
                held = held + Part.read(*own) if forward else Part.read(*own) + held
            kind = pa.struct(list(zip(("costs", "n", "first", "last", "illegal"), _PART_TYPES, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, name])

    return run


def _walks(rows: pa.Table, sides: pa.Table) -> pa.Table:
    known = {c: (b, a) for c, b, a in zip(*(sides.column(n).to_pylist() for n in ("c", "before", "after")), strict=True)}
    out = []
    for c, own in groupby(_sorted(rows), lambda r: r[0]):
        own = list(own)
        b, a = (Part.read(*x.values()) for x in known[c])
        got = walk([r[2:] for r in own], b.costs[START], (a.costs + END[None]).min(1) if a.n else END, a.n == 0)
        out.append((c, own[0][1] >> CHUNK, own[0][1], [-1 if g is None else g[0] for g in got], ["" if g is None else g[1] for g in got]))
    return _table(out, ("c", "k", "id", "ends", "letters"), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))


def _starts(batches):
    """Picks the state in which each chunk of a conversation starts."""
    here, state = None, START
    for batch in batches:
        states, letters = [], []
        for c, ends, own in zip(*(batch.column(n).to_pylist() for n in ("c", "ends", "letters")), strict=True):
            if c != here:
                here, state = c, START
            states.append(state)
            letters.append(own[state])
            state = ends[state]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("id"), pa.array(states, pa.int32()), pa.array(letters, pa.string())], ["k", "id", "state", "letters"])


def _edits(batches):
    """One row for each edit. id: the row it is about; before: inserted ahead of that row, else behind the last one."""
    names = {"D": "Delete", "I": "Insert", "K": "Keep", "S": "Keep", "R": "Rerole"}
    for batch in batches:
        for first, state, letters in zip(*(batch.column(n).to_pylist() for n in ("id", "state", "letters")), strict=True):
            n, i, out = sum(x != "I" for x in letters), first, []
            for step, x in enumerate(letters):
                if x != "D":
                    state = SYSTEM if x == "S" else NEXT[state]
                out.append((min(i, first + n - 1), step, names[x], ROLE.get(state) if x in "IR" else None))
                i += x != "I"
            yield from _table(out, ("id", "step", "edit", "new_role"), (pa.int64(), pa.int32(), pa.string(), pa.string())).to_batches()


def solve(facts: DataFrame, bits: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(c, illegal, cost) of each conversation, and its edits (id, step, edit, new_role), for rows as from `faults`."""
    rows = facts.select("c", "id", "initial", "fault").withColumn("k", F.shiftright("id", bits))
    parts = rows.groupBy("k").applyInArrow(_matrices, f"c string, k long, id long, {_PART}").withColumn("k", F.shiftright("id", bits))
    part = f"struct<{_PART.replace(' array', ':array').replace(' long', ':long').replace(' string', ':string')}>"
    ahead = parts.repartition("c").sortWithinPartitions("c", "k").mapInArrow(_scan(True), f"c string, k long, id long, {_PART}, before {part}")
    sides = cut(ahead.sortWithinPartitions("c", F.desc("k")).mapInArrow(_scan(False), f"c string, k long, id long, {_PART}, before {part}, after {part}"), "sides")
    walks = rows.groupBy("k").cogroup(sides.groupBy("k")).applyInArrow(_walks, "c string, k long, id long, ends array<int>, letters array<string>")
    starts = walks.withColumn("k", F.shiftright("id", bits)).repartition("c").sortWithinPartitions("c", "k").mapInArrow(_starts, "k long, id long, state int, letters string")
    edits = starts.repartition("k").mapInArrow(_edits, "id long, step int, edit string, new_role string")
    return sides.where("before.n = 0").mapInArrow(_totals, "c string, illegal long, cost long"), edits


def _totals(batches):
    for batch in batches:
        out = []
        for c, a, *own in zip(*(batch.column(n).to_pylist() for n in ("c", "after", "costs", "n", "first", "last", "illegal")), strict=True):
            whole = Part.read(*own) + Part.read(*a.values())
            out.append((c, whole.illegal, int((whole.costs[START] + END).min())))
        yield from _table(out, ("c", "illegal", "cost"), (pa.string(), pa.int64(), pa.int64())).to_batches()


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, c, turn, id, step, edit, role, text: every edit with what it leaves, in the order of (id, step)."""
    x = rows.select("conv_id", "c", "turn", "id", "role", "text").join(edits, "id")
    new = F.col("edit") == "Insert"
    return x.select("conv_id", "c", F.when(~new, F.col("turn")).alias("turn"), "id", "step", "edit", F.coalesce("new_role", "role").alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations (conv_id, turn, id, step, edit, role, text); deleted rows are there with the edit Delete."""
    own = numbered(rows)
    return repaired(own, solve(faults(own))[1]).drop("c")


def _digests(batches):
    """Streams the edits of each conversation, sorted, into its audit and the hash of its repaired text."""
    here, audit, text, any_row = None, [], None, False
    out: list[tuple] = []
    done = lambda: out.append((here, "".join(audit), text.hexdigest()))
    flush = lambda: _table(out, ("c", "audit", "sha"), (pa.string(),) * 3).to_batches()
    for batch in batches:
        for c, edit, role, own in zip(*(batch.column(n).to_pylist() for n in ("c", "edit", "role", "text")), strict=True):
            if c != here:
                if text:
                    done()
                here, audit, text, any_row = c, [], hashlib.sha256(), False
            audit.append(edit[0])
            if edit != "Delete":
                text.update(f"{chr(10) if any_row else ''}{role}:{own}".encode())
                any_row = True
        yield from flush()
        out.clear()
    if text:
        done()
        yield from flush()


def digest(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`: faults, cost, audit and hash of its repair after `damaged`."""
    rows = numbered(damaged(conversations))
    facts = cut(faults(rows), "faults")
    totals, edits = solve(facts)
    count = lambda n: F.count_if(F.col("fault") == FAULTS.index(n)).alias(n)
    wide = lambda f: f("turn").cast("decimal(20,0)")
    gaps = F.coalesce((wide(F.max) - wide(F.min) + 1 - F.count_distinct("turn")).try_cast("long"), F.lit(0)).alias("gaps")
    stats = facts.groupBy("c").agg(gaps, count("blank"), count("duplicate"), count("truncated"))
    texts = repaired(rows, edits).select("c", "id", "step", "edit", "role", F.when(F.col("edit") != "Delete", F.col("text")).alias("text"))
    hashes = texts.repartition("c").sortWithinPartitions("c", "id", "step").mapInArrow(_digests, "c string, audit string, sha string")
    every = conversations.select(key(F.col("conv_id")).alias("c"), "conv_id").distinct()
    for found in (stats, totals, hashes):
        every = every.unionByName(found, allowMissingColumns=True)
    zero = lambda n: F.coalesce(F.max(n), F.lit(0).cast("long")).alias(n)
    out = every.groupBy("c").agg(F.max("conv_id").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return out.drop("c")
