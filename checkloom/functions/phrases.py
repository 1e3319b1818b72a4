"""Phrase rules over the words of names: an ordered table of patterns compiled into one automaton, walked by batches.

A pattern is words, `(a b|c)` for alternatives, `?` behind what may be missing and `*` for any run of words, none too; it
starts anywhere unless it begins with `^`, and ends anywhere unless it ends with `$`. All patterns of a table become one
deterministic automaton over words (subset construction; words that every state treats alike are one class). A name is
walked once: each step is one look-up in an array, taken by all names of a batch together, and what has matched so far is a
bit mask. So the cost of a name is its number of words, whatever the number of patterns. A table whose
automaton would have more than STATES states is walked by two automata of half the rules each, and so on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkloom.functions.text import split_words

STATES = 4000
#: Rules whose bits share one BIGINT.
BITS = 62
ANY = "*"


class PhraseError(ValueError):
    """A pattern that cannot be read."""


@dataclass(frozen=True)
class Rule:
    """A pattern and what else must hold: a package that contains one of `within` (if any are given) and none of `without`, a
    name that does not match `unless`, and none of the exceptions (package, name)."""

    name: str
    pattern: str
    within: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    unless: str | None = None
    exceptions: tuple[tuple[str, str], ...] = ()


def read_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines `name: pattern ; in a b ; not-in c ; unless pattern ; except package.name`; `//` begins a comment."""
    out = []
    for line in lines:
        line = line.split("//")[0].strip()
        if not line:
            continue
        head, *more = [x.strip() for x in line.split(";")]
        name, colon, pattern = head.partition(":")
        if not colon or not pattern.strip():
            raise PhraseError(f"no pattern in {line!r}")
        own: dict = {}
        for part in more:
            word, _, rest = part.partition(" ")
            if word not in ("in", "not-in", "unless", "except") or not rest:
                raise PhraseError(f"unknown part {part!r}")
            own[word] = rest.strip() if word == "unless" else tuple(rest.split())
        out.append(Rule(name.strip(), pattern.strip(), own.get("in", ()), own.get("not-in", ()), own.get("unless"), tuple(tuple(x.rsplit(".", 1)) for x in own.get("except", ()))))
    return out


@dataclass
class _Nfa:
    """Arcs by state: (word, ANY or None for no word, target)."""

    arcs: list[list[tuple[str | None, int]]] = field(default_factory=list)

    def state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def add(self, pattern: str) -> tuple[int, int, bool]:
        """(first state, last state, whether it must end there) of a pattern."""
        tokens = re.findall(r"[()|?*^$]|[^\s()|?*^$]+", pattern)
        start, end = tokens[:1] == ["^"], tokens[-1:] == ["$"]
        tokens = tokens[start : len(tokens) - end]
        if not tokens or "^" in tokens or "$" in tokens:
            raise PhraseError(f"cannot read {pattern!r}")
        tokens.reverse()
        first = self.state()
        if not start:
            self.arcs[first].append((ANY, first))
        last = self._choice(tokens, first, pattern)
        if tokens:
            raise PhraseError(f"cannot read {pattern!r}")
        return first, last, end

    def _choice(self, tokens: list[str], at: int, pattern: str) -> int:
        last, ends = self.state(), []
        while True:
            ends.append(self._sequence(tokens, at, pattern))
            if not tokens or tokens[-1] != "|":
                break
            tokens.pop()
        for e in ends:
            self.arcs[e].append((None, last))
        return last

    def _sequence(self, tokens: list[str], at: int, pattern: str) -> int:
        while tokens and tokens[-1] not in ")|":
            token, begin = tokens.pop(), self.state()
            self.arcs[at].append((None, begin))
            if token == "(":
                end = self._choice(tokens, begin, pattern)
                if not tokens or tokens.pop() != ")":
                    raise PhraseError(f"cannot read {pattern!r}")
            elif token == ANY:
                end = begin
                self.arcs[begin].append((ANY, begin))
            elif token == "?":
                raise PhraseError(f"cannot read {pattern!r}")
            else:
                end = self.state()
                self.arcs[begin].append((token.lower(), end))
            at = self.state()
            self.arcs[end].append((None, at))
            if tokens and tokens[-1] == "?":
                tokens.pop()
                self.arcs[begin].append((None, at))
        return at


@dataclass
class Automaton:
    """table[state, class]: the next state; words: class by word, others have the last class; ever, last: bits of the patterns
    matched once a state is reached, and if the name ends there, one bit for each of `count` patterns."""

    count: int
    words: dict[str, int]
    table: np.ndarray
    ever: list[int]
    last: list[int]


def compiled(patterns: list[str]) -> list[Automaton]:
    """The automata of the patterns, in order; one, unless that has too many states."""
    if not patterns:
        return []
    nfa, accept, starts = _Nfa(), {}, []
    for k, p in enumerate(patterns):
        a, b, end = nfa.add(p)
        starts.append(a)
        accept[b] = (k, end)
    vocabulary = sorted({w for arcs in nfa.arcs for w, _ in arcs if w not in (None, ANY)})

    def closed(states) -> frozenset:
        seen, stack = set(states), list(states)
        while stack:
            for w, t in nfa.arcs[stack.pop()]:
                if w is None and t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(seen)

    ids = {closed(starts): 0}
    rows, todo = [], [next(iter(ids))]
    for states in todo:
        by: dict[str, set[int]] = {}
        for s in states:
            for w, t in nfa.arcs[s]:
                if w is not None:
                    by.setdefault(w, set()).add(t)
        always, row = by.pop(ANY, set()), {}
        for w in (*by, ANY):
            to = closed(always | by.get(w, set()))
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
                if len(ids) > STATES and len(patterns) > 1:
                    half = len(patterns) // 2
                    return compiled(patterns[:half]) + compiled(patterns[half:])
            row[w] = ids[to]
        rows.append(row)
    dense = np.array([[row.get(w, row[ANY]) for w in (*vocabulary, ANY)] for row in rows], np.int32)
    columns, kind = np.unique(dense, axis=1, return_inverse=True)
    kind = kind.ravel()
    # the class of other words comes last
    other = int(kind[-1])
    order = [c for c in range(columns.shape[1]) if c != other] + [other]
    place = {c: i for i, c in enumerate(order)}
    words = {w: place[int(k)] for w, k in zip(vocabulary, kind, strict=False) if int(k) != other}
    bits = lambda states, at_end: sum(1 << k for k, end in (accept[s] for s in states if s in accept) if end == at_end)
    return [Automaton(len(patterns), words, columns[:, order], [bits(x, False) for x in ids], [bits(x, True) for x in ids])]


def _walk(automata: list[Automaton], words: Column) -> Column:
    """The bits that `words` set, BITS of them in each element: all names of a batch take their k-th step at once."""
    tables = [a.table.astype(np.int64) for a in automata]
    masks = [[[np.array([x >> g & (1 << BITS) - 1 for x in of], np.int64) for of in (a.ever, a.last)] for g in range(0, a.count, BITS)] for a in automata]
    known = [a.words for a in automata]

    @F.arrow_udf("array<bigint>")
    def bits(lists: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, own = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        ends = np.cumsum(sizes)
        # names by falling length, so those that take a k-th step are the first ones
        order = np.argsort(-sizes, kind="stable")
        begin, long = (ends - sizes)[order], -sizes[order]
        steps = int(-long[0]) if len(long) else 0
        left = np.searchsorted(long, -np.arange(1, steps + 1), side="right")
        columns = []
        for table, words_, parts in zip(tables, known, masks, strict=True):
            other = table.shape[1] - 1
            kind = np.array([*(words_.get(w, other) for w in own), other], np.int64)[codes]
            state = np.zeros(len(sizes), np.int64)
            met = [np.full(len(sizes), ever[0]) for ever, _ in parts]
            for k in range(steps):
                n = left[k]
                state[:n] = table[state[:n], kind[begin[:n] + k]]
                for m, (ever, _) in zip(met, parts, strict=True):
                    m[:n] |= ever[state[:n]]
            columns += [m | last[state] for m, (_, last) in zip(met, parts, strict=True)]
        out = np.empty((len(sizes), len(columns)), np.int64)
        out[order] = np.stack(columns, 1)
        offsets = np.arange(len(sizes) + 1, dtype=np.int32) * len(columns)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=pc.is_null(lists))

    return bits(words)


class Phrases:
    """Patterns as Columns: `bits` walks words, `hit` reads the bit of a pattern, which costs next to nothing."""

    def __init__(self, patterns: list[str]):
        self.automata, self.place, part = compiled(list(dict.fromkeys(patterns))), {}, 0
        every = iter(dict.fromkeys(patterns))
        for a in self.automata:
            for k in range(a.count):
                self.place[next(every)] = (part + k // BITS, k % BITS)
            part += -(-a.count // BITS)

    def bits(self, words: Column) -> Column:
        return _walk(self.automata, words) if self.automata else F.array().cast("array<bigint>")

    def hit(self, bits: Column, pattern: str) -> Column:
        part, k = self.place[pattern]
        return F.get(bits, F.lit(part)).bitwiseAND(F.lit(1 << k).cast("bigint")) != 0


def classify(names: DataFrame, rules: list[Rule]) -> DataFrame:
    """`names` (package, name, and more) and rule: the first one that the words of the name, and its package, meet; null if
    none does or the name is null. A null package is empty."""
    phrases = Phrases([p for r in rules for p in (r.pattern, r.unless) if p])
    package, name, bits, rule = F.coalesce("package", F.lit("")), F.col("name"), F.col("__bits"), None
    for r in rules:
        holds = phrases.hit(bits, r.pattern)
        if r.within:
            holds &= reduce(Column.__or__, [F.contains(package, F.lit(x)) for x in r.within])
        for x in r.without:
            holds &= ~F.contains(package, F.lit(x))
        if r.unless:
            holds &= ~phrases.hit(bits, r.unless)
        for p, n in r.exceptions:
            holds &= ~((package == p) & (name == n))
        rule = F.when(holds, r.name) if rule is None else rule.when(holds, r.name)
    # the walk is a column of its own, so all rules read one walk
    walked = names.withColumn("__bits", phrases.bits(F.split(split_words(name), r"\s+")))
    return walked.withColumn("rule", F.lit(None).cast("string") if rule is None else rule).drop("__bits")
