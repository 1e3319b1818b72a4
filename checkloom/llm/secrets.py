"""Secret scans: patterns give the base findings, a character convolutional network judges every other candidate.

A candidate is a maximal run of LEAST or more characters of `[A-Za-z0-9+/_.=-]` that meets no base finding. The network
sees it with BEFORE bytes of text ahead of it and AFTER behind it: characters (of the candidate and of its surroundings
told apart) are embedded, a convolution of WIDTH characters runs over them, and its filters are pooled over the three
zones, by maximum, over the candidate by mean too. A layer of hidden units follows. It is numpy alone.

It is trained on labelled findings: a table of PLANS lines written by rule (`planned`), secrets of many makes behind many
words, and what only looks like one: identifiers, numbers, hashes of commits, addresses, file names, rulers, long words.
To these come the corpus's own long words that nothing assigns (`ordinary`: ORDINARY at most, from SAMPLE documents). A quarter is held out: there the logits are calibrated (Platt), and each shape of candidate (letters, digits, mixed) gets
the highest threshold of probability that keeps RECALL of its secrets. Base findings stay whatever their probability is.

Cases: null and empty texts have no findings; texts are read whole, candidates of any length too, in blocks of positions;
offsets are code points; findings are ordered by start, then kind; repeated rows each have their own result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkloom.llm.textkit import groups

#: Kinds in order; the last are the network's.
KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
LEAST_ASSIGNED, LEAST_HEX, LEAST = 12, 16, 12
BEFORE, AFTER, WIDTH = 32, 16, 5
EMBEDDED, FILTERS, HIDDEN = 8, 24, 16
PLANS, EPOCHS, RECALL = 8000, 14, 0.98
#: Documents sampled for their long words, those of least hash, and words taken from them.
SAMPLE, ORDINARY = 1000, 3000
#: Positions that the network reads at once.
BLOCK = 1 << 16


def _classes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_HEX, _RUN = _classes("0123456789abcdef"), _classes(string.ascii_letters + string.digits + "+/_.=-")
#: Codes of bytes: printable ASCII, white space, others; 0 pads. Codes inside a candidate are CODES higher.
CODES = 98
_CODE = np.full(256, 97, np.int64)
_CODE[32:127] = np.arange(1, 96)
_CODE[[9, 10, 11, 12, 13]] = 96


@dataclass(frozen=True)
class Finding:
    """A labelled line: text, the candidate's place in it, whether it is a secret."""

    text: bytes
    start: int
    end: int
    secret: bool


def planned(n: int = PLANS, seed: int = 11) -> list[Finding]:
    """Labelled findings, written by rule: half secrets, half others."""
    r = random.Random(seed)
    some = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    onsets, vowels, codas = ["", "b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "y", "z", "ch", "sch", "th", "sh", "st", "tr", "pf", "qu", "wh", "bl"], ["a", "e", "i", "o", "u", "ea", "ie", "ou", "io"], ["", "", "n", "r", "s", "t", "nd", "ng", "tz", "ch", "nt", "st", "ly", "x", "ll", "mp"]
    syllable = lambda: r.choice(onsets) + r.choice(vowels) + r.choice(codas)
    # a line repeats few syllables, as invented prose does
    syllables: list[str] = []
    word = lambda a=1, b=4: "".join(r.choice(syllables) for _ in range(r.randint(a, b)))
    long = lambda: (w := word(5, 9))[: max(LEAST, len(w) - r.randint(0, 6))]
    prose = lambda k: " ".join(r.choice((word(), word(), word().capitalize(), "the", "in", "é" + word(), word() + r.choice(",.;"))) for _ in range(k))
    letters, mixed, lower = string.ascii_letters, string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    secrets = [
        lambda: some(mixed, 16, 48), lambda: some(mixed + "+/", 20, 64) + r.choice(("", "=", "==")), lambda: some("0123456789abcdef", 12, 64), lambda: some(string.hexdigits.upper(), 16, 40),
        lambda: some(lower, 14, 40), lambda: word(2, 4).capitalize() + some(string.digits, 2, 6) + r.choice(("", ".", "_", "-")) + some(mixed, 3, 8), lambda: some(letters, 14, 32),
        lambda: some(string.digits, 12, 20), lambda: "-".join(some(lower, 4, 8) for _ in range(r.randint(3, 5))), long,
    ]
    marked = [
        lambda: "ghp_" + some(mixed, 36, 36), lambda: "sk_live_" + some(mixed, 24, 32), lambda: "xoxb-" + some(string.digits, 10, 12) + "-" + some(mixed, 20, 26), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 12, 16),
        lambda: "AIza" + some(mixed + "_-", 35, 35), lambda: ".".join(("eyJ" + some(mixed, 20, 40), "eyJ" + some(mixed, 30, 60), some(mixed + "_-", 30, 43))), lambda: "glpat-" + some(mixed, 20, 22),
    ]
    hints = ["pwd", "pass", "passphrase", "credential", "credentials", "private_key", "access_key", "client_key", "auth", "authorization", "bearer", "signing_key", "db_pass", "PASSWORD", "Password", "secret key", "api key", "login", "pin code", "encryption key", "webhook key", "auth_key"]
    joins = [" = ", ": ", "=", ":", " is ", " ", ' = "', ": '", '": "', " -> ", " := "]
    others = [
        *[lambda: (prose(r.randint(0, 3)) + r.choice((" ", " ", " ", "\n", ", ", ". ", "&&& ", "| ", "é", "ß")), long() + r.choice(("", "", "", ".", "=", "-")))] * 12, *[lambda: (prose(r.randint(1, 3)) + r.choice((" ", "\n", ". ")), long().capitalize() + r.choice(("", "", ".")))] * 4, lambda: (r.choice((word() + ".", "")) + str(r.randint(1, 99)) + "@", "mail" + str(r.randint(1, 99)) + "." + word(1, 3) + r.choice((".com", ".org", ".net"))),
        lambda: (r.choice(("https://", "http://", "see ", "at ")), "www." + word(1, 3) + r.choice((".com/", ".org/", ".net/")) + "/".join(word() for _ in range(r.randint(1, 5)))), lambda: (r.choice(("card ", "order ", "no. ", "", "tel. +", prose(1) + " ")), some(string.digits, 12, 19)),
        *[lambda: (r.choice(("", "from ", "ip ", prose(1) + " ")), ".".join(str(r.randint(100, 255)) for _ in range(4)))] * 3, lambda: (r.choice(("at ", "on ", "")), f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}"), lambda: (r.choice(("version ", "v", "release ")), f"{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}-beta.{r.randint(1, 9)}"),
        lambda: (r.choice(("file ", "see ", "", "open ")), "_".join(word(1, 2) for _ in range(r.randint(2, 4))) + r.choice((".pdf", ".txt", ".py", ".parquet", ".html"))), lambda: (r.choice(("\n", " ")), r.choice("-=_.+/") * r.randint(12, 60)),
        lambda: (prose(1) + " ", "-".join(word(1, 3) for _ in range(r.randint(3, 5)))), lambda: (r.choice(("commit ", "sha256: ", "md5=", "revision ", "checksum ", "digest ", "etag: ")), some("0123456789abcdef", 12, 64)),
        lambda: (r.choice(("id ", "uuid ", "trace ", "")), "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12))), lambda: (r.choice(("def ", "call ", "", "field ")), "_".join(word(1, 2) for _ in range(r.randint(3, 5)))), lambda: (r.choice(("class ", "new ", "")), "".join(word(1, 2).capitalize() for _ in range(r.randint(3, 5)))),
        lambda: (r.choice(("in ", "/", "path ")), "/".join(word(1, 2) for _ in range(r.randint(3, 6)))), lambda: (r.choice(("word ", "token count ", "pass rate ", "the secret of ", "author ", "key to ")), word(5, 8)), lambda: ("", word(1, 2) + "=" + word(2, 3) + "=" + str(r.randint(1, 9999))),
        lambda: (prose(1) + " ", "".join(r.choice((str.upper, str.lower))(word(1, 2)) for _ in range(5))), lambda: (prose(1) + ".", word(3, 5) + "." + word(3, 4).capitalize()),
    ]
    out = []
    for i in range(n):
        syllables[:] = [syllable() for _ in range(12)]
        if i % 2:
            head, own = (r.choice((r.choice(hints) + r.choice(joins), prose(1) + " ")), r.choice(marked)()) if r.random() < 0.3 else (r.choice(hints) + r.choice(joins), r.choice(secrets)())
            if own.isalpha() and own[1:].islower():  # a word is a secret only if it is assigned
                head = r.choice(hints) + r.choice((" = ", ": ", "=", ": '", ' = "'))
            own = own if len(own) >= LEAST else own + some(mixed, LEAST, LEAST)
        else:
            head, own = r.choice(others)()
            own = own if len(own) >= LEAST else own + r.choice(("", ".")) + word(5, 7)
            if r.random() < 0.15:  # shouted
                head, own = head.upper() + r.choice(("", "", "!! ", "?! ")), own.upper()
        lead = (prose(r.randint(0, 6)) + r.choice((" ", " ", "\n", ""))).lstrip() if r.random() < 0.9 else ""
        if lead and lead[-1] not in " \n" and (not head or head[0].isalnum()):
            lead += " "
        tail = r.choice((" ", '" ', "' ", "\n", ". ", ", ", "", ";\n")) + prose(r.randint(0, 4))
        start = len((lead + head).encode())
        while start and _RUN[(lead + head).encode()[start - 1]]:  # the candidate is a maximal run
            start -= 1
        whole = (lead + head + own + tail).encode()
        end = len((lead + head + own).encode())
        while end < len(whole) and _RUN[whole[end]]:
            end += 1
        out.append(Finding(whole, start, end, bool(i % 2)))
    return out


def ordinary(docs: DataFrame, size: int = SAMPLE) -> list[Finding]:
    """Long words of a sample of `docs` that stand behind no `:` or `=`, labelled as no secrets: bounded, whatever the texts are."""
    few = ORDINARY // 500

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = [(s, e) for s, e in candidates(text, base(text)) if e - s < 64 and text[s:e].isalpha() and not re.search(rb"[:=]\W{0,3}$", text[max(0, s - 4) : s])]
                rows += [(text[max(0, s - BEFORE) : e + AFTER], s - max(0, s - BEFORE), e - max(0, s - BEFORE)) for s, e in words[:few]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32()))], ["line", "start", "end"])

    # the bound is a hash, so that no texts but the sampled ones travel
    hashed = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    bound = hashed.select("h").distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if bound is None:
        return []
    sample = hashed.where(F.col("h") <= bound).groupBy("h").agg(F.min("text").alias("text"))
    return [Finding(bytes(r.line), r.start, r.end, False) for r in sample.mapInArrow(run, "line binary, start int, end int").orderBy("line", "start").limit(ORDINARY).collect()]


def shape(candidate: bytes) -> int:
    """0 letters only, 1 digits and punctuation only, 2 mixed."""
    return 0 if candidate.isalpha() else 2 if re.search(rb"[A-Za-z]", candidate) else 1


class Windows:
    """Candidates with their surroundings, in one row of codes; each has three zones: before (with two pads), own, after."""

    def __init__(self, found: list[tuple[bytes, int, int]]):
        pieces, self.zones, self.lengths, at = [], [], np.array([e - s for _, s, e in found], np.int64), 0
        pads = np.zeros(WIDTH // 2, np.int64)
        for text, s, e in found:
            b, own, a = (_CODE[np.frombuffer(text[i:j], np.uint8)] for i, j in ((max(0, s - BEFORE), s), (s, e), (e, e + AFTER)))
            pieces += [pads, b, own + CODES, a, pads]
            self.zones += [at, at + len(pads) + len(b), at + len(pads) + len(b) + len(own)]
            at += 2 * len(pads) + len(b) + len(own) + len(a)
        self.codes = np.concatenate([np.zeros(0, np.int64), *pieces])
        self.zones = np.array(self.zones, np.int64)


class Network:
    """Weights, and the calibration that training ends with."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        f = 4 * FILTERS + 1
        self.p = {
            "e": g.normal(0, 0.5, (2 * CODES, EMBEDDED)), "w": g.normal(0, (2 / (WIDTH * EMBEDDED)) ** 0.5, (WIDTH, EMBEDDED, FILTERS)), "c": np.zeros(FILTERS),
            "h": g.normal(0, (2 / f) ** 0.5, (f, HIDDEN)), "d": np.zeros(HIDDEN), "o": g.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
        }
        self.slope, self.shift, self.thresholds = 1.0, 0.0, [0.5] * 3

    def pooled(self, x: Windows) -> np.ndarray:
        """The pooled filters of each candidate, a block of positions at a time."""
        table = np.einsum("ce,kef->kcf", self.p["e"], self.p["w"]).astype(np.float32)
        n, half = len(x.zones), WIDTH // 2
        most, total = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS))
        codes = np.concatenate([np.zeros(half, np.int64), x.codes, np.zeros(half, np.int64)])
        for a in range(0, len(x.codes), BLOCK):
            b = min(a + BLOCK, len(x.codes))
            z = np.broadcast_to(self.p["c"].astype(np.float32), (b - a, FILTERS)).copy()
            for k in range(WIDTH):
                z += table[k][codes[a + k : b + k]]
            np.maximum(z, 0, out=z)
            first = int(np.searchsorted(x.zones, a, "right")) - 1
            last = int(np.searchsorted(x.zones, b, "left"))
            at = np.maximum(x.zones[first:last] - a, 0)
            np.maximum(most[first:last], np.maximum.reduceat(z, at), out=most[first:last])
            total[first:last] += np.add.reduceat(z, at)
        return np.concatenate([most.reshape(n // 3, -1), total[1::3] / np.maximum(x.lengths, 1)[:, None], np.log(np.maximum(x.lengths, 1))[:, None] / 3], 1)

    def logits(self, x: Windows) -> np.ndarray:
        if not len(x.lengths):
            return np.zeros(0)
        return np.maximum(self.pooled(x) @ self.p["h"] + self.p["d"], 0) @ self.p["o"] + self.p["b"]

    def probability(self, found: list[tuple[bytes, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(Windows(found)) + self.shift, -50, 50)))

    def gradients(self, x: Windows, secret: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, for windows that fit in memory."""
        p, n, half = self.p, len(x.codes), WIDTH // 2
        codes = np.concatenate([np.zeros(half, np.int64), x.codes, np.zeros(half, np.int64)])
        emb = p["e"][codes]
        views = np.concatenate([emb[k : k + n] for k in range(WIDTH)], 1)
        z = np.maximum(views @ p["w"].reshape(-1, FILTERS) + p["c"], 0)
        most, zone = np.maximum.reduceat(z, x.zones), np.repeat(np.arange(len(x.zones)), np.diff([*x.zones, n]))
        mean = np.add.reduceat(z, x.zones)[1::3] / x.lengths[:, None]
        f = np.concatenate([most.reshape(len(x.lengths), -1), mean, np.log(x.lengths)[:, None] / 3], 1)
        hidden = np.maximum(f @ p["h"] + p["d"], 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ p["o"] + p["b"], -50, 50))) - secret) / len(secret)
        back = error[:, None] * p["o"] * (hidden > 0)
        df = back @ p["h"].T
        top = (z == most[zone]).astype(float)  # equal windows share what comes back
        dz = top * (df[:, : 3 * FILTERS].reshape(-1, FILTERS) / np.add.reduceat(top, x.zones))[zone]
        own = zone % 3 == 1
        dz[own] += (df[:, 3 * FILTERS : 4 * FILTERS] / x.lengths[:, None])[zone[own] // 3]
        dz *= z > 0
        dviews = dz @ p["w"].reshape(-1, FILTERS).T
        demb = np.zeros_like(emb)
        for k in range(WIDTH):
            demb[k : k + n] += dviews[:, k * EMBEDDED : (k + 1) * EMBEDDED]
        de = np.stack([np.bincount(codes, demb[:, j], 2 * CODES) for j in range(EMBEDDED)], 1)
        return {"e": de, "w": (views.T @ dz).reshape(p["w"].shape), "c": dz.sum(0), "h": f.T @ back, "d": back.sum(0), "o": hidden.T @ error, "b": np.array([error.sum()])}


def train(findings: list[Finding], epochs: int = EPOCHS, recall: float = RECALL, seed: int = 3) -> Network:
    """Fitted on three quarters of `findings` by Adam, calibrated on the fourth."""
    g, net = np.random.default_rng(seed), Network()
    order = g.permutation(len(findings))
    held, learned = order[: len(order) // 4], order[len(order) // 4 :]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    t = 0
    for epoch in range(epochs):
        g.shuffle(learned)
        for i in range(0, len(learned), 128):
            batch = [findings[j] for j in learned[i : i + 128]]
            grads = net.gradients(Windows([(f.text, f.start, f.end) for f in batch]), np.array([f.secret for f in batch], float))
            t += 1
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (grads[k] - m)
                s += 0.01 * (grads[k] ** 2 - s)
                v -= 0.01 * 0.8**epoch * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    rest = [findings[j] for j in held]
    secret = np.array([f.secret for f in rest], float)
    z = net.logits(Windows([(f.text, f.start, f.end) for f in rest]))
    net.slope, net.shift = platt(z, secret)
    p = net.probability([(f.text, f.start, f.end) for f in rest])
    shapes = np.array([shape(f.text[f.start : f.end]) for f in rest])
    net.thresholds = [threshold(p[shapes == k], secret[shapes == k] > 0, recall) for k in range(3)]
    return net


def platt(z: np.ndarray, secret: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate logits, by Newton's method with a little weight decay."""
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - secret) + 1e-3 * (w - [1.0, 0.0]))
        w = w - step
    return float(w[0]), float(w[1])


def threshold(p: np.ndarray, secret: np.ndarray, recall: float) -> float:
    """The highest threshold that finds a share of `recall` of the secrets; over 1 where there are none."""
    own = np.sort(p[secret])[::-1]
    return float(own[int(np.ceil(recall * len(own))) - 1]) if len(own) else 2.0


def runs(inside: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the maximal runs of true that are `least` long or longer."""
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    spans = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)
    return spans[spans[:, 1] - spans[:, 0] >= least]


def assigned(text: bytes) -> list[tuple[int, int]]:
    """Leftmost matches of ASSIGN that do not overlap, those with a long enough value: tried where a keyword stands."""
    low, at = text.lower(), []
    for k in KEYWORDS:
        i = low.find(k)
        while i >= 0:
            at.append(i)
            i = low.find(k, i + 1)
    out, done = [], 0
    for i in sorted(at):
        if i >= done and (m := ASSIGN.match(text, i)):
            done = m.end()
            if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
                out.append(m.span())
    return out


def base(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the findings by pattern, by start and then kind."""
    b = np.frombuffer(text, np.uint8)
    return sorted([(*x, 0) for x in assigned(text)] + [(*m.span(), 1) for m in ACCESS.finditer(text)] + [(int(s), int(e), 2) for s, e in runs(_HEX[b], LEAST_HEX)], key=lambda x: (x[0], x[2]))


def candidates(text: bytes, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs that meet none of the findings `known`."""
    every = runs(_RUN[np.frombuffer(text, np.uint8)], LEAST)
    if known and len(every):
        s, e = np.array([x[0] for x in known]), np.maximum.accumulate([x[1] for x in known])
        before = np.searchsorted(s, every[:, 1], "left")
        every = every[(before == 0) | (e[np.maximum(before - 1, 0)] <= every[:, 0])]
    return [(int(s), int(e)) for s, e in every]


_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def find(texts: list[bytes], net: Network) -> list[list[tuple]]:
    """(kind, start, end, probability) of each text's findings, in code points."""
    whole = b"\n".join(texts)
    edge = np.cumsum([0] + [len(t) + 1 for t in texts])
    known = base(whole)
    others = candidates(whole, known)
    p = np.zeros(0)
    # as many candidates at once as fill a block, a longer one alone
    weight = np.cumsum([e - s + BEFORE + AFTER for s, e in others]) // BLOCK if others else np.zeros(0)
    for k in np.unique(weight):
        p = np.concatenate([p, net.probability([_within(whole, edge, *others[i]) for i in np.flatnonzero(weight == k)])])
    found = [(s, e, 3, x) for (s, e), x in zip(others, p, strict=True) if x >= net.thresholds[shape(whole[s:e])]]
    if known:
        found += [(s, e, k, x) for (s, e, k), x in zip(known, net.probability([_within(whole, edge, s, e) for s, e, _ in known]), strict=True)]
    out: list[list[tuple]] = [[] for _ in texts]
    if found:
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)])
        for s, e, k, x in sorted(found, key=lambda f: (f[0], f[2])):
            i = int(np.searchsorted(edge, s, "right")) - 1
            out[i].append((KINDS[k], int(chars[s] - chars[edge[i]]), int(chars[e] - chars[edge[i]]), float(x)))
    return out


def _within(whole: bytes, edge: np.ndarray, s: int, e: int) -> tuple[bytes, int, int]:
    """The candidate with what surrounds it in its own text."""
    i = int(np.searchsorted(edge, s, "right")) - 1
    a, b = max(int(edge[i]), s - BEFORE), min(int(edge[i + 1]) - 1, e + AFTER)
    return whole[a:b], s - a, e - a


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, findings array of (kind, start, end, probability): one row per row of `docs`."""
    model = docs.sparkSession.sparkContext.broadcast(net or train(planned() + ordinary(docs)))

    def run(batches):
        for batch in batches:
            for part, texts in groups(batch):
                found = [[dict(zip(("kind", "start", "end", "probability"), f, strict=True)) for f in own] for own in find(texts, model.value)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, _FINDINGS)], ["doc_id", "findings"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, findings array<struct<kind:string,start:long,end:long,probability:double>>")


def spans(findings: Column) -> Column:
    """kind:start:end of findings, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame, net: Network | None = None) -> DataFrame:
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    of_base = F.filter("findings", lambda x: x["kind"] != KINDS[3])
    return scan(docs, net).select("doc_id", *map(count, KINDS[:3]), F.sha2(spans(of_base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))
