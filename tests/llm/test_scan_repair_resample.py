"""Secret scans, conversation repair and importance resampling against brute-force versions."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from checkloom.llm import conversations, importance, queries, secrets
from tests.llm.test_operators import edge_rows, frame

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- importance resampling -------------------------------------------------------------------------------------------


def test_crc_of_joined_strings():
    rng = random.Random(1)
    for n in (0, 1, 5, 63, 64, 65, 200, 5000):
        a, b = rng.randbytes(9), rng.randbytes(n)
        got = importance.CRC.grown(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(got[0]) == zlib.crc32(a + b)


def resampled(docs, target, percent, least, buckets, n):
    """Brute force: Counter of (doc_id, n_features, weight, score, rank)."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def features(t):
        w = word.findall((t or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x for _, _, f in own for x in f), Counter(x for y in target for x in features(y)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = {x: math.floor(1000 * math.log((t[x] + 1) * (a + buckets) / ((s[x] + 1) * (b + buckets)))) for x in s}
    out = []
    for i, words, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        out.append([words, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    can = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is not None, r[1] or 0, r[2]))
    for k, r in enumerate(can[: percent * len(can) // 100]):
        r[5] = k + 1
    return Counter(tuple(r[1:]) for r in out)


def test_resampling_on_edge_rows(spark):
    """Nulls, repeats, clashing columns, texts over the size of a part, counts over a byte; all of it drawn or a third."""
    rng = random.Random(2)
    rows = edge_rows() + [(77, " ".join(rng.choice(("aa", "bb", "cc")) + str(rng.randint(0, 50)) for _ in range(400_000))), (78, "x" * 1_200_000 + " tail end here")]
    target = [None, "", "la la la One two", "common line aa1 bb2"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent, least, buckets, n in ((100, 0, 10_000, 3), (33, 3, 250, 2)):
        got = importance.resample(frame(spark, rows), bench, percent=percent, least_words=least, buckets=buckets, n=n)
        assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == resampled(rows, target, percent, least, buckets, n)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "text string")
    assert importance.resample(none, bench).collect() == []
    some = frame(spark, [(1, "a b c"), (2, None)])
    got = importance.resample(some, bench, percent=50, least_words=0)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == resampled([(1, "a b c"), (2, None)], [], 50, 0, 10_000, 3)


# --- conversation repair ---------------------------------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit) by search over (position, state) with strings: least cost, then least string."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        nxt = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if fault not in (1, 2):
                more = fault == 3
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, nxt))
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, q))
                if kept is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, kept))
    return None


def audited(own):
    """The rows' faults, then the audit and the text by walking it."""
    seen, faults = set(), []
    for role, text in own:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    rows = [(r[:1], f) for (r, _), f in zip(own, faults, strict=True)]
    cost, audit = cheapest(rows)
    out, i, state = [], 0, 0
    for x in audit:
        if x == "D":
            i += 1
            continue
        role = own[i][0] if x == "K" else "assistant" if state == 2 else "user"
        out.append(f"{role}:{'' if x == 'I' else own[i][1]}")
        state = 1 if x == "K" and role[0] == "s" else 3 if state == 2 else 2
        i += x != "I"
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") or not a or not b for (a, _), (b, _) in zip(own, own[1:], strict=False))
    return [faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()]


def conversations_of(rng, n, longest):
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", "\n\t", None, "A longer answer. With two.", "end. \n"]
    return [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts) if rng.random() < 0.6 else f"line {rng.random()}.") for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("bits", [1, 14])
def test_repair_in_chunks_of_any_size(spark, bits):
    """Chunks of two rows give what one chunk gives: the search's cost and audit."""
    rng = random.Random(5)
    rows = conversations_of(rng, 60, 9) + [(99, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}?", ""])) for t in range(120)] + [(None, None, "user", "hm.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    own = conversations.numbered(df)
    totals, edits = conversations.solve(conversations.faults(own), bits)
    got = {r.c: r for r in totals.collect()}
    letters: dict = {}
    for r in conversations.repaired(own, edits).orderBy("c", "id", "step").collect():
        letters.setdefault(r.c, []).append(r.edit[0])
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault("" if c is None else f"={c}", []).append((" " if role is None else role, " " if text is None else text))
    assert set(got) == set(by)
    for c, turns in by.items():
        *_, illegal, cost, audit, _ = audited(turns)
        assert (got[c].illegal, got[c].cost, "".join(letters[c])) == (illegal, cost, audit), c


def test_digest_against_brute_force(spark):
    """Damage, ties of turns, nulls, conversations without rows; columns that clash; repeated rows."""
    rng = random.Random(6)
    rows = conversations_of(rng, 150, 8) + [(200, None, "user", "x."), (200, 5, None, None), (None, 3, "user", "q?"), (None, 4, "assistant", "w" * 100_000 + "."), (201, 1, "user", "same."), (201, 1, "user", "same."), (202, 2**63 - 1, "user", "a."), (202, -(2**63), "assistant", "b.")]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, id long, k string, c int").repartition(4)
    one = lambda x: " " if x is None else str(x)
    by: dict = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        k, role, text = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20, one(role), one(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[c] += [] if k == 0 else [(t, "user" if k == 4 else role, text)] * (1 + (k == 3))
    got = {r.conv_id: list(r)[1:] for r in conversations.digest(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, *_ in own if t is not None]
        if not own:
            assert got[c] == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
            continue
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        assert got[c] == [gaps if gaps < 2**63 else 0, *audited([r[1:] for r in own])], c


def test_repair_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digest(none).collect() == [] and conversations.repair(none).collect() == []


def test_repaired_conversations_are_legal(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    out = conversations.repair(conversations.damaged(df)).where("edit <> 'Delete'").orderBy("conv_id", "id", "step").collect()
    spelled: dict = {}
    for r in out:
        spelled[r.conv_id] = spelled.get(r.conv_id, "") + r.role[0]
    assert spelled and all(re.fullmatch("(s?(ua)+)?", x) for x in spelled.values())


# --- secret scans ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def network():
    return secrets.train(secrets.planned())


def test_gradients_of_the_network():
    few = secrets.planned(12, seed=4)
    x, y, net = secrets.Windows([(f.text, f.start, f.end) for f in few]), np.array([f.secret for f in few], float), secrets.Network()

    def loss():
        z = net.logits(x)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = net.gradients(x, y)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for i in rng.choice(g.size, min(6, g.size), replace=False):
            p = net.p[name].reshape(-1)
            old = p[i]
            p[i] = old + 1e-3
            up = loss()
            p[i] = old - 1e-3
            down = loss()
            p[i] = old
            assert abs((up - down) / 2e-3 - g.reshape(-1)[i]) < 4e-3, name


def test_network_on_held_out_findings(network):
    few = secrets.planned(2000, seed=77)
    p = network.probability([(f.text, f.start, f.end) for f in few])
    judged = p >= np.array([network.thresholds[secrets.shape(f.text[f.start : f.end])] for f in few])
    y = np.array([f.secret for f in few])
    assert judged[y].mean() > 0.95 and judged[~y].mean() < 0.06
    assert np.mean((p - y) ** 2) < 0.04  # calibrated


def test_blocks_do_not_matter(network, monkeypatch):
    """A candidate over many blocks is pooled as in one."""
    text = b"key = " + b"aB3" * 900 + b" end " + b"plainwordswithoutend" * 3
    found = [(text, s, e) for s, e in secrets.candidates(text, [])]
    whole = network.probability(found)
    monkeypatch.setattr(secrets, "BLOCK", 100)
    assert len(found) == 2 and np.allclose(whole, network.probability(found), atol=1e-5)


def base_of(text):
    """Base findings by the patterns as they are stated."""
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"({keyword})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_findings_against_brute_force(spark, network):
    rng = random.Random(9)
    bits = ["password", "PassWd", "token", "secreT", "api_key", "apiKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF123", "0123456789abcdef", "deadbeef", "é", "ſecret", "toKen", "\n", "x", "longer-value_1", "/", "token=token", "a" * 12]
    rows = edge_rows() + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for i in range(400)]
    rows += [(900, "secret=" + "z" * 1_100_000), (901, 'ok. auth_key = "Zk3v9QpLx27RtYw81mNb" done'), (902, "token" * 30_000)]
    got = secrets.scan(frame(spark, rows), network).collect()
    assert Counter((r.doc_id, tuple((f.kind, f.start, f.end) for f in r.findings if f.kind != "network")) for r in got) == Counter((i, tuple(base_of(t or ""))) for i, t in rows)
    added = {r.doc_id: [f for f in r.findings if f.kind == "network"] for r in got}
    assert [(f.start, f.end) for f in added[901]] == [(16, 36)]
    for r in got:
        spans = sorted((f.start, f.end) for f in r.findings if f.kind == "network")
        others = [(f.start, f.end) for f in r.findings if f.kind != "network"]
        assert all(e <= s2 or e2 <= s for s, e in spans for s2, e2 in others)
    digest = {r.doc_id: r for r in secrets.digest(frame(spark, [r for r in rows if r[0] and r[0] >= 100]), network).collect()}
    for i, t in rows:
        if i and i >= 100:
            own = base_of(t or "")
            assert [digest[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(f[0] == k for f in own) for k in ("assign", "access", "hex")]
            assert digest[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()


def test_clean_documents_get_no_findings(spark):
    """The network adds next to nothing to the invented prose of the documents."""
    got = queries.op11_secret_scan(spark, SF)
    added = got.select(F.explode(F.filter(F.split("spans", ","), lambda x: x.startswith("network")))).count()
    assert got.count() == 200 and added <= 4


def test_scan_of_an_empty_table(spark, network):
    assert secrets.digest(spark.createDataFrame([], "doc_id long, text string"), network).collect() == []
