"""Substring dedup: every word of a window of 35 words that also starts elsewhere is removed.

Super-k-mer partitioning. A window's minimiser is its least run of M words (by hash, leftmost on ties); consecutive
windows with one minimiser position are a super-k-mer. Two equal windows have equal minimisers at equal distances, so
they lie in two super-k-mers of one bucket. Steps:

1. once/twice Bloom filters over the minimisers of all super-k-mers: one seen once holds no repeated window;
2. the others travel, packed as one string of words, to their minimiser's bucket. Equal strings are first merged
   (with partial aggregation), so that copies of a document count but do not pile up;
3. a bucket sorts its windows, spelled out, and marks those that occur twice or more. The strings of a minimiser that has
   many different ones are dealt over several tasks, each string to one, and their windows are counted by 128-bit digest
   with partial sums: no task holds more than BUCKET_STRINGS strings, whatever the share of one minimiser or passage;
4. documents meet the positions of their repeated windows, and lose the words these cover. The positions are a table of
   their own: Catalyst broadcasts it if it is small, else texts shuffle once.

Cases: null or empty texts, and texts under 35 words, have no window and keep all words (the kept text of null is
empty); a row is a document, so repeated rows (with one doc_id or none) repeat each other's windows and get equal
results; a periodic text repeats its own windows; an empty table gives an empty result; `remove_repeats` keeps extra
columns of any name.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.llm import seen_filter
from checkloom.llm.common import cut, meet
from checkloom.llm.textkit import Words, groups, mix

WINDOW = 35
M = 8
#: A minimiser with more different strings than this is dealt over several tasks.
BUCKET_STRINGS = 1000
_INDEX_BITS = np.uint64(32)

#: A map task sends a string again only after so many others.
SENT_MEMO = 400_000
PIECE = "doc_id long, text_hash long, minimiser long, pid long, start int"
STRING = "minimiser long, pid long, packed binary"
MARKED = "minimiser long, pid long, repeats array<int>, windows binary, n long"


def super_kmers(words: Words, window: int = WINDOW, m: int = M) -> tuple[np.ndarray, ...]:
    """Minimiser hash, document, first word (within the group) and number of windows of each super-k-mer."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    grams, _ = words.grams(m)
    n = len(words.hash) - window + 1
    if n <= 0:
        return none
    index = np.arange(len(grams), dtype=np.uint64)
    low = (grams >> _INDEX_BITS << _INDEX_BITS) | index
    span, have = window - m + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: n], low[span - have : span - have + n])
    at = (low[:n] & np.uint64((1 << int(_INDEX_BITS)) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    inside = owner[:n] == owner[window - 1 : window - 1 + n]
    first = np.flatnonzero(inside)
    if not len(first):
        return none
    new = np.ones(len(first), bool)
    new[1:] = (at[first[1:]] != at[first[:-1]]) | (first[1:] != first[:-1] + 1) | (owner[first[1:]] != owner[first[:-1]])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(first)))
    starts = first[begin]
    return grams[at[starts]], owner[starts], starts, count


def _group_hashes(window, m):
    def run(batch):
        for _, texts in groups(batch):
            yield mix(super_kmers(Words(texts), window, m)[0])

    return run


def _document_hashes(window, m):
    def run(batch):
        for part, texts in groups(batch):
            mini, owner, _, _ = super_kmers(Words(texts), window, m)
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, (d, h) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), strict=True)):
                yield d, h, mix(mini[edges[i] : edges[i + 1]])

    return run


def _suspects(mask, window, m, batch):
    """For each group of texts: the rows, its words, and minimiser, document, first word, string and its hash of each
    super-k-mer that may hold a repeat."""
    for part, texts in groups(batch):
        w = Words(texts)
        mini, owner, starts, count = super_kmers(w, window, m)
        hit = np.flatnonzero(mask(mix(mini), owner, part.column("seen").to_pylist()))
        if len(hit):
            packed = [b" ".join(w.data[w.starts[s] : w.ends[s + c + window - 2]].split()) for s, c in zip(starts[hit].tolist(), count[hit].tolist(), strict=True)]
            pid = np.fromiter(map(xxhash.xxh3_64_intdigest, packed), np.uint64, len(packed)).view(np.int64)
            yield part, w, mini[hit].view(np.int64), owner[hit], starts[hit], packed, pid


def _pieces(mask, window, m):
    """Where each suspect super-k-mer starts; (minimiser, pid) stand for its string."""
    def run(batches):
        for batch in batches:
            for part, w, mini, owner, starts, _, pid in _suspects(mask, window, m, batch):
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), part.column("text_hash").take(own), pa.array(mini), pa.array(pid), pa.array((starts - w.bounds[owner]).astype(np.int32))], ["doc_id", "text_hash", "minimiser", "pid", "start"])

    return run


def _strings(mask, window, m):
    """The strings themselves, each once for a task."""
    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for _, _, mini, _, _, packed, pid in _suspects(mask, window, m, batch):
                if len(sent) > SENT_MEMO:
                    sent.clear()
                new = []
                for i, p in enumerate(pid.tolist()):
                    if p not in sent:
                        sent.add(p)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(mini[new]), pa.array(pid[new]), pa.array([packed[i] for i in new], pa.binary())], ["minimiser", "pid", "packed"])

    return run


def _windows(packed: bytes, window: int) -> list[bytes]:
    w = packed.split(b" ")
    return [b" ".join(w[i : i + window]) for i in range(len(w) - window + 1)]


def _count(window):
    def repeats(key, rows):
        """rows: (pid, packed, occurrences) of one bucket. Windows are sorted; equal neighbours are repeats. A bucket that
        holds a part of a minimiser's strings returns their windows' digests instead."""
        mini, dealt = key
        if dealt:
            return [(mini, pid, None, b"".join(map(xxhash.xxh3_128_digest, _windows(packed, window))), n) for pid, packed, n in rows]
        spelled = sorted((w, n, k, i) for k, (_, packed, n) in enumerate(rows) for i, w in enumerate(_windows(packed, window)))
        marked: dict[int, list[int]] = {}
        a = 0
        while a < len(spelled):
            b = a
            while b < len(spelled) and spelled[b][0] == spelled[a][0]:
                b += 1
            if b - a > 1 or spelled[a][1] > 1:
                for _, _, k, i in spelled[a:b]:
                    marked.setdefault(k, []).append(i)
            a = b
        return [(mini, rows[k][0], sorted(v), None, None) for k, v in marked.items()]

    def run(batches):
        """Rows come sorted by bucket and string, so that one bucket at a time is held, each string once; of a dealt
        minimiser one string at a time."""
        held, key, out = [], None, []
        for batch in batches:
            for mini, dealt, pid, packed, n in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "dealt", "pid", "packed", "n")), strict=True):
                new = not held or held[-1][0] != pid
                if (mini, dealt) != key or (dealt and new):
                    out += repeats(key, held) if held else []
                    held, key, new = [], (mini, dealt), True
                if new:
                    held.append([pid, packed, n])
                else:
                    held[-1][1] = held[-1][1] or packed
                    held[-1][2] += n
            if out:
                yield _marked(out)
                out = []
        if held and (out := repeats(key, held)):
            yield _marked(out)

    return run


def _marked(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int64()), strict=True)], ["minimiser", "pid", "repeats", "windows", "n"])


def _each_window(batches):
    for batch in batches:
        for mini, pid, windows, n in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "pid", "windows", "n")), strict=True):
            k = len(windows) // 16
            yield pa.RecordBatch.from_arrays([pa.array([windows[16 * i : 16 * i + 16] for i in range(k)], pa.binary()), pa.array([mini] * k, pa.int64()), pa.array([pid] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64())], ["digest", "minimiser", "pid", "i", "n"])


def _dealt_repeats(marked: DataFrame) -> DataFrame:
    """minimiser, pid, repeats of the strings that came as digests of their windows."""
    each = cut(marked.where("windows is not null").select("minimiser", "pid", "windows", "n").mapInArrow(_each_window, "digest binary, minimiser long, pid long, i int, n long"), "windows")
    twice = cut(each.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"), "twice")
    return each.join(twice, "digest", "left_semi").groupBy("minimiser", "pid").agg(F.sort_array(F.collect_list("i")).alias("repeats"))


def repeated_starts(docs: DataFrame, window: int = WINDOW, m: int = M, bucket_strings: int = BUCKET_STRINGS, broadcast_bits: int | None = None) -> DataFrame:
    """doc_id, text_hash, starts: the first words (from 0) of the repeated windows, one row per document that has any."""
    ids = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    seen = seen_filter.repeated(docs, _group_hashes(window, m), _document_hashes(window, m), broadcast_bits)
    known = seen.join(ids)
    pieces = cut(known.mapInArrow(_pieces(seen.test(), window, m), PIECE), "pieces")
    counts = pieces.groupBy("minimiser", "pid").agg(F.count("*").alias("n"))
    many = cut(counts.groupBy("minimiser").agg(F.count("*").alias("k")).where(F.col("k") > bucket_strings).select("minimiser", F.ceil(F.col("k") / bucket_strings).cast("int").alias("of")), "many")
    strings = known.mapInArrow(_strings(seen.test(), window, m), STRING).select("minimiser", "pid", "packed", F.lit(0).cast("long").alias("n"))
    rows = strings.union(counts.select("minimiser", "pid", F.lit(None).cast("binary").alias("packed"), "n"))
    rows = rows.join(many, "minimiser", "left")
    dealt = F.coalesce(1 + F.pmod(F.xxhash64("pid"), F.col("of")), F.lit(0)).cast("int")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = rows.select("minimiser", dealt.alias("dealt"), "pid", "packed", "n").repartition(n, "minimiser", "dealt").sortWithinPartitions("minimiser", "dealt", "pid")
    marked = cut(buckets.mapInArrow(_count(window), MARKED), "marked")
    whole = marked.where("windows is null").select("minimiser", "pid", "repeats")
    if not many.isEmpty():
        whole = whole.union(cut(_dealt_repeats(marked), "dealt"))
    found = pieces.join(whole, ["minimiser", "pid"])
    starts = F.transform("repeats", lambda x: x + F.col("start"))
    # a set: rows of one doc_id and text have the same starts, however many they are
    return found.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set(starts))).alias("starts"))


def _kept_words(text: bytes, starts: list[int] | None, window: int) -> tuple[int, list[bytes]]:
    w = text.split()
    if not starts:
        return len(w), w
    edge = np.zeros(len(w) + 1, np.int32)
    s = np.asarray(starts)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + window, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return len(w), [w[i] for i in np.flatnonzero(keep)]


def _apply(window):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n, gone, sha, kept = [], [], [], []
            for t, s in zip(texts, batch.column("starts").to_pylist(), strict=True):
                total, words = _kept_words(t or b"", s, window)
                new = b" ".join(words)
                n.append(total)
                gone.append(total - len(words))
                sha.append(hashlib.sha256(new).hexdigest())
                kept.append((new if s else t))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("text", "starts")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())], [*(c for c in batch.schema.names if c not in ("text", "starts")), "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of `docs`."""
    x = meet(docs.select("doc_id", "text"), cut(repeated_starts(docs, window), "starts"), "starts", "starts").select("row.doc_id", "text", "starts")
    return x.mapInArrow(_apply(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string").drop("kept_text")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with the repeated words taken out of `text` (single spaces then join the others; other texts stay as they
    are); n_chars, if present, follows the new text."""
    x = meet(docs, cut(repeated_starts(docs, window), "starts"), "starts", "starts")
    schema = x.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
    y = x.mapInArrow(_apply(window), schema)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return y.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 of each text by comparing all windows; for small inputs."""
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out
