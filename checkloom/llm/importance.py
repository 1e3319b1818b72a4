"""Target-distribution importance resampling over hashed n-grams, by bucket-partitioned inverted postings.

A text's features are its runs of 1 to N words; a feature falls into one of BUCKETS buckets by the CRC of its bytes. A
bucket's gain tells how much more frequent it is in the target corpus than in the documents; a document's weight is the
sum of its features' gains, its score the weight plus Gumbel noise seeded by its doc_id. The documents of highest score
are drawn: sampling without replacement in proportion to the weights' exponentials.

Plan: map tasks turn texts into postings (bucket, document, count) and shuffle them by blocks of WIDTH buckets, each
block split by a salt so that no block is one task's; packed by groups of at most 256 documents, a posting takes two
bytes. Ahead of its postings every block gets the bucket counts of both corpora, pre-aggregated by map task: so the one
pass knows a block's gains, and the corpora's sizes, before the first posting comes, and holds one block's counts only.
Contributions are pre-added by document in each task and then summed, a group at a time. Ranks come from one range-partitioned sort
of (score, doc_id) and the sizes of its partitions.

Cases: null texts, empty ones and those without words have no features and weight 0; a null doc_id seeds as an empty one
and stays null; repeated rows count as often as they occur, each with its own row and rank (ties go to the smaller
doc_id, null first, then to fewer features); very long texts are read in parts, each with the last words of the part
before; an empty target gives gains by smoothing alone; no documents give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkloom.llm.common import cut

N = 3
BUCKETS = 10_000
#: Buckets of a block; a document has one contribution for each block at most.
WIDTH = 100
#: Documents of a group of postings (their places take one byte), and bytes of text after which a group or a part ends.
GROUP, PART = 256, 1 << 20
#: Groups whose contributions a task adds up before it sends them on.
HELD = 4096
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
COUNTS, POSTINGS, ROWS = 0, 1, 2
_SENT = pa.schema([("block", pa.int32()), ("salt", pa.int64()), ("kind", pa.int32()), ("base", pa.int64()), ("payload", pa.binary())])
_GAINED = pa.schema([("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("gains", pa.list_(pa.int64()))])


class Crc:
    """CRC-32 of joined byte strings from those of their parts: appending n bytes to a string is a linear map of its CRC."""

    NEAR = 64

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
        near = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
        for _ in range(self.NEAR):
            near.append(byte[near[-1] & 255] ^ (near[-1] >> 8))
        #: far[j] appends NEAR * 2^j bytes.
        self.near, self.far = np.stack(near[:-1]), [near[-1]]

    @staticmethod
    def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]

    def grown(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What the CRCs `c` add to that of a string with n bytes more."""
        low = n % self.NEAR
        out = self.near[low, 0, c & 255] ^ self.near[low, 1, (c >> 8) & 255] ^ self.near[low, 2, (c >> 16) & 255] ^ self.near[low, 3, c >> 24]
        left, j = n // self.NEAR, 0
        while left.any():
            if j == len(self.far):
                self.far.append(self._apply(self.far[-1], self.far[-1]))
            odd = (left & 1).astype(bool)
            out[odd] = self._apply(self.far[j], out[odd])
            left, j = left >> 1, j + 1
        return out


CRC = Crc()


def parts(text: bytes) -> Iterator[bytes]:
    """`text` in parts of about PART bytes, cut where no word is."""
    at = 0
    while len(text) - at > PART and (m := BREAK.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def features(words: list[bytes], owner: np.ndarray, first: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of all runs of 1 to `n` words of one owner whose last word is at `first` of its owner or later.
    owner: ascending, by word; first: a place in `words` by owner."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    spaced = CRC.grown(np.full(len(words), zlib.crc32(b" "), np.uint32), size) ^ crc
    new = np.arange(len(words)) >= first[owner]
    who, what, run = [owner[new]], [crc[new]], crc
    for k in range(1, min(n, len(words))):
        run = CRC.grown(run[:-1], size[k:] + 1) ^ spaced[k:]
        whole = (owner[k:] == owner[:-k]) & new[k:]
        who.append(owner[k:][whole])
        what.append(run[whole])
    return np.concatenate(who), (np.concatenate(what) % np.uint32(buckets)).astype(np.int64)


class _Map:
    """One map task: groups of documents become rows to send."""

    def __init__(self, n: int, buckets: int, salts: int, target: bool):
        self.n, self.buckets, self.salts, self.target = n, buckets, salts, target
        self.counts = np.zeros(buckets, np.int64)
        self.row = TaskContext.get().partitionId() << 33
        self.groups = 0
        self.done: list[tuple[int | None, int]] = []
        self._open(self.row)

    def _open(self, base: int) -> None:
        self.base, self.size, self.words, self.owned, self.before = base, 0, [], [], []

    def _close(self) -> pa.RecordBatch | None:
        owner = np.repeat(np.arange(len(self.owned)), self.owned)
        first = np.cumsum([0, *self.owned[:-1]]) + self.before if self.owned else np.zeros(0, np.int64)
        doc, bucket = features(self.words, owner, first, self.n, self.buckets)
        self.counts += np.bincount(bucket, minlength=self.buckets)
        if self.target:
            return None
        self.groups += 1
        rows = []
        if self.done:
            ids, total = zip(*self.done, strict=True)
            rows.append((-1, self.groups, ROWS, self.base, np.array([[x is not None for x in ids], [x or 0 for x in ids], total], np.int64).tobytes()))
            self.done = []
        key, count = np.unique(bucket * GROUP + doc, return_counts=True)
        # a count takes one byte, so larger ones take several entries
        times = -(-count // 255)
        full = np.full(int(times.sum()), 255, np.int64)
        full[np.cumsum(times) - 1] = count - 255 * (times - 1)
        key = np.repeat(key, times)
        bucket, doc, full = key // GROUP, (key % GROUP).astype(np.uint8), full.astype(np.uint8)
        edge = np.searchsorted(bucket, np.arange(0, self.buckets + WIDTH, WIDTH))
        for block, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if b > a:
                sizes = np.bincount(bucket[a:b] - block * WIDTH, minlength=WIDTH).astype(np.uint32)
                rows.append((block, self.groups % self.salts, POSTINGS, self.base, sizes.tobytes() + doc[a:b].tobytes() + full[a:b].tobytes()))
        return _sent(rows)

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = [None] * batch.num_rows if self.target else batch.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            total, tail = 0, []
            # the parts of a long text are groups of its own row
            long = len(text or b"") > PART
            for part in parts((text or b"").lower()):
                if self.owned and (long or self.size > PART or len(self.owned) == GROUP):
                    if out := self._close():
                        yield out
                    self._open(self.row)
                own = WORD.findall(part)
                self.words += tail + own
                self.owned.append(len(tail) + len(own))
                self.before.append(len(tail))
                self.size += len(part)
                total += len(own)
                tail = (tail + own)[-(self.n - 1) :] if self.n > 1 else []
            self.done.append((doc_id, total))
            self.row += 1

    def end(self) -> Iterator[pa.RecordBatch]:
        if out := self._close():
            yield out
        size = np.array([self.counts.sum()])
        counts = [np.concatenate([size, self.counts[a : a + WIDTH]]).tobytes() for a in range(0, self.buckets, WIDTH)]
        yield _sent([(block, salt, COUNTS, int(self.target), c) for block, c in enumerate(counts) for salt in range(self.salts)])


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SENT)], schema=_SENT)


def gains(s: np.ndarray, t: np.ndarray, size: int, target: int, buckets: int) -> np.ndarray:
    """Gains of buckets with `s` of the documents' `size` features and `t` of the target's `target`."""
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(size + buckets) / (float(a + 1) * float(target + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _gained(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_GAINED)], schema=_GAINED)


def _contribute(buckets: int):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        here, counts, gain = None, None, None

        def send():
            bases, each = list(held), list(held.values())
            held.clear()
            return _gained([(base, None, None, g) for base, g in zip(bases, each, strict=True)])

        for batch in batches:
            for block, salt, kind, base, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == ROWS:
                    there, ids, total = np.frombuffer(payload, np.int64).reshape(3, -1)
                    yield _gained([(base, pa.array(ids, mask=there == 0), total, None)])
                    continue
                if (block, salt) != here:
                    here, counts, gain = (block, salt), np.zeros((2, 1 + min(WIDTH, buckets - block * WIDTH)), np.int64), None
                if kind == COUNTS:
                    counts[base] += np.frombuffer(payload, np.int64)
                    continue
                if gain is None:
                    gain = gains(counts[0, 1:], counts[1, 1:], int(counts[0, 0]), int(counts[1, 0]), buckets)
                    gain = np.concatenate([gain, np.zeros(WIDTH - len(gain), np.int64)])
                sizes = np.frombuffer(payload, np.uint32, WIDTH)
                doc, count = np.frombuffer(payload, np.uint8, offset=4 * WIDTH).reshape(2, -1)
                # exact in doubles: a group's gains stay far below 2^53
                each = np.bincount(doc, np.repeat(gain, sizes) * count.astype(np.int64), GROUP).astype(np.int64)
                held[base] = held[base] + each if base in held else each
                if len(held) == HELD:
                    yield send()
        if held:
            yield send()

    return run


def _reduced(group: pa.Table) -> pa.Table:
    """The documents of one group, with the sums of their contributions."""
    weight = np.zeros(GROUP, np.int64)
    for g in group.column("gains").drop_null().chunks:
        weight += g.flatten().to_numpy().reshape(-1, GROUP).sum(0)
    ids, total = (group.column(n).combine_chunks().flatten() for n in ("doc_ids", "n_words"))
    rows = np.arange(len(ids)) + group.column("base")[0].as_py()
    return pa.table({"row": rows, "doc_id": ids, "n_words": total, "weight": weight[: len(ids)]})


def weights(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words, n_features, weight: one row per row of `docs`; row tells repeated ones apart."""
    spark = docs.sparkSession
    salts = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // (-(-buckets // WIDTH)))

    def sent(df: DataFrame, is_target: bool) -> DataFrame:
        def run(batches):
            task = _Map(n, buckets, salts, is_target)
            for batch in batches:
                yield from task.take(batch)
            yield from task.end()

        return df.mapInArrow(run, "block int, salt long, kind int, base long, payload binary")

    every = sent(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), False).unionByName(sent(target.select("text"), True))
    dealt = every.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")
    gained = dealt.mapInArrow(_contribute(buckets), "base long, doc_ids array<long>, n_words array<long>, gains array<long>")
    out = gained.groupBy("base").applyInArrow(_reduced, "row long, doc_id long, n_words long, weight long")
    runs = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, n)), F.col("n_words"))
    return out.select("row", "doc_id", "n_words", runs.alias("n_features"), "weight")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) seeded by seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, drawable: Column, percent: int) -> DataFrame:
    """`rows` and rank: 1, 2, 3... for floor(percent * N / 100) of the N drawable rows, by score; null for the others."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("__can").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    every = rows.withColumn("__can", drawable)
    # within a partition monotonically_increasing_id counts the sorted rows, above them it has the partition
    placed = cut(every.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.count_if("__can").alias("can")).orderBy("p").collect()
    drawn, starts, at = percent * sum(s.can for s in sizes) // 100, [], 0
    for s in sizes:
        starts.append((s.p, at))
        at += s.n
    before = spark.createDataFrame(starts, "p long, start long")  # one row for each partition
    place = F.col("start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(before), part == F.col("p")).withColumn("rank", F.when(place <= drawn, place)).drop("__can", "__at", "p", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per row of `docs`, rank null where it is not drawn."""
    rows = weights(docs, target, n, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("row")
    return ranked(rows, F.col("n_words") >= least_words, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
