"""Two Bloom filters over a corpus, dealt over tasks by hash: hashes seen once, and hashes seen twice or more.

1. Map tasks send the distinct 64-bit hashes of each group of texts (packed, with a flag for those that the group holds
   twice) to the shard that owns them by their top bits. A key in a third of all rows is one entry for each group.
2. A shard adds them to its once-filter, which grows in layers with what it gets. Those that the once-filter has already
   are repeated: they are what the twice-filter is made of, sized for their number, and a table, a row for each shard.
   It has every repeated hash, and the false positives of the once-filter, a few in a hundred entries.
3. `Repeated` tells which hashes of each document are in that table. While the table fits BROADCAST_BITS at ten bits a
   hash it travels as one Bloom filter; beyond that documents' hashes meet the table shard by shard, so nothing that
   grows with the corpus is held whole anywhere. Both ways keep every repeated hash; a false positive costs one
   needless row of the exact step that follows, never a wrong result.

The number of shards follows the session's shuffle partitions, without a limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.llm.common import cut

PROBES = 2
#: Hashes in the first layer of a once-filter; each next layer takes twice as many.
LAYER = 1 << 16
#: Places of a filter for each hash it is made for.
SPREAD = 12
#: The Bloom filter that is broadcast has this many bits (32 MB) at most.
BROADCAST_BITS = 1 << 28
BITS_A_HASH = 10
PACKED = "shard int, hashes binary, again binary"
_KIND = "shard int, doc_id long, text_hash long, hashes binary"


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions (bits: a power of two) of 64-bit hashes whose top bits chose the shard."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [((x + np.uint64(j) * step) & np.uint64(bits - 1)).astype(np.int64) for j in range(PROBES)]


def power(n: int) -> int:
    return 1 << max(3, (int(n) - 1).bit_length())


class Shard:
    """The once-filter of one shard, in layers of one byte a place, and the hashes that it got again."""

    def __init__(self, layer: int = LAYER):
        self.layer, self.layers, self.found, self.pending = layer, [], np.zeros(0, np.uint64), []

    def _has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for _, full in self.layers:
            out |= np.logical_and.reduce([full[p] for p in places(hashes, len(full))])
        return out

    def _put(self, hashes: np.ndarray) -> None:
        own = self.layers
        if not own or own[-1][0] < len(hashes):
            size = max(self.layer << len(own), len(hashes))
            own.append([size, np.zeros(power(SPREAD * size), bool)])
        own[-1][0] -= len(hashes)
        for p in places(hashes, len(own[-1][1])):
            own[-1][1][p] = True

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """Takes in distinct `hashes` (again: seen twice already)."""
        known = self._has(hashes)
        self._put(hashes[~known])
        self.pending.append(hashes[known | again])
        if sum(map(len, self.pending)) > self.layer + len(self.found):
            self.repeated()

    def repeated(self) -> np.ndarray:
        """The distinct repeated hashes so far, sorted."""
        self.found, self.pending = np.unique(np.concatenate([self.found, *self.pending])), []
        return self.found


def shards_of(spark) -> int:
    """Shards: a power of two, four for each shuffle partition or more."""
    return power(max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def split(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and positions of the hashes it owns (by their top bits), for sorted or unsorted hashes."""
    shard = (hashes >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order])) + 1
    for own in np.split(order, edges):
        if len(own):
            yield int(shard[own[0]]), own


def packed(hashes: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows PACKED of one group's hashes."""
    if not len(hashes):
        return
    found, counts = np.unique(hashes, return_counts=True)
    rows = [(s, found[own].tobytes(), np.packbits(counts[own] > 1, bitorder="little").tobytes()) for s, own in split(found, shards)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "hashes", "again"])


def _shards(batches):
    held: dict[int, Shard] = {}
    for b in batches:
        for s, h, g in zip(*(b.column(c).to_pylist() for c in ("shard", "hashes", "again")), strict=True):
            h = np.frombuffer(h, np.uint64)
            again = np.unpackbits(np.frombuffer(g, np.uint8), count=len(h), bitorder="little").astype(bool)
            held.setdefault(s, Shard()).add(h, again)
    for s, shard in held.items():
        found = shard.repeated()
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["shard", "hashes"])


class Bloom:
    """One filter over all repeated hashes, made on the driver from the shards' segments and broadcast."""

    def __init__(self, n: int, shards: int):
        self.shards, self.segment = shards, power(BITS_A_HASH * max(1, n) // shards)
        self.data = np.zeros(shards * self.segment // 8, np.uint8)

    def put(self, shard: int, bits: bytes) -> None:
        size = self.segment // 8
        self.data[shard * size : (shard + 1) * size] |= np.frombuffer(bits, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        base = (hashes >> np.uint64(64 - self.shards.bit_length() + 1)).astype(np.int64) * self.segment
        out = np.ones(len(hashes), bool)
        for p in places(hashes, self.segment):
            at = base + p
            out &= ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return out


def _segments(segment):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, h in zip(b.column("shard").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                bits = held.setdefault(s, np.zeros(segment, bool))
                for p in places(np.frombuffer(h, np.uint64), segment):
                    bits[p] = True
        for s, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["shard", "hashes"])

    return run


def _probe(batches):
    """A shard's repeated hashes (kind 0) come first, then documents' hashes."""
    known = {}
    for b in batches:
        out = []
        for s, kind, d, t, h in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "doc_id", "text_hash", "hashes")), strict=True):
            h = np.frombuffer(h, np.uint64)
            if kind == 0:
                known = {s: h}
            elif s in known:
                at = np.searchsorted(known[s], h)
                hit = h[known[s][np.minimum(at, len(known[s]) - 1)] == h]
                if len(hit):
                    out.append((d, t, hit.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "text_hash", "hashes"])


class Repeated:
    """Which hashes of a document may be repeated; made by `repeated`."""

    def __init__(self, table: DataFrame, hashes_of: Callable, broadcast_bits: int):
        self.table, self.hashes_of = table, hashes_of
        self.spark = table.sparkSession
        self.count = int(table.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0)).alias("n")).first()["n"]) // 8
        self.bloom = None
        if BITS_A_HASH * self.count <= broadcast_bits:
            bloom = Bloom(self.count, shards_of(self.spark))
            for r in table.mapInArrow(_segments(bloom.segment), "shard int, hashes binary").toLocalIterator():
                bloom.put(r.shard, r.hashes)
            self.bloom = self.spark.sparkContext.broadcast(bloom)

    def join(self, ids: DataFrame) -> DataFrame:
        """`ids` (doc_id, text, text_hash) with `seen`: null, or the document's repeated hashes, sorted, if the table is
        not broadcast."""
        if self.bloom is not None:
            return ids.withColumn("seen", F.lit(None).cast("binary"))
        shards, of = shards_of(self.spark), self.hashes_of

        def run(batches):
            for batch in batches:
                for d, t, hashes in of(batch):
                    h = np.unique(hashes)
                    rows = [(s, d, t, h[own].tobytes()) for s, own in split(h, shards)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "doc_id", "text_hash", "hashes"])

        asked = ids.mapInArrow(run, _KIND).dropDuplicates(["shard", "doc_id", "text_hash"]).withColumn("kind", F.lit(1))
        known = self.table.select("shard", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_hash"), "hashes", F.lit(0).alias("kind"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        met = known.unionByName(asked).repartition(n, "shard").sortWithinPartitions("shard", "kind")
        found = met.mapInArrow(_probe, "doc_id long, text_hash long, hashes binary").groupBy("doc_id", "text_hash").agg(F.array_join(F.collect_list(F.hex("hashes")), "").alias("h"))
        found = cut(found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.unhex("h").alias("seen")), "seen")
        return ids.join(found, ids["doc_id"].eqNullSafe(found["d"]) & ids["text_hash"].eqNullSafe(found["t"]), "left").select("doc_id", "text", "text_hash", F.coalesce("seen", F.lit(b"")).alias("seen"))

    def test(self) -> Callable:
        """mask(hashes, owner, seen): which hashes may be repeated; owner tells the row, seen the rows' column `seen`."""
        bloom = self.bloom

        def mask(hashes: np.ndarray, owner: np.ndarray, seen: list) -> np.ndarray:
            if bloom is not None:
                return bloom.value.has(hashes)
            out = np.zeros(len(hashes), bool)
            edges = np.searchsorted(owner, np.arange(len(seen) + 1))
            for i, own in enumerate(seen):
                if own and edges[i] < edges[i + 1]:
                    out[edges[i] : edges[i + 1]] = np.isin(hashes[edges[i] : edges[i + 1]], np.frombuffer(own, np.uint64))
            return out

        return mask


def repeated(docs: DataFrame, pack_groups: Callable, hashes_of: Callable, broadcast_bits: int | None = None) -> Repeated:
    """The repeated hashes of `docs` (with a column text).

    pack_groups(batch) gives the hashes of each group of texts of a batch; hashes_of(batch), on rows doc_id, text,
    text_hash, gives (doc_id, text_hash, hashes) of each document.
    """
    spark = docs.sparkSession
    shards = shards_of(spark)

    def run(batches):
        for batch in batches:
            for hashes in pack_groups(batch):
                yield from packed(hashes, shards)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(run, PACKED).repartition(n, F.col("shard")).mapInArrow(_shards, "shard int, hashes binary")
    return Repeated(cut(rows, "repeated"), hashes_of, BROADCAST_BITS if broadcast_bits is None else broadcast_bits)
