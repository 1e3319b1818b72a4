"""Best-fit packing of token pieces into sequences of bounded length, improved by swap-based local search.

1. documents become ids, closed by id 0 and cut into pieces of at most CAPACITY (only longer ones);
2. pieces of full length are sequences of their own; the others are dealt evenly over shards of about SHARD pieces by a
   number that their task gave them, so that no document, source or repeated row makes a shard large;
3. a shard packs best-fit decreasing, then tries to empty its underfull bins, the least filled first: it moves pieces,
   exchanges one for one, or two for one, always so that the sum of squared fills grows, with all underfull bins;
4. all underfull bins are dealt anew over shards of about SHARD pieces and improved, as long as that lowers their
   number; then a shard passes its PASS_UP least filled bins to the next round, where FAN_IN shards meet, until one is
   left. No task grows with the input.

Cases: null or empty text is the single id 0; repeated rows and ties are pieces like others; a document of any length
is whole: its pieces are consecutive; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.llm.common import cut
from checkloom.llm.textkit import groups
from checkloom.llm.tokens import SMALL_MEMO, codec, tokenizer_json

CAPACITY = 2048
SHARD = 40_000
PASS_UP = 128
FAN_IN = 16

PIECES = "slot long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(source, capacity):
    def run(batches):
        bpe = codec(source.value, "pieces", SMALL_MEMO)
        slot = TaskContext.get().partitionId() << 33
        make = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        for batch in batches:
            for part, texts in groups(batch):
                out = []
                for doc, e in zip(part.column("doc_id").to_pylist(), bpe.entries(texts, make), strict=True):
                    ids = b"".join(e) + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        out.append((slot, doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
                        slot += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["slot", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Schema PIECES: the token pieces of every row of `docs`; slot numbers them, without meaning."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))
    return docs.select("doc_id", "text").mapInArrow(_pieces(source, capacity), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indices. Open bins are found by residual capacity in a bit set."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - need
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


def _leaving(own: list[int], n: list[int], capacity: int) -> np.ndarray:
    """For every size, the largest one up to it that one or two pieces of `own` have together (0 if none)."""
    size = np.zeros(capacity + 1, np.int64)
    seen: dict[int, int] = {}
    for i in own:
        seen[n[i]] = seen.get(n[i], 0) + 1
    for x in seen:
        size[x] = x
        for z in seen:
            if x + z <= capacity and (x != z or seen[x] > 1):
                size[x + z] = x + z
    return np.maximum.accumulate(size)


def _of_size(own: list[int], n: list[int], want: int) -> list[int]:
    """One or two pieces of `own` that have `want` together."""
    by: dict[int, int] = {}
    for i in own:
        if n[i] == want:
            return [i]
        by.setdefault(n[i], i)
    for i in own:
        j = by.get(want - n[i])
        if j is not None and j != i:
            return [i, j]
    raise AssertionError("no pieces of this size")


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search: the least filled bin gives its pieces away while that raises the sum of squared fills.

    Every underfull bin is a partner: one array holds each piece of theirs (and one of length 0 for each bin) with its
    bin's room, so that the move that fills a partner most is found among all moves of one or two pieces against none
    or one. Passes over the bins follow until one empties no bin.
    """
    n = lengths.tolist()
    fill = [sum(n[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    live = len(bins)
    lowered = True
    while lowered and live > least:
        lowered = False
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=fill.__getitem__)
        held = [i for b in under for i in bins[b]]
        at = {i: k for k, i in enumerate(held)}
        own_of = {b: len(held) + k for k, b in enumerate(under)}
        size = np.array([n[i] for i in held] + [0] * len(under), np.int64)
        where = np.array([b for b in under for _ in bins[b]] + under, np.int64)
        room = capacity - np.array(fill, np.int64)[where]

        def show(b, left, at=at, own_of=own_of, where=where, room=room):
            k = [at[i] for i in bins[b]] + [own_of[b]]
            where[k], room[k] = b, left

        for a in under:
            if live <= least:
                break
            while bins[a]:
                show(a, 0)  # a bin is no partner of its own
                fits = _leaving(bins[a], n, capacity)[size + room] - size
                fits[fits <= np.maximum(room - (capacity - fill[a]), 0)] = 0
                k = int(fits.argmax())
                gain = int(fits[k])
                if not gain:
                    break
                b = int(where[k])
                back = [held[k]] if k < len(held) else []
                out = _of_size(bins[a], n, gain + int(size[k]))
                bins[a] = [i for i in bins[a] if i not in out] + back
                bins[b] = [i for i in bins[b] if i not in back] + out
                fill[a] -= gain
                fill[b] += gain
                show(b, capacity - fill[b])
            if bins[a]:
                show(a, capacity - fill[a])
            else:
                room[own_of[a]] = 0
                live -= 1
                lowered = True
    return [b for b in bins if b]


def _packer(capacity, pass_up, level):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, lengths = int(pdf["shard"].iloc[0]), pdf["length"].to_numpy()
        start = best_fit(lengths, capacity)
        had = list(pdf.groupby("sequence_id").indices.values())
        if level and len(had) <= len(start):  # a round never needs more bins than the round before
            start = [list(map(int, b)) for b in had]
        found = improve(start, lengths, capacity)
        found.sort(key=lambda b: -int(lengths[b].sum()))
        last = 0 if pass_up is None else len(found) - pass_up
        seq, offset, up = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        for k, b in enumerate(found):
            at = np.cumsum(lengths[b])
            # rounds have sequence numbers of their own
            seq[b], offset[b] = (level << 48) + (shard << 28) + k, at - lengths[b]
            up[b] = k >= last and at[-1] < capacity
        return pd.DataFrame({"slot": pdf["slot"].to_numpy(), "length": lengths, "shard": shard, "sequence_id": seq, "offset": offset, "up": up})

    return pack


def assign(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD) -> DataFrame:
    """slot, sequence_id, offset for rows (slot, length) of distinct slots and lengths 1..capacity."""
    full = items.where(F.col("length") == capacity).select("slot", (-1 - F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_items))
    todo = rest.select("slot", "length", F.lit(0).cast("long").alias("sequence_id"), F.pmod(F.xxhash64("slot"), F.lit(shards)).alias("shard"))
    done, level, had, meet = full, 0, None, False
    schema = "slot long, length long, shard long, sequence_id long, offset long, up boolean"
    while True:
        last = shards == 1
        # all underfull bins go up (None); when that lowers their number no more, PASS_UP of each shard meet
        got = cut(todo.groupBy("shard").applyInPandas(_packer(capacity, 0 if last else PASS_UP if meet else None, level), schema), "packed")
        done = done.union(got.where("not up").select("slot", "sequence_id", "offset"))
        if last:
            return done
        up = got.where("up").select("slot", "length", "shard", "sequence_id", "offset")
        level += 1
        if meet:
            shards = -(-shards // FAN_IN)
            todo = up.select("slot", "length", "sequence_id", F.floor(F.col("shard") / FAN_IN).cast("long").alias("shard"))
            continue
        n = got.agg(F.count_distinct("sequence_id").alias("all"), F.count_distinct(F.when(F.col("up"), F.col("sequence_id"))).alias("up"), F.sum(F.col("up").cast("long")).alias("pieces"), F.sum(F.when(F.col("up"), F.col("length"))).alias("tokens")).first()
        if not n["pieces"] or n["up"] <= -(-n["tokens"] // capacity):
            return done.union(up.select("slot", "sequence_id", "offset"))
        meet = had is not None and n["all"] >= had
        had = n["up"]
        shards = shards if meet else -(-n["pieces"] // shard_items)
        deal = F.pmod(F.xxhash64("sequence_id"), F.lit(shards)).alias("shard")
        todo = up.select("slot", "length", "sequence_id", deal)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, shard_items: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    p = cut(pieces(docs, capacity, path), "pieces")
    return p.join(assign(p.select("slot", "length"), capacity, shard_items), "slot").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, fill, and its pieces in order: the layout a writer of training files follows."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("pieces"))


def check_layout(rows: Iterator[tuple[int, int, int]], capacity: int) -> int:
    """The number of sequences of rows (sequence_id, offset, length), which must be gapless and fit."""
    by: dict[int, list[tuple[int, int]]] = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for s, own in by.items():
        at = 0
        for o, n in sorted(own):
            if o != at:
                raise AssertionError(f"sequence {s} has a gap or an overlap at {o}")
            at += n
        if at > capacity:
            raise AssertionError(f"sequence {s} holds {at}")
    return len(by)
