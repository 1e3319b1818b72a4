"""Embedding near-dedup: all pairs of vectors with cosine of THRESHOLD or more, by PCA-ordered tiled comparison.

Equal vectors are one class with a weight. Classes are ordered along the first principal axis and cut into tiles, BLOCK
neighbouring tiles make a block. Blocks whose ranges on that axis are near enough for the threshold meet, so that a tile
travels once for each near block, not for each near tile; of two blocks, tiles are compared unless their boxes on the
BOX leading axes are too far apart. In a pair of tiles the leading dimensions are accumulated first: leading dot product plus product of the suffix norms bounds the cosine, and a pair
stops when the bound is below the threshold; what is left goes on over STEPS to the exact double-precision cosine of
the given vectors. The axes come from a sample of SAMPLE vectors; they decide the order of the work, never the result.
A tile pair returns counts and a spanning forest of its links, so a group of g near copies gives O(g) rows a tile pair.

Cases: null vectors, zero vectors, vectors with null or non-finite components and those of another length than their
partner link with nothing; repeated rows are links of each other (n_links counts the other rows); rows without vec_id
take part, and name no component; a component without any vec_id has none; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.llm.common import components, cut

THRESHOLD = 0.95
TILE = 2048
BLOCK = 4
BOX = 8
SAMPLE = 4096
#: Shares of the variance that the leading dimensions of each step hold.
STEPS = (0.45, 0.7)
_EPS = 1e-6


def _scaled(a: np.ndarray) -> np.ndarray:
    """`a` by a power of two, if its squares could over- or underflow: the cosines are the same."""
    most = np.abs(a).max()
    return a if 1e-100 < most < 1e100 else np.ldexp(a, -int(np.frexp(most)[1]))


def _valid(v) -> np.ndarray | None:
    if v is None or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    return _scaled(a) if a.size and np.isfinite(a).all() and a.any() else None


def _units(vecs: np.ndarray) -> np.ndarray:
    return vecs / np.linalg.norm(vecs, axis=1)[:, None]


def _rows(column: pa.Array):
    """Vectors of an Arrow list column: float64 arrays or None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count == 0 and column.values.null_count == 0:
        flat, edge = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
        if len(set(np.diff(edge).tolist())) == 1 and edge[1] > edge[0]:
            m = flat[edge[0] : edge[-1]].reshape(len(edge) - 1, -1)
            good = np.isfinite(m).all(1) & m.any(1)
            return [_scaled(m[i]) if good[i] else None for i in range(len(m))]
    return [_valid(v) for v in column.to_pylist()]


def _classes(axis):
    def run(batches):
        for batch in batches:
            key, raw, dim, at = [], [], [], []
            for v in _rows(batch.column("embedding")):
                b = None if v is None else (v + 0.0).tobytes()
                key.append(None if v is None else xxhash.xxh3_128_digest(b))
                raw.append(b)
                dim.append(0 if v is None else len(v))
                # a length that the sample has not lies along its own first dimension, which is the first axis of its tiles
                at.append(None if v is None else float((v / np.linalg.norm(v)) @ axis[len(v)] if len(v) in axis else v[0] / np.linalg.norm(v)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(key, pa.binary()), pa.array(raw, pa.binary()), pa.array(dim, pa.int32()), pa.array(at, pa.float64())], ["vec_id", "key", "raw", "dim", "at"])

    return run


def principal_axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length in a sample (by hash of vec_id): axes as columns, and their variance, descending."""
    by: dict[int, list[np.ndarray]] = {}
    for r in vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").collect():
        if (v := _valid(r.embedding)) is not None:
            by.setdefault(len(v), []).append(v)
    out = {}
    for d, rows in by.items():
        u = _units(np.array(rows))
        values, axes = np.linalg.eigh(u.T @ u / len(u))
        out[d] = (np.ascontiguousarray(axes[:, ::-1]), np.maximum(values[::-1], 0))
    return out


def _tiles(size):
    def run(batches):
        held, count = [], 0
        part = TaskContext.get().partitionId()

        def tile(rows):
            nonlocal count
            rows.sort(key=lambda r: (r[3], r[2]))
            node = (part << 30) + (count << 12)
            count += 1
            return ((part << 18) + count, rows[0][3], rows[0][2], rows[-1][2], node, b"".join(r[1] for r in rows), np.array([r[4] for r in rows], np.int64).tobytes(), b"".join(r[0] for r in rows))

        def send(tiles):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tiles, strict=True), (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["tile", "dim", "lo", "hi", "node", "raw", "weights", "keys"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "at", "dim", "weight")), strict=True):
                if held and (len(held) == size or held[-1][3] != r[3]):
                    yield send([tile(held)])
                    held = []
                held.append(r)
        if held:
            yield send([tile(held)])

    return run


def _nodes(batches):
    for batch in batches:
        for node, keys in zip(batch.column("node").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            k = [keys[i : i + 16] for i in range(0, len(keys), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(range(node, node + len(k)), pa.int64()), pa.array(k, pa.binary())], ["node", "key"])


class Tile:
    """A tile's unit vectors, along the principal axes too, and what its pairs need of them."""

    def __init__(self, node: int, raw: bytes, weights: bytes, dim: int, axes: dict):
        self.node, self.dim, self.weight = node, dim, np.frombuffer(weights, np.int64)
        self.unit = _units(np.frombuffer(raw).reshape(-1, dim))
        v, var = axes.get(dim) or (np.eye(dim), np.ones(dim))
        share = np.cumsum(var) / max(var.sum(), 1e-300)
        self.steps = sorted({min(dim, int(np.searchsorted(share, s)) + 1) for s in STEPS})
        self.turned = self.unit @ v
        self.rest = np.sqrt(np.maximum(0, np.cumsum((self.turned**2)[:, ::-1], 1)[:, ::-1]))
        p = self.steps[0]
        self.lead = np.concatenate([self.turned[:, :p], self.rest[:, p : p + 1]] if p < dim else [self.turned], 1).astype(np.float32)
        self.low, self.high = self.turned[:, :BOX].min(0), self.turned[:, :BOX].max(0)

    def near(self, other: Tile, reach: float) -> bool:
        if self.dim != other.dim:
            return False
        gap = np.maximum(0, np.maximum(self.low - other.high, other.low - self.high))
        return float(gap @ gap) <= reach * reach


def similar_pairs(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows of two tiles with cosine >= threshold (i < j if they are one)."""
    i, j = np.nonzero(a.lead @ b.lead.T >= threshold - 10 * _EPS)
    if a is b:
        i, j = i[i < j], j[i < j]
    for q in a.steps[1:]:
        keep = []
        for s in range(0, len(i), 200_000):
            x, y = i[s : s + 200_000], j[s : s + 200_000]
            keep.append(np.einsum("ij,ij->i", a.turned[x, :q], b.turned[y, :q]) + (a.rest[x, q] * b.rest[y, q] if q < a.dim else 0) >= threshold - _EPS)
        if keep:
            k = np.concatenate(keep)
            i, j = i[k], j[k]
    exact = [np.einsum("ij,ij->i", a.unit[i[s : s + 200_000]], b.unit[j[s : s + 200_000]]) >= threshold for s in range(0, len(i), 200_000)]
    k = np.concatenate(exact) if exact else np.zeros(0, bool)
    return i[k], j[k]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (i, j) over 0..n-1: labels sink to the least neighbour, then links that join
    different labels are kept."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return [(k, int(label[k])) for k in np.flatnonzero(label != np.arange(n)).tolist()]


def _links(a: Tile, b: Tile, threshold: float) -> list[tuple[int, int, int]]:
    """Rows (0, node, links' weight) and (1, node, node) of two tiles."""
    i, j = similar_pairs(a, b, threshold)
    if not len(i):
        return []
    parts, base = ([a], 0) if a is b else ([a, b], len(a.unit))
    weight = np.concatenate([t.weight for t in parts])
    ids = np.concatenate([np.arange(t.node, t.node + len(t.unit)) for t in parts])
    n = np.bincount(i, weight[base + j], len(ids)) + np.bincount(base + j, weight[i], len(ids))
    out = [(0, int(ids[k]), int(n[k])) for k in np.flatnonzero(n)]
    return out + [(1, int(ids[x]), int(ids[y])) for x, y in forest(i, base + j, len(ids))]


def _compare(axes, threshold, reach):
    def run(batches):
        """Rows come sorted by pair of blocks, the first block's tiles before the second's."""
        key, held = None, []
        for batch in batches:
            out = []
            for x, y, block, dim, node, raw, weights in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "block", "dim", "node", "raw", "weights")), strict=True):
                if (x, y) != key:
                    key, held = (x, y), []
                me = Tile(node, raw, weights, dim, axes)
                if block == x:
                    held.append(me)
                if x == y or block == y:
                    for other in held:
                        if other.near(me, reach):
                            out += _links(other, me, threshold)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["kind", "a", "b"])

    return run


def _near_blocks(bounds: DataFrame, reach: float) -> DataFrame:
    """Blocks x <= y with vectors of one length whose ranges are within `reach`: an equi-join on bins of the axis."""
    at = lambda c, plus=0.0: F.floor((F.col(c) + plus) / reach)
    one = bounds.select(F.col("block").alias("x"), "dim", F.col("lo").alias("lo_x"), F.col("hi").alias("hi_x"), F.explode(F.sequence(at("lo"), at("hi"))).alias("bin"))
    two = bounds.select(F.col("block").alias("y"), "dim", F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), F.explode(F.sequence(at("lo", -reach), at("hi", reach))).alias("bin"))
    return one.join(two, ["dim", "bin"]).where((F.col("x") <= F.col("y")) & (F.col("lo_y") <= F.col("hi_x") + reach) & (F.col("lo_x") <= F.col("hi_y") + reach)).select("x", "y").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors`."""
    spark = vectors.sparkSession
    axes = principal_axes(vectors.select("vec_id", "embedding"))
    first = {d: v[:, 0] for d, (v, _) in axes.items()}
    rows = cut(vectors.select("vec_id", "embedding").mapInArrow(_classes(first), "vec_id long, key binary, raw binary, dim int, at double"), "vectors")
    cls = rows.where("key is not null").groupBy("key").agg(F.first("raw").alias("raw"), F.first("at").alias("at"), F.first("dim").alias("dim"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    names = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    n = max(1, -(-rows.count() // tile))
    tiles = cut(cls.select("key", "raw", "at", "dim", "weight").repartitionByRange(n, "at").mapInArrow(_tiles(tile), "tile long, dim int, lo double, hi double, node long, raw binary, weights binary, keys binary"), "tiles")
    reach = (2 - 2 * threshold) ** 0.5 + _EPS
    # a range partition is a tile or a few; BLOCK of them are a block
    tiles = tiles.withColumn("block", F.floor(F.shiftright("tile", 18) / BLOCK))
    near = _near_blocks(tiles.groupBy("block", "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), reach)
    listed = cut(near.withColumn("block", F.explode(F.array_distinct(F.array("x", "y")))), "near")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.drop("keys", "lo", "hi").join(listed, "block").repartition(width, "x", "y").sortWithinPartitions("x", "y", "block")
    found = cut(dealt.select("x", "y", "block", "dim", "node", "raw", "weights").mapInArrow(_compare(axes, threshold, reach), "kind int, a long, b long"), "links")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n"))
    comps = components(found.where("kind = 1").select("a", "b"))
    nodes = tiles.select("node", "keys").mapInArrow(_nodes, "node long, key binary")
    known = nodes.join(cut(names, "names"), "key").join(counts, nodes["node"] == counts["a"], "left").join(comps, nodes["node"] == comps["id"], "left")
    known = known.select("key", "weight", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("comp"))
    name = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = cut(known.join(name, "comp").select("key", "weight", "n", "component_id"), "known")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    comp = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    links = F.coalesce(F.col("n") + F.col("weight") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", links.alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"))
