"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

The labels give the grades, not the features: 0 is not toxic, 1 is toxic, 2 is toxic in a document of low quality (a null
quality counts as high). The model is P(grade >= k) = sigmoid(w.x - b_k) with one weight vector for all thresholds
b_1 <= b_2. Features are log(1 + count) of words, hashed into SLOTS slots, of which only those that tell toxic documents
from others have a weight. The expected severity is the sum of the probabilities; a document is toxic, of grade 1 or
more, if P(grade >= 1) reaches a threshold. A first model, its features included, knows four fifths of the labelled
documents and takes the threshold that classifies the fifth held out best; the model in use is then fitted on all.

The model is fitted on SAMPLE labelled documents at most, those of least hash. Spark counts their features by slot; the
driver gets these SLOTS counts and, for each sampled document, the counts of the FEATURES chosen slots only. Every
document is scored whole.

Cases: null and empty texts score the intercepts alone, very long texts are scored whole; labels that are null are left
out; repeated labels of a document count as often; without both classes among the labels every document has severity 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.llm.common import cut

SAMPLE = 20_000
SLOTS = 1 << 18
GRADES = 2
#: One in so many sampled documents is held out for the threshold.
HELD_OUT = 5
#: Features kept: the strongest by signed root of the likelihood ratio, of at least this strength.
FEATURES, STRENGTH = 3000, 4.5
WORD = re.compile(rb"[^\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f]+")


def slots(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of a text and how often each occurs."""
    words = WORD.findall((text or b"").lower())
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    s = np.fromiter((xxhash.xxh3_64_intdigest(w) % SLOTS for w in distinct), np.int32, len(distinct))
    u, at = np.unique(s, return_inverse=True)
    return u, np.bincount(at, list(distinct.values())).astype(np.int32)


@dataclass
class Ordinal:
    index: np.ndarray  # slot -> feature, -1 without weight
    weights: np.ndarray
    bounds: np.ndarray
    threshold: float

    def severity(self, text: bytes | None) -> tuple[float, np.ndarray]:
        s, n = slots(text)
        f = self.index[s]
        keep = f >= 0
        z = float(self.weights[f[keep]] @ np.log1p(n[keep])) if keep.any() else 0.0
        p = 1 / (1 + np.exp(np.clip(self.bounds - z, -50, 50)))
        return float(p.sum()), p


def _features(batches):
    for batch in batches:
        own = [slots(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("held"), pa.array([s for s, _ in own], pa.list_(pa.int32())), pa.array([n for _, n in own], pa.list_(pa.int32()))], ["grade", "held", "slots", "counts"])


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """grade, held, slots, counts of the labelled documents of least hash."""
    low = F.coalesce(F.col("quality").cast("int") == 0, F.lit(False)) if "quality" in labels.columns else F.lit(False)
    grade = F.when(F.col("toxic").cast("int") == 0, 0).otherwise(F.lit(1) + low.cast("int")).alias("grade")
    held = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(HELD_OUT)) == 0).alias("held")
    chosen = labels.where("toxic is not null").select("doc_id", grade, held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "held", "text")
    return cut(rows.mapInArrow(_features, "grade int, held boolean, slots array<int>, counts array<int>"), "sample")


def choose(rows: DataFrame) -> np.ndarray:
    """The slots with a weight: the strongest by how far their shares of toxic and other documents differ."""
    sizes = {bool(r.toxic): r["count"] for r in rows.groupBy((F.col("grade") > 0).alias("toxic")).count().collect()}
    seen = np.zeros((2, SLOTS))
    each = rows.select((F.col("grade") > 0).alias("toxic"), F.explode("slots").alias("slot")).groupBy("slot").agg(F.count_if(~F.col("toxic")).alias("n0"), F.count_if("toxic").alias("n1"))
    for r in each.toLocalIterator():
        seen[:, r.slot] = r.n0, r.n1
    n0, n1 = sizes.get(False, 0) + 1e-9, sizes.get(True, 0) + 1e-9
    share = (seen.sum(0) + 1) / (n0 + n1 + 2)
    strength = ((seen[1] + 0.5) / (n1 + 1) - (seen[0] + 0.5) / (n0 + 1)) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    chosen = np.argsort(-np.abs(strength), kind="stable")[:FEATURES]
    return chosen[np.abs(strength[chosen]) >= STRENGTH]


def _chosen(index):
    def run(batches):
        at = index.value
        for batch in batches:
            own, counts = [], []
            for s, n in zip(batch.column("slots").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                f = at[np.asarray(s, np.int64)]
                own.append(f[f >= 0])
                counts.append(np.asarray(n, np.int32)[f >= 0])
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("held"), pa.array(own, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["grade", "held", "slots", "counts"])

    return run


class Rows:
    """Grades and chosen features of labelled documents, flat."""

    def __init__(self, rows: list[tuple[int, bool, list[int], list[int]]]):
        flat = lambda k, t: np.concatenate([np.asarray(r[k], t) for r in rows]) if rows else np.zeros(0, t)
        self.grade = np.array([r[0] for r in rows], np.int64)
        self.doc = np.repeat(np.arange(len(rows)), np.array([len(r[2]) for r in rows], np.int64))
        self.feature, self.value = flat(2, np.int64), np.log1p(flat(3, float))

    def first(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """P(grade >= 1) of each."""
        z = np.bincount(self.doc, w[self.feature] * self.value, len(self.grade))
        return 1 / (1 + np.exp(np.clip(b[0] - z, -50, 50)))


def fit(rows: list[tuple[int, bool, list[int], list[int]]], features: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered bounds for rows (grade, held, features, counts)."""
    r = Rows(rows)
    target = (r.grade[:, None] > np.arange(GRADES)).astype(float)
    share = np.clip(target.mean(0), 1e-4, 1 - 1e-4)
    w, b = np.zeros(features), np.maximum.accumulate(np.log((1 - share) / share))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(GRADES), np.zeros(GRADES)
    for t in range(1, rounds + 1):
        z = np.bincount(r.doc, w[r.feature] * r.value, len(r.grade))
        error = 1 / (1 + np.exp(np.clip(b - z[:, None], -50, 50))) - target
        gw = np.bincount(r.feature, error.sum(1)[r.doc] * r.value, len(w)) / len(r.grade) + 1e-5 * w
        gb = -error.mean(0)
        for p, g, m, v in ((w, gw, mw, vw), (b, gb, mb, vb)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b = np.maximum.accumulate(b)
    return w, b


def best_threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the thresholds that classify best; 0.5 without both classes."""
    if not toxic.any() or toxic.all():
        return 0.5
    grid = np.linspace(0.05, 0.95, 91)
    right = np.array([((p >= g) == toxic).mean() for g in grid])
    best = np.flatnonzero(right == right.max())
    return float(grid[best[len(best) // 2]])


def _scores(model):
    def run(batches):
        for batch in batches:
            out = [model.value.severity(t) if model.value else (0.0, np.zeros(GRADES)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            toxic = [bool(model.value and p[0] >= model.value.threshold) for _, p in out]
            grade = [1 + int((p[1:] >= 0.5).sum()) if t else 0 for t, (_, p) in zip(toxic, out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), pa.array([float(p[0]) for _, p in out], pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic, pa.bool_())], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Ordinal | None:
    rows = sample(docs, labels, size)
    toxic = rows.agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("k")).first()
    if toxic["k"] in (0, toxic["n"]):
        return None

    def model(learned):
        chosen = choose(learned)
        index = np.full(SLOTS, -1, np.int32)
        index[chosen] = np.arange(len(chosen))
        few = rows.mapInArrow(_chosen(docs.sparkSession.sparkContext.broadcast(index)), "grade int, held boolean, slots array<int>, counts array<int>")
        return index, len(chosen), [(r.grade, r.held, r.slots, r.counts) for r in few.collect()]

    _, n, every = model(rows.where("not held"))
    threshold = 0.5
    if not all(r[1] for r in every):
        held = Rows([r for r in every if r[1]])
        threshold = best_threshold(held.first(*fit([r for r in every if not r[1]], n)), held.grade > 0)
    index, n, every = model(rows)
    return Ordinal(index, *fit(every, n), threshold)


def grade(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, severity, p_toxic, grade, toxic: one row per row of `docs`."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, size))
    return docs.select("doc_id", "text").mapInArrow(_scores(model), "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
