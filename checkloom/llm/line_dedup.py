"""Line dedup: lines found in many documents go; two Bloom filters tell which lines need exact counting.

A line's key is the line without outer space, \\t..\\r, with A-Z in lower case; empty keys never count and always stay.
(1) the once/twice filters over the distinct keys of each group of texts; (2) keys in the twice-filter travel with
their document and line numbers and are counted exactly, with partial sums before the shuffle; frequent keys meet their
lines again in a join of its own, which Spark can split where one key has a large share; (3) documents meet the numbers
of their dropped lines. The numbers are a table of their own, so Catalyst broadcasts them if they are few; else texts
shuffle once. Other lines never shuffle as lines.

Cases: null or empty text is one empty line, which stays; a row is a document, so repeated rows (also with one doc_id,
or none) count once each and get the same result; a key that fills one very long document is still one count; on an
empty table the result is empty; other columns, whatever their names, are kept by `drop_lines`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.llm import seen_filter
from checkloom.llm.common import cut, meet
from checkloom.llm.textkit import WHITE, groups

MIN_DOCUMENTS = 10
SUSPECT = "doc_id long, text_hash long, key binary, lines array<int>"


def keys_of(text: bytes) -> list[bytes]:
    return [line.strip(WHITE).lower() for line in text.split(b"\n")]


def _hash(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _group_hashes(batch):
    for _, texts in groups(batch):
        yield _hash([k for t in texts for k in set(keys_of(t)) if k])


def _document_hashes(batch):
    for part, texts in groups(batch):
        for d, h, t in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), texts, strict=True):
            yield d, h, _hash([k for k in set(keys_of(t)) if k])


def _suspects(mask):
    def run(batches):
        for batch in batches:
            for part, texts in groups(batch):
                docs, hashes = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
                own, keys = [], []
                for i, t in enumerate(texts):
                    distinct = set(keys_of(t)) - {b""}
                    own += [i] * len(distinct)
                    keys += distinct
                if not keys:
                    continue
                wanted: dict[int, dict[bytes, list[int]]] = {}
                for at in np.flatnonzero(mask(_hash(keys), np.array(own), part.column("seen").to_pylist())):
                    wanted.setdefault(own[at], {})[keys[at]] = []
                out = []
                for i, found in wanted.items():
                    for n, k in enumerate(keys_of(texts[i])):
                        if k in found:
                            found[k].append(n)
                    out += [(docs[i], hashes[i], k, lines) for k, lines in found.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)], ["doc_id", "text_hash", "key", "lines"])

    return run


def dropped_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, keep_first: bool = False, broadcast_bits: int | None = None) -> DataFrame:
    """doc_id, text_hash, lines: the numbers (from 0) of the lines to drop, one row per document that has any.

    keep_first: the first occurrence (least doc_id, then least text hash and line) of each key stays.
    """
    ids = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    seen = seen_filter.repeated(docs, _group_hashes, _document_hashes, broadcast_bits)
    suspects = cut(seen.join(ids).mapInArrow(_suspects(seen.test()), SUSPECT), "lines")
    first = F.min(F.struct("doc_id", "text_hash"))
    counted = cut(suspects.groupBy("key").agg(F.count("*").alias("n"), first.alias("first")).where(F.col("n") >= min_documents).select("key", "first"), "keys")
    hit = cut(suspects.join(counted, "key"), "hits")
    if keep_first:
        own = F.col("first").eqNullSafe(F.struct("doc_id", "text_hash"))
        hit = hit.withColumn("lines", F.when(own, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines")))
    # a set: rows of one doc_id and text have the same lines, however many they are
    return hit.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("lines")).alias("lines"))


def _apply(batches):
    """Rows with `text` and `gone`: the counts, the digest and the text without those lines."""
    for batch in batches:
        n, dropped, sha, kept = [], [], [], []
        for t, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
            out = (t or b"").split(b"\n")
            n.append(len(out))
            if gone:
                drop = set(gone)
                out = [x for i, x in enumerate(out) if i not in drop]
            dropped.append(n[-1] - len(out))
            new = b"\n".join(out)
            sha.append(hashlib.sha256(new).hexdigest())
            kept.append(new if gone else t)
        names = [c for c in batch.schema.names if c not in ("text", "gone")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def digest(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, broadcast_bits: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row per row of `docs`."""
    x = meet(docs.select("doc_id", "text"), cut(dropped_lines(docs, min_documents, broadcast_bits=broadcast_bits), "drops"), "lines", "gone")
    x = x.select("row.doc_id", "text", "gone").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    return x.drop("kept_text")


def drop_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """`docs` with the frequent lines taken out of `text`; n_chars, if present, follows the new text."""
    x = meet(docs, cut(dropped_lines(docs, min_documents, keep_first), "drops"), "lines", "gone")
    schema = x.select("row").schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string").add("kept_text", "string")
    y = x.mapInArrow(_apply, schema)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return y.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
