"""BPE encoding and decoding of whole texts by tree concatenation (see tokens.py for the method).

Cases: null and empty texts have no ids and decode to the empty string; special tokens spelled in a text are their
ids, as in the library, also across a cut; very long texts and very long runs without white space are trees like others;
every row is handled alone, so ties and repeats need no care; an empty table gives an empty result; `encode` keeps extra
columns of any name, but those named ids or decoded, which its results replace.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkloom.llm.textkit import groups
from checkloom.llm.tokens import codec, decode_names, tokenizer_json


def _digest(source):
    def run(batches):
        bpe = codec(source.value, "digest")
        make = lambda ids: (len(ids), " ".join(map(str, ids)).encode(), decode_names(bpe, ids).encode())
        for batch in batches:
            for part, texts in groups(batch):
                n, ids, text = [], [], []
                for t in texts:
                    e = [x for x in bpe.tree(t, make) if x[0]]
                    n.append(sum(x[0] for x in e))
                    ids.append(hashlib.sha256(b" ".join([x[1] for x in e])).hexdigest())
                    text.append(hashlib.sha256(b" ".join([x[2] for x in e])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _both(source):
    def run(batches):
        bpe = codec(source.value, "both")
        for batch in batches:
            for part, texts in groups(batch):
                ids = [[i for x in bpe.tree(t, tuple) for i in x] for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([np.asarray(x, np.int32) for x in ids], pa.list_(pa.int32())), pa.array([decode_names(bpe, x) for x in ids])], [*part.schema.names, "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` with ids array<int> and decoded string."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    y = x.mapInArrow(_both(source), T.StructType([*x.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    return y.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("ids", "decoded")], "ids", "decoded")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of `docs`."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))
    return docs.select("doc_id", "text").mapInArrow(_digest(source), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
