"""Each stage of the pipeline against a brute-force version, on its own input."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from checkloom.llm import ngram_join, packing, substring_dedup
from checkloom.llm.common import cut
from tests.llm.test_operators import brute_lines, brute_quality, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    rows = read(docs)
    for name, stage in C.STAGES[:-1]:
        out = cut(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        new = read(out)
        if name == "quality_rules":
            assert new == [(i, t) for i, t in rows if brute_quality(t)[-1]]
        elif name == "line_dedup":
            sha = {i: s for i, _, _, s in brute_lines(rows)}
            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in new} == sha
        elif name == "ngram_jaccard_join":
            assert new == [(i, t) for (i, t), (_, _, c) in zip(rows, ngram_join.brute_force(rows, 5, 80), strict=True) if i == c]
        else:
            want = substring_dedup.brute_force([t for _, t in rows])
            for (i, t), (_, before), (_, gone, sha) in zip(new, rows, want, strict=True):
                assert t == before if not gone else hashlib.sha256(t.encode()).hexdigest() == sha
        docs, rows = out, new
    got = C.STAGES[-1][1](spark, docs, SF).collect()
    n, least = check_packing(rows, got)
    assert n <= least + 1
    whole = C.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert Counter(map(key, whole)) == Counter(map(key, got))
    assert packing.check_layout([(r.sequence_id, r.offset, r.length) for r in whole], 2048) == n


def test_stages_on_odd_tables(spark):
    """Nulls in every column, repeated rows, extra columns and an empty table: every stage keeps the columns and runs."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("n_chars > 2000").first().text
    null = [None] * len(docs.columns)
    row = dict(zip(docs.columns, null, strict=True))
    values = {"doc_id": 1, "text": text, "n_chars": len(text)}
    rows = [tuple(null), tuple({**row, "text": text}.values()), tuple({**row, **values}.values()), tuple({**row, **values}.values()), tuple({**row, "doc_id": 2, "text": ""}.values())]
    odd = spark.createDataFrame(rows, docs.schema).select("*", *[F.lit(i).alias(c) for i, c in enumerate(("row", "d", "gone", "starts", "k", "q"))])
    for table in (odd, odd.limit(0)):
        x = table
        for name, stage in C.STAGES[:-1]:
            x = cut(stage(spark, x, SF), name)
            assert x.columns == table.columns
        assert x.count() <= (1 if table is odd else 0)
        packed = C.STAGES[-1][1](spark, x, SF)
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns)
        assert packed.isEmpty() == x.isEmpty()
