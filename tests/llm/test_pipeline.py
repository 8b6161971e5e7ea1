"""The pipeline's stages against brute-force versions of their decisions."""

from pyspark.sql import functions as F

import corpus_pipeline
from inkveil.llm._common import stored

from .conftest import SF
from .test_operators import cut, linked, matches


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        rows = sorted(before.items())
        if name == "ngram_join":
            assert set(after) == {d for d, (_, c, _) in linked(rows).items() if c == d}
        elif name == "suffix_dedup":
            digest = cut(rows)
            assert set(before) - set(after) <= {d for d, x in digest.items() if x[1] == x[0] > 0}
            assert all(after[d] == before[d] for d in after if digest[d][1] == 0)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {d for d, x in matches(rows, items).items() if not x[4]}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == len(before)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
