"""What the stages of the pipeline put on disk: anchors in few bytes, large tables deleted once they are used up."""

import os

import numpy as np
import pytest

from inkveil import storage
from inkveil.llm import ngram_join, suffix_dedup

LINE = "the same long line of words stands in several of these texts, and so it is cut from all but one of them. "


@pytest.mark.parametrize("stage, gone", [(ngram_join.keep_one, {"prefixes", "blocks"}), (suffix_dedup.remove_repeats, {"anchors"})])
def test_large_tables_of_a_stage_are_deleted(spark, monkeypatch, stage, gone):
    docs = spark.createDataFrame([(i, LINE + f"own words {i} " * 5) for i in range(20)], "doc_id long, text string")
    made, new_path = [], storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda s, name: made.append((name, new_path(s, name))) or made[-1][1])
    out = stage(docs)
    there = {name for name, path in made if os.path.exists(path.removeprefix("file://"))}
    assert gone <= {name for name, _ in made} and not gone & there
    assert 0 in {r.doc_id for r in out.collect()}  # nothing that the result needs is gone


def test_anchors_go_to_their_buckets_with_half_of_their_hash(spark):
    docs = spark.createDataFrame([(i, LINE + f"own words {i} " * 5) for i in range(20)], "doc_id long, text string")
    rows = suffix_dedup._dealt(suffix_dedup._keyed(docs), 8, np.zeros(0, np.uint64), 50).collect()
    n = sum(len(r.sigs) // 8 for r in rows)
    assert n > 100 and sum(len(r.hashes) for r in rows) == 4 * n
    shared = suffix_dedup.removed_digest(docs).collect()
    assert sum(r.n_removed >= len(LINE) - 1 for r in shared) == 19 and [r.n_removed for r in shared if r.doc_id == 0] == [0]
