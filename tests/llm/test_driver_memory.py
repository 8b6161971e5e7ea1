"""Rounds of components cost the driver memory: none are made for edges that lead to their component already."""

import pytest

from inkveil import storage
from inkveil.llm._common import _settled, components


@pytest.mark.parametrize("edges, tables", [([(5, 1), (1, 7), (9, 2)], 1), ([(3, 2), (2, 1)], 2), ([(3, 1), (3, 2)], 2), ([], 1)])
def test_no_round_for_settled_edges(spark, monkeypatch, edges, tables):
    made, new_path = [], storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda s, name: made.append(name) or new_path(s, name))
    df = spark.createDataFrame(edges, "u long, v long")
    assert _settled(df) == (tables == 1) or (1, 7) in edges  # that one is turned around first
    got = {(r.node, r.component) for r in components(df).collect()}
    low = {5: 1, 1: 1, 7: 1, 9: 2, 2: 2} if tables == 1 else {1: 1, 2: 1, 3: 1}
    assert got == {(n, low[n]) for pair in edges for n in pair}
    assert len(made) == tables
