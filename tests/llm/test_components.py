"""Connected components against a plain version: results, and how few rounds they take."""

from __future__ import annotations

import random

import numpy as np
import pytest
from fleetpulse.llm import components


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("graph", ["chain", "star", "random", "none"])
def test_components(spark, monkeypatch, graph, kind):
    rng = random.Random(11)
    edges = {
        "chain": [(i, i + 1) for i in range(1500)],  # in the order of the numbers
        "star": [(0, i) for i in range(1, 700)] + [(5000 + i, i) for i in range(30)] + [(7, 7), (7, 0), (0, 7)],
        "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(600)],
        "none": [(4, 4), (None, 3)],
    }[graph]
    rng.shuffle(edges)
    if kind == "string":
        edges = [(a if a is None else f"n{a}", f"n{b}") for a, b in edges]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[top(a)] = top(b)
    want = sorted(sorted(x for x in parent if top(x) == t) for t in {top(x) for x in parent})
    written = []
    plain = components.materialize
    monkeypatch.setitem(components.components.__globals__, "materialize", lambda df, name: written.append(name) or plain(df, name))
    labels = set()
    for rows, most in ((components.EDGES, 4), (100, 8)):  # tables written: few rounds, also if each task holds few edges
        written.clear()
        got = components.components(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(7), rows).collect()
        sets = {}
        for node, label in got:
            sets.setdefault(label, []).append(node)
        assert sorted(sorted(s) for s in sets.values()) == want and all(label in s for label, s in sets.items())
        assert len(written) <= most
        labels.add(tuple(sorted(got)))
    assert len(labels) == 1  # labels don't depend on how the edges are dealt


def test_forest():
    a, b = np.array([5, 3, 9, 2, 9]), np.array([4, 4, 8, 2, 9])
    assert components.forest(a, b, 10).tolist() == [0, 1, 2, 3, 3, 3, 6, 7, 8, 8]
    assert components.forest(np.arange(999), np.arange(1, 1000), 1000).tolist() == [0] * 1000
    assert components.forest(np.empty(0, np.int64), np.empty(0, np.int64), 2).tolist() == [0, 1]
