"""Components of long ways, and what is left in the shared folder."""

import os
import random

from sheetlens.plans import graph


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    """Ways whose numbers are in no order; groups don't mix, and a node linked to itself alone is a component."""
    monkeypatch.setattr(graph, "MAX_ROUNDS", 16)
    rng, rows, want = random.Random(7), [(9, 5, 5)], {(9, 5): 5}
    for page, n in ((0, 3000), (1, 2), (2, 40)):
        order = rng.sample(range(10 * n), n)
        rows += [(page, a, b) for a, b in zip(order, order[1:])]
        want |= {(page, node): min(order) for node in order}
    edges = spark.createDataFrame(rows, "page long, a long, b long")
    assert {(r.page, r.node): r.component for r in graph.connected(edges, ["page"]).collect()} == want
    assert graph.connected(edges.where("page > 9"), ["page"]).count() == 0


def test_released_tables_are_gone(spark):
    one = graph.stored(spark.range(10).repartition(3))
    files = one.inputFiles()
    graph.release(one)
    assert files and all(not os.path.exists(f.removeprefix("file://")) for f in files)
