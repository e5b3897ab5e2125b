import random

from polyspark.llm.common import connected_components
from tests.llm.conftest import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(5, 5), (None, 3), (300, 299)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    root = components(301, real)
    assert got == {i: root[i] for i in {x for e in real for x in e}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
