import random

from filigrane.llm import state
from filigrane.llm.components import components


def test_paths_cycles_and_hubs(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7), (5001, 5000)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)} | {5000: 5000, 5001: 5000, 5002: 5000}


def test_empty(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_the_session_names_the_folder(spark):
    assert state.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
