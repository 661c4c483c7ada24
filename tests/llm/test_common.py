import random

import pytest
from millrace.llm.common import checked_broadcast, components, cut, shared_dir

from .helpers import union_find


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty", "loops"])
@pytest.mark.parametrize("last", [0, 10_000])
def test_components(spark, shape, last):
    r = random.Random(shape)
    links = {
        "random": [(r.randrange(400), r.randrange(400)) for _ in range(300)],
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(7, i) for i in range(300)] + [(i, 7) for i in range(50)],
        "empty": [],
        "loops": [(3, 3), (4, 4)],
    }[shape]
    got = components(spark.createDataFrame(links, "a long, b long"), last_links=last).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got} == union_find(nodes, [x for x in links if x[0] != x[1]])
    assert len(got) == len(nodes)


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert cut(spark.range(3)).count() == 3


def test_broadcast_is_bounded(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(checked_broadcast(spark.range(5), 5)).lower()
    assert "broadcast" not in plan(checked_broadcast(spark.range(6), 5)).lower()
