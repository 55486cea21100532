import random

from ferrule.llm import common, components


def test_components_in_rounds_and_in_one_task(spark, monkeypatch):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(20)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5), (None, 3), (1 << 40, 7)]
    forest, nodes = {}, {x for a, b in links if a is not None and a != b for x in (a, b)}

    def find(x):
        while forest.get(x, x) != x:
            x = forest[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            forest[max(a, b)] = min(a, b)
    want = {x: find(x) for x in nodes}
    edges = spark.createDataFrame(links + [(b, a) for a, b in links[:40]], "a long, b long")
    plans = []

    def watched(df, *, keep=None, whole=components.materialise):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return whole(df, keep=keep)

    monkeypatch.setattr(components, "materialise", watched)
    for local, hubs, joins in ((components.LOCAL, common.HUBS, 0), (0, 2, 4)):
        monkeypatch.setattr(components, "LOCAL", local)
        monkeypatch.setattr(common, "HUBS", hubs)
        plans.clear()
        assert {r.node: r.component for r in components.components(edges, "a", "b").collect()} == want
        assert max(plans) <= joins, plans
    assert components.components(edges.where("a < 0"), "a", "b").count() == 0
