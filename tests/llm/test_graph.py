import random

from sievestone.llm._graph import connected_components


def least_reachable(links):
    up = {x: x for link in links for x in link}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {(x, find(x)) for x in up}


def test_chains_stars_and_random_links(spark):
    rng = random.Random(3)
    back = [1, *range(3000, 1, -1)]  # the least node at the far end of a falling chain
    mixed = rng.sample(range(10_000, 20_000), 3000)
    links = list(zip(back, back[1:])) + list(zip(mixed, mixed[1:]))
    links += [(40_500, 40_000 + k) for k in range(1000) if k != 500]
    links += [(rng.randrange(50_000, 50_400), rng.randrange(50_000, 50_400)) for _ in range(250)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(x, c) for x, c in least_reachable([k for k in links if k[0] != k[1]])}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0
