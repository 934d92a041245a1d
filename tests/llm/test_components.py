import random

from claimweave.llm.components import same_as_groups, seed_tree_components


def union(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            p[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in list(p)}


def check(spark, edges):
    got = set(map(tuple, seed_tree_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()))
    assert got == union(edges)


def test_chain_star_and_random_graphs(spark):
    random.seed(2)
    chain = [(k, k + 1) for k in range(200)]
    random.shuffle(chain)
    check(spark, chain)
    check(spark, [(500, k) for k in range(300)])
    check(spark, [(random.randrange(400), random.randrange(400)) for _ in range(300)])


def test_loops_repeats_nulls_and_reversed(spark):
    check(spark, [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (9, 8), (8, 7)])


def test_empty(spark):
    assert seed_tree_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_same_as(spark):
    rel = spark.createDataFrame(
        [("A1 ", "same as", " b2"), ("b2", "SAME-AS", "c3"), ("c3", "distinct", "d4"), ("d4", "same_as", "zz"), ("d4", "same_as", "d4"), (None, "same_as", "a1"), ("e5", None, "a1")],
        "src string, type string, dst string",
    )
    nodes = spark.createDataFrame([("a1", 1), ("b2", 2), ("c3", 3), ("d4", 4), ("e5", 5), (None, 6)], "id string, group_id int")
    assert set(map(tuple, same_as_groups(rel, nodes).collect())) == {("a1", "a1"), ("b2", "a1"), ("c3", "a1")}
