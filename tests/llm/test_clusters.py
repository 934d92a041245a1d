import random
import re

from claimweave.llm import clusters as C

random.seed(9)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word():
    return "".join(random.choices(LETTERS, k=8))


COMMON = [word() for _ in range(300)]


def corpus(sizes):
    out = []
    for g, size in enumerate(sizes):
        core = [word() for _ in range(5)] + random.sample(COMMON, 11)
        for k in range(size):
            w = core[:]
            w[random.randrange(16)] = random.choice(COMMON)
            out.append((f"{g:02d}-{k:03d}", " ".join(w + random.sample(COMMON, 8))))
    random.shuffle(out)
    return out


def truth(rows, t=0.3):
    sets = [(i, frozenset(re.findall("[a-z]{4,}", (c or "").lower()))) for i, c in rows]
    p = {i: i for i, w in sets if w}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and len(x & y) >= t * len(x | y):
                p[max(find(a), find(b))] = min(find(a), find(b))
    return {(i, find(i)) for i in p}


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, content string").repartition(5)
    return C.similarity_clusters(df, "id", "content", **kw)


def test_clusters_of_many_sizes(spark):
    rows = corpus([1, 1, 2, 3, 4, 7, 12, 60, 1, 3])
    got = {(r["id"], r["cluster_id"]) for r in found(spark, rows).collect()}
    assert got == truth(rows)


def test_sizes_and_typical_members(spark):
    rows = corpus([9, 3])
    out = found(spark, rows)
    top = C.described(out).collect()
    assert {r["size"] for r in top} == {9, 3} and max(r["rank"] for r in top) == 5
    best = {}
    for r in out.collect():
        best[r["cluster_id"]] = max(best.get(r["cluster_id"], 0), r["near"])
    assert all(abs(r["near"] - best[r["cluster_id"]]) < 1e-5 for r in top if r["rank"] == 1)


def test_nulls_blanks_repeats_and_empty(spark):
    rows = [("a", None), ("b", " "), (None, "alpha beta gamma"), ("c", "alpha beta gamma"), ("c", "alpha beta gamma"), ("d", "alpha beta gamma"), ("e", "other words entirely")]
    got = {(r["id"], r["cluster_id"], r["size"]) for r in found(spark, rows).collect()}
    assert got == {("c", "c", 2), ("d", "c", 2), ("e", "e", 1)}
    assert found(spark, []).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", "alpha beta gamma", 1, 2, 3)], "id string, content string, cluster int, leaf int, cid int")
    assert C.similarity_clusters(df, "id", "content").count() == 1


def test_parity_bound():
    for _ in range(200):
        w = [random.getrandbits(63) for _ in range(40)]
        k = random.randrange(1, 39)
        a, b = set(w[:k]), set(w[max(0, k - 8) :])
        assert (C.odd_bits(a) ^ C.odd_bits(b)).bit_count() <= len(a ^ b)


def test_nothing_is_lost_where_the_short_cuts_overflow(spark):
    """Filed under no word, with lists of one leaf and a cluster of a third of all rows: recall and precision stay 1."""
    rows = corpus([1, 90, 2, 3, 40, 7, 30, 60, 1, 3, *[1] * 20])
    got = {(r["id"], r["cluster_id"]) for r in found(spark, rows, filing=(0, 0), shelves=(1, 1)).collect()}
    assert got == truth(rows)


def test_exact_links_match_brute_force_with_hot_words(spark):
    rows = corpus([5, 9, 1, 1, 2])
    sets = [(k, sorted(hash(w) for w in set(c.split()))) for k, (_, c) in enumerate(rows)]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) >= 0.3 * len(set(x) | set(y)) - 1e-9}
    df = spark.createDataFrame(sets, "id bigint, words array<bigint>")
    for hot in (2, 1024):
        assert {(r["a"], r["b"]) for r in C.exact_links(df, 0.3, hot).collect()} == want


def test_ward_cost_is_the_rise_of_the_squared_error():
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 2, (5, 12)).astype(float), np.repeat(rng.integers(0, 2, (1, 12)), 3, axis=0).astype(float)
    error = lambda m: ((m - m.mean(axis=0)) ** 2).sum()
    sums = x.sum(axis=0)
    got = C.ward_cost(3, int(y[0].sum()), 5, float((sums**2).sum()), float(sums @ y[0]))
    assert abs(got - (error(np.vstack([x, y])) - error(x) - error(y))) < 1e-9


def test_labels_describe_clusters(spark):
    rows = corpus([6, 4])
    ids = sorted(i for i, _ in rows)
    labels = spark.createDataFrame([(i, "x" if k % 3 else "y") for k, i in enumerate(ids)] + [(ids[0], None)], "id string, label string")
    top = C.described(found(spark, rows), labels).collect()
    assert {r["label"] for r in top} == {"x"} and all(0.5 <= r["label_share"] <= 1 for r in top)
