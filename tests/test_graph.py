"""Hand-computed fixtures of the graph, status, alignment and score operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.operators import clustering as U
from claimweave.operators import compile as K
from claimweave.operators import graph as G
from claimweave.operators import methodology as M
from claimweave.operators import reconcile as Q
from claimweave.operators.components import components
from claimweave.operators.similarity import jaccard_pairs, vector_pairs

from .conftest import rows

ATT = "node_id string, source_id string, author string, quote string"
EDGE = "src string, dst string, type string, strength double"


def att(spark, pairs):
    return spark.createDataFrame([(n, s, None, "q") for n, s in pairs], ATT)


def test_status_ladder(spark):
    a = att(spark, [("n1", "s1"), ("n1", "s2"), ("n1", "s3"), ("n2", "s4"), ("n3", "s1"), ("n3", "s2"), ("n3", " s2 "), ("n3", " ")])
    e = spark.createDataFrame([("n2", "n1", "contradicts", 0.60), ("n2", "n3", "contradicts", 0.50)], EDGE)
    out = Q.epistemic_fields(spark.createDataFrame([("n1",), ("n2",), ("n3",), ("n4",)], "id string"), a, e)
    assert rows(out) == [("n1", 3, 1, 0, "contested"), ("n2", 1, 0, 0, "single_source"), ("n3", 2, 0, 1, "contested_weak"), ("n4", 0, 0, 0, "single_source")]


def test_alignment(spark):
    cc = spark.createDataFrame([("c0", "a"), ("c0", "b"), ("c1", "x")], "crux string, claim_id string")
    pc = spark.createDataFrame([("p0", x) for x in "abcd"] + [("p1", "e")], "q string, claim_id string")
    m = K.best_matches(cc, pc)
    assert rows(m) == [("c0", "p0", 0.5, 2), ("c1", None, 0.0, 0)]
    p = spark.createDataFrame([("p0", "contested", 30, 3), ("p1", "contested", 10, 2)], "q string, status string, edge_count long, n_sources long")
    for floor in (0.0, C.DEFAULT.jaccard_floor):
        d = K.disputes(p, m, floor)
        assert d.where("covered").agg(F.sum("edge_count")).first()[0] == 30 and d.agg(F.sum("edge_count")).first()[0] == 40


def test_methodology_score(spark):
    ev = spark.createDataFrame([("s", "a", "declared"), ("s", "b", "not_declared"), ("s", "c", "not_applicable"), ("s", "d", "declared"), ("t", "a", "not_applicable")], "source_id string, criterion_id string, status string")
    cr = spark.createDataFrame([("a", "FATAL"), ("b", "MAJOR"), ("c", "MINOR")], "criterion_id string, severity string")
    hits = spark.createDataFrame([("s", 2)], "source_id string, n long")
    assert rows(M.methodology_scores(ev, cr, hits, 0.65).select("source_id", "score")) == [("s", 0.647), ("t", 0.0)]


def groups(df):
    out = {}
    for i, g in df.collect():
        out.setdefault(g, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("limit", [12, 0])
def test_conflicts_split_a_component(spark, limit):
    ok = spark.createDataFrame([("a", "b", 0.80), ("b", "c", 0.76)], "a string, b string, sim double")
    none = spark.createDataFrame([], "a string, b string")
    assert groups(U.merge_groups(ok, none, limit)) == [["a", "b", "c"]]
    assert groups(U.merge_groups(ok, spark.createDataFrame([("c", "a")], "a string, b string"), limit)) == [["a", "b"]]


def test_groups_never_hold_a_conflict(spark):
    random.seed(5)
    ids = [f"n{k:02d}" for k in range(40)]
    sims = {tuple(sorted(random.sample(ids, 2))): random.random() for _ in range(60)}
    bad = {tuple(sorted(random.sample(ids, 2))) for _ in range(40)}
    got = groups(U.merge_groups(spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a string, b string, sim double"), spark.createDataFrame(list(bad), "a string, b string")))
    assert all((a, b) not in bad for g in got for k, a in enumerate(g) for b in g[k + 1 :])


def circle(deg):
    import math

    return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]


def items(spark, degrees):
    return spark.createDataFrame([(k, k, circle(d) if d is not None else None) for k, d in enumerate(degrees)], "id long, ord long, v array<double>")


def test_seed_clusters_are_not_components(spark):
    out = U.seed_clusters(items(spark, [0, 36, 72, None]), 0.75)
    assert rows(out) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_leader_takes_the_best_seed(spark):
    assert rows(U.seed_clusters(items(spark, [0, 50, 30]), 0.8, first_match=False)) == [(0, 0), (1, 1), (2, 1)]


def test_centroid_clusters_drift(spark):
    assert rows(U.centroid_clusters(items(spark, [0, 30, 50, 180]), 0.75)) == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_merged_centroids_meet_across_blocks(spark):
    """Two halves whose members lie below the squared threshold reach the threshold once their blocks are fused."""
    block = np.arange(48) // 12
    gram = np.where(block[:, None] == block, 0.48, np.where(block[:, None] // 2 == block // 2, 0.24, 0.19))
    np.fill_diagonal(gram, 1.0)
    v = np.linalg.cholesky(gram)
    c = spark.createDataFrame([(k, 1, [float(x) for x in v[k]]) for k in range(48)], "cluster bigint, n int, total array<double>")
    assert {m for _, m in U.merged_centroids(c, 0.45).collect()} == {0}


def test_fused_equals_the_plain_loop():
    rng = np.random.default_rng(7)
    for t in (0.2, 0.45, 0.7):
        total = rng.normal(size=(60, 5))
        work = {k: [k] for k in range(60)}
        while len(work) > 1:
            keys = sorted(work)
            u = np.array([total[work[k]].sum(axis=0) for k in keys])
            u /= np.linalg.norm(u, axis=1)[:, None]
            sims = np.where(np.triu(np.ones((len(keys), len(keys))), 1) > 0, u @ u.T, -2)
            i, j = np.unravel_index(int(np.argmax(sims)), sims.shape)
            if sims[i, j] < t:
                break
            work[keys[i]] += work.pop(keys[j])
        want = {m: k for k, g in work.items() for m in g}
        assert dict(enumerate(U.fused(total, t).tolist())) == want


def test_joined_equals_the_plain_loop():
    """Clusters by moving centroids over places only, against whole vectors."""
    rng = np.random.default_rng(8)
    v = np.where(rng.random((300, 20)) < 0.2, rng.integers(1, 3, (300, 20)), 0).astype(float)
    v = v[v.any(axis=1)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    for t in (0.5, 0.78):
        sums, first, want = [], [], []
        for i in range(len(v)):
            sims = [round(float(s @ v[i]) / float(np.linalg.norm(s)), 12) for s in sums]
            k = int(np.argmax(sims)) if sims else -1
            if k >= 0 and sims[k] >= t:
                sums[k] = sums[k] + v[i]
            else:
                k = len(sums)
                sums.append(v[i])
                first.append(i)
            want.append(first[k])
        places = [np.flatnonzero(x) for x in v]
        assert U.joined(places, [x[p] for x, p in zip(v, places)], 20, t).tolist() == want


def test_merged_centroids_leave_no_close_pair(spark):
    c = spark.createDataFrame([(k, circle(d)) for k, d in enumerate([0, 20, 90, 100, 200])], "cluster long, total array<double>")
    got = dict(U.merged_centroids(c, 0.9).collect())
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_vector_pairs_in_blocks(spark):
    random.seed(1)
    deg = [random.uniform(0, 360) for _ in range(60)]
    import math

    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 0.9 <= math.cos(math.radians(deg[a] - deg[b])) <= 0.99}
    for block in (2048, 12):
        got = vector_pairs(items(spark, deg), "id", "v", 0.9, 0.99, block)
        assert {(r["a"], r["b"]) for r in got.collect()} == want
    assert vector_pairs(items(spark, [None]), "id", "v", 0.1).count() == 0


def test_vector_pairs_at_the_threshold(spark):
    """Vectors whose products lie exactly at the threshold come out, whatever the last binary digit, in any number of blocks."""
    rng = np.random.default_rng(6)
    have = np.array([rng.permutation(np.arange(18) < 12) for _ in range(300)])
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if (have[a] & have[b]).sum() >= 9}
    df = spark.createDataFrame([(k, [float(y) for y in x / np.sqrt(12)]) for k, x in enumerate(have)], "id long, v array<double>")
    for block in (None, 90):
        assert {(r["a"], r["b"]) for r in vector_pairs(df, "id", "v", 0.75, block=block).collect()} == want


def test_jaccard_pairs_are_exact(spark):
    random.seed(7)
    sets = [(k, random.sample("abcdefghijklmnop", random.randint(1, 9))) for k in range(60)]
    df = spark.createDataFrame(sets, "id long, tokens array<string>")
    for t in (0.2, 0.5, 1.0):
        want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) >= t * len(set(x) | set(y)) - 1e-9}
        assert {(r["a"], r["b"]) for r in jaccard_pairs(df, df, t, same=True).collect()} == want


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a int, b int")
    got = dict(components(e).collect())
    assert set(got.values()) == {0, 100} and len(got) == 53
    assert components(e.limit(0)).count() == 0


def test_redirect_drops_loops(spark):
    ids = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, canonical string")
    e = spark.createDataFrame([("a", "b", "supports", 0.5), ("c", "b", "supports", 0.6), ("c", "a", "supports", 0.7)], EDGE)
    assert rows(G.redirected(e, ids)) == [("c", "a", "supports", 0.7)]


def test_guard(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    cols = "src string, rel_ord int, type string, dst string, strength double, rationale string, source string, shared_question string, created_at timestamp"
    r = spark.createDataFrame([("A ", 1, "Supports", "b", 0.1, None, None, None, None), ("a", 0, "supports", "b", None, None, None, None, None), ("a", 0, "requires", "b", 0.1, None, None, None, None), ("a", 0, "supports", "a", 0.1, None, None, None, None), ("a", 0, "supports", "zz", 0.1, None, None, None, None)], cols)
    assert rows(G.guarded_relations(r, n).select("src", "dst", "type", "strength")) == [("a", "b", "supports", None)]


def test_ranges(spark):
    df = spark.createDataFrame([("g", n) for n in (1, 2, 5, 6, 7, 8, 10, 10)], "g string, n int")
    assert rows(K.ranges(df, "g", "n")) == [("g", "§1–§2, §5–§8, §10")]


def test_buckets(spark):
    df = spark.createDataFrame([(0.70,), (0.1,), (1.0,), (0.95,)], "s double").select(Q.strength_bucket(F.col("s")).alias("b"))
    assert [r[0] for r in df.collect()] == [5, 0, 11, 10]


def test_importance_formula(spark):
    df = spark.createDataFrame([(57, 6, 152, 6, 100, 100)], "high_value_unique int, crux_exclusive_count int, unique_claims_count int, crux_claims_count int, claims_count int, evidence_count int")
    assert df.select(K.importance_tier()).first()[0] == "central"
    assert 2.0 * 57 + 3.0 * 6 + 0.5 * 152 + 0.25 * 6 == 209.5


def test_budget(spark):
    df = spark.createDataFrame([("g", 1, 50), ("g", 2, 60), ("g", 3, 10)], "g string, o int, n int")
    assert [r["kept"] for r in K.running_budget(df, "g", ["o"], "n", 100).orderBy("o").collect()] == [50, 48, 0]


def test_pair_sources(spark):
    a = att(spark, [("a", "s1"), ("b", "s2"), ("c", "s1")])
    n = spark.createDataFrame([("a", "X"), ("b", " x "), ("c", None)], "id string, source_author string")
    p = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    assert rows(Q.cross_source_pairs(p, a, n)) == [("a", "b", True, False, True), ("a", "c", False, True, False)]


def test_expand_stops_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = rows(G.expand(spark.createDataFrame([("a",)], "id string"), e, 3))
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_no_machine_local_folder_on_a_cluster():
    """Without spark.checkpoint.dir a non-local master is an error, not a temporary folder."""
    from types import SimpleNamespace

    import pytest

    from claimweave.runtime import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master="spark://host:7077", applicationId="app", getConf=lambda: conf)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_keyed_join_splits_hot_keys(spark):
    """A third of all rows on one key; unknown and null keys stay in a left join."""
    from pyspark.sql import functions as F

    from claimweave.runtime import keyed_join

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 100 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    dim = rows.where("k IS NOT NULL AND k % 2 = 0").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    plain = sorted(map(tuple, rows.join(dim.drop("n"), "k", "left").collect()), key=str)
    assert sorted(map(tuple, keyed_join(rows, dim, "k", "left", hot=50).select("k", "id", "top").collect()), key=str) == plain
    assert keyed_join(rows, dim, "k", hot=50).count() == rows.join(dim, "k").count()


def test_indexed_vector_pairs_reach_their_recall(spark, monkeypatch):
    """Near-duplicate vectors against brute force: recall at least 0.9, nothing false; a third of all vectors in one cell."""
    from claimweave.operators import similarity as M

    monkeypatch.setattr(M, "BLOCK", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    v = np.concatenate([base, base + 0.35 * rng.normal(size=base.shape), np.repeat(base[:1], 150, axis=0) + 0.1 * rng.normal(size=(150, 32))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "id long, v array<double>")
    sims = v @ v.T
    want = {(a, b) for a in range(450) for b in range(a + 1, 450) if sims[a, b] >= 0.8}
    assert M.tables_for(450, 0.8, 0.95)[0] > 0
    got = {(r["a"], r["b"]) for r in M.vector_pairs(df, "id", "v", 0.8, block=40, recall=0.95).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_covered_is_existence(spark):
    from claimweave.operators.similarity import covered, set_pairs

    random.seed(11)
    left = [(k, random.sample("abcdefghijklmnopqrst", random.randint(1, 12))) for k in range(80)]
    right = [(k, random.sample("abcdefghijklmnopqrst", random.randint(1, 9))) for k in range(30)]
    x, y = (spark.createDataFrame(r, "id long, tokens array<string>") for r in (left, right))
    for t in (0.3, 0.6):
        want = {a for a, p in left for _, q in right if len(set(p) & set(q)) >= t * len(set(p) | set(q)) - 1e-9}
        assert {r["a"] for r in covered(x, y, t, rounds=(1, 3)).collect()} == want
        cos = {(a, b) for a, p in left for b, q in right if len(set(p) & set(q)) >= t * (len(p) * len(q)) ** 0.5 - 1e-9}
        assert {(r["a"], r["b"]) for r in set_pairs(x, y, t, cosine=True).collect()} == cos
    assert covered(x.limit(0), y, 0.5).count() == 0


def test_covered_rows_settle_frequent_tokens_in_arrays(spark, monkeypatch):
    """Sets that all share frequent tokens: no pair that only meets becomes a row of a table, whatever the blocks."""
    from claimweave.operators import similarity as M

    rng = np.random.default_rng(2)
    monkeypatch.setattr(M, "_met", lambda *_: pytest.fail("pairs that meet were made rows"))
    draw = lambda n, low, high: [(k, [f"w{x}" for x in rng.choice(60, int(rng.integers(low, high)), False)]) for k in range(n)]
    left, right = draw(300, 5, 40), draw(200, 2, 12)
    want = {a for a, p in left for _, q in right if len(set(p) & set(q)) >= 0.28 * len(set(p) | set(q)) - 1e-9}
    assert 0 < len(want) < 300
    x, y = (spark.createDataFrame(r, "id long, tokens array<string>") for r in (left, right))
    for blocks in ((1 << 17, 700_000), (70, 60)):
        assert {r["a"] for r in M.covered(x, y, 0.28, blocks=blocks).collect()} == want


@pytest.mark.parametrize("rare", [0, 128])
def test_like_pairs_of_frequent_tokens(spark, rare):
    """Sets of 40 tokens in all, against brute force: single and double keys, several blocks, kinds and tags."""
    from claimweave.operators import setblocks as B
    from claimweave.operators import similarity as M

    rng = np.random.default_rng(9)
    sets = [(f"n{k:03d}", "xy"[k % 2], [f"{'xy'[k % 2]}{x}" for x in rng.choice(40, int(rng.integers(1, 25)), False)], [f"s{x}" for x in rng.choice(9, int(rng.integers(1, 3)), False)]) for k in range(260)]
    df = spark.createDataFrame(sets, "id string, kind string, tokens array<string>, tags array<string>")
    old, B.RARE = B.RARE, rare
    try:
        p = np.concatenate([[0], np.cumsum([len(s[2]) for s in sets])])
        flat = np.array([hash(w) for s in sets for w in s[2]])
        t = 0.5
        need = lambda m, n: np.ceil(t * np.sqrt(m * n) - 1e-9).astype(np.int64)
        a, b, _ = B.like_rows((flat, p), (flat, p), need, lambda n: np.maximum(1, np.ceil(t * t * n)), same=True)
    finally:
        B.RARE = old
    near = {(x[0], y[0]) for i, x in enumerate(sets) for y in sets[i + 1 :] if len(set(x[2]) & set(y[2])) >= t * (len(x[2]) * len(y[2])) ** 0.5 - 1e-9}
    assert {(sets[i][0], sets[j][0]) for i, j in zip(a, b)} == near
    tags = {s[0]: set(s[3]) for s in sets}
    for block in (1 << 17, 20):
        got = M.like_pairs(df, t, cosine=True, block=block).collect()
        assert len(got) == len(near) and {(r["a"], r["b"]) for r in got} == near
        got = M.like_pairs(df, t, cosine=True, apart=True, block=block).collect()
        assert {(r["a"], r["b"]) for r in got} == {p for p in near if not tags[p[0]] & tags[p[1]]}
    jac = {(x[0], y[0]) for i, x in enumerate(sets) for y in sets[i + 1 :] if len(set(x[2]) & set(y[2])) >= 0.4 * len(set(x[2]) | set(y[2])) - 1e-9}
    assert {(r["a"], r["b"]) for r in M.like_pairs(df, 0.4, block=30).collect()} == jac


def test_like_pairs_write_each_row_once(spark, monkeypatch):
    """However many blocks there are: one written table with a row per record, and no copy of a block is sent to what it meets."""
    from claimweave.operators import similarity as M

    rng = np.random.default_rng(4)
    sets = [(f"n{k:03d}", "xyz"[k % 3], [f"{'xyz'[k % 3]}{x}" for x in rng.choice(30, int(rng.integers(1, 12)), False)]) for k in range(300)]
    written, stash = [], M.stash
    monkeypatch.setattr(M, "stash", lambda *a: written.append(stash(*a)) or written[-1])
    df = spark.createDataFrame(sets, "id string, kind string, tokens array<string>").repartition(7)
    pairs = M.like_pairs(df, 0.5, block=9)
    plan = pairs._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert [w.count() for w in written] == [300]
    want = {(x[0], y[0]) for i, x in enumerate(sets) for y in sets[i + 1 :] if len(set(x[2]) & set(y[2])) >= 0.5 * len(set(x[2]) | set(y[2])) - 1e-9}
    got = pairs.collect()
    assert len(got) == len(want) > 0 and {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("first_match", [True, False])
def test_seed_clusters_equal_the_scan(spark, first_match):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(70, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    order = rng.permutation(70)
    seeds, want = [], {}
    for k in np.argsort(order):
        ok = [s for s in seeds if v[s] @ v[k] >= 0.7]
        want[int(k)] = int(k) if not ok else int(ok[0] if first_match else max(ok, key=lambda s: v[s] @ v[k]))
        seeds += [] if ok else [int(k)]
    df = spark.createDataFrame([(k, int(order[k]), [float(x) for x in v[k]]) for k in range(70)], "id long, ord long, v array<double>")
    assert dict(U.seed_clusters(df, 0.7, first_match).collect()) == want


def test_best_partition_equals_all_partitions():
    def brute(members, sims, bad):
        best, top = None, -1.0

        def grow(k, groups):
            nonlocal best, top
            if k == len(members):
                score = sum(sims.get((a, b), 0) for g in groups for i, a in enumerate(g) for b in g[i + 1 :])
                if score > top + 1e-9:
                    best, top = [list(g) for g in groups], score
                return
            for g in [*groups, None]:
                if g is None:
                    grow(k + 1, [*groups, [members[k]]])
                elif all((x, members[k]) not in bad for x in g):
                    grow(k + 1, [[*h, members[k]] if h is g else h for h in groups])

        grow(0, [])
        return best

    random.seed(3)
    for _ in range(40):
        members = list("abcdef")
        pairs = [(a, b) for i, a in enumerate(members) for b in members[i + 1 :]]
        sims = {p: random.choice([0.5, 0.75, 0.8]) for p in random.sample(pairs, 6)}
        bad = set(random.sample(pairs, 4)) - set(list(sims)[:2])
        assert U.best_partition(members, {p: s for p, s in sims.items() if p not in bad}, bad) == brute(members, {p: s for p, s in sims.items() if p not in bad}, bad)


def test_components_of_a_long_shuffled_chain(spark):
    """A chain of 600 vertices in random order settles in few rounds."""
    order = list(range(600))
    random.Random(8).shuffle(order)
    e = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = components(e, rounds=20).collect()
    assert len(got) == 600 and {c for _, c in got} == {0}
