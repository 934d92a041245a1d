"""Leader, seed and centroid clusterings and clique partitions over threshold graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.operators.components import components
from claimweave.operators.similarity import vector_pairs
from claimweave.runtime import ship, stash


def seed_clusters(items: DataFrame, threshold: float, first_match: bool = True, label: str = "seed", recall: float | None = None, rounds: int = 200) -> DataFrame:
    """(id, seed): items in order of (ord, id); an item not yet taken opens a cluster and takes all later ones at or above
    the threshold to the seed. With first_match False each item joins its most similar seed instead (leader clustering).

    items is (id bigint, ord bigint, v array); an item without vector is its own cluster. The sequential scan is settled in
    rounds over the edges of the threshold graph: an item is a seed once all its earlier neighbours are known to be none, and
    joins a seed once no earlier neighbour could still take it. No component is gathered. recall: see vector_pairs.
    """
    have = items.where("v IS NOT NULL").select("id", "ord")
    pairs = vector_pairs(items.where("v IS NOT NULL"), "id", "v", threshold, recall=recall)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    at = have.select(F.col("id").alias("a"), F.col("ord").alias("oa")), have.select(F.col("id").alias("b"), F.col("ord").alias("ob"))
    # earlier neighbours b of each item a
    before = stash(both.join(at[0], "a").join(at[1], "b").where("ob < oa OR (ob = oa AND b < a)").select("a", "b", "ob", "sim"), label + "-e")
    known = stash(have.join(before.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select("id", F.col("id").alias("seed")), label + "-0")
    for k in range(rounds):
        open_ = before.join(known.select(F.col("id").alias("a")), "a", "left_anti")
        if not open_.limit(1).count():
            return known.unionByName(items.where("v IS NULL").select("id", F.col("id").alias("seed")))
        state = open_.join(known.select(F.col("id").alias("b"), (F.col("seed") == F.col("id")).alias("is_seed")), "b", "left")
        place = F.struct("ob", "b")
        seen = state.groupBy("a").agg(
            F.min(F.when(F.col("is_seed"), place)).alias("first"),
            F.min(F.when(F.col("is_seed").isNull(), place)).alias("unsure"),
            F.min(F.when(F.col("is_seed"), F.struct(-F.col("sim"), F.col("ob"), F.col("b")))).alias("best"),
        )
        none = F.col("unsure").isNull()
        if first_match:
            settled = F.when(F.col("first").isNotNull() & (none | (F.col("first") < F.col("unsure"))), F.col("first.b")).when(F.col("first").isNull() & none, F.col("a"))
        else:
            settled = F.when(none, F.coalesce(F.col("best.b"), F.col("a")))
        fresh = seen.select(F.col("a").alias("id"), settled.alias("seed")).where("seed IS NOT NULL")
        known = stash(known.unionByName(fresh), f"{label}-{k + 1}")
    raise RuntimeError(f"seeds did not settle in {rounds} rounds")


def joined(places: list[np.ndarray], values: list[np.ndarray], dims: int, threshold: float) -> np.ndarray:
    """For each vector in order, given by the places and values that are not zero, the first member of the cluster it joins: the
    one with the most similar normalised sum at or above the threshold, of equals the earliest, or one of its own.

    Normalised sums are held by place, so that a vector is compared with all clusters over its own places only.
    """
    n = len(places)
    unit, total = np.zeros((dims, 64)), []
    first, out = [], np.empty(n, np.int64)
    for i, (p, x) in enumerate(zip(places, values)):
        c = len(first)
        sims = np.round(x @ unit[p, :c], 12) if c else np.zeros(0)
        k = int(np.argmax(sims)) if c else -1
        if k < 0 or sims[k] < threshold:
            k = c
            first.append(i)
            total.append({})
            if c == unit.shape[1]:
                unit = np.concatenate([unit, np.zeros((dims, 64 + c // 4))], axis=1)
        own = total[k]
        for q, y in zip(p.tolist(), x.tolist()):
            own[q] = own.get(q, 0.0) + y
        v = np.fromiter(own.values(), float, len(own))
        unit[np.fromiter(own, np.int64, len(own)), k] = v / (float(np.linalg.norm(v)) or 1.0)
        out[i] = first[k]
    return out


def centroid_clusters(items: DataFrame, threshold: float, label: str = "centroid") -> DataFrame:
    """(id, cluster): each item, in order, joins the cluster with the most similar normalised mean at or above the threshold,
    or opens one; cluster is its first item. Sequential by definition, so one task has the places that are not zero of all."""
    ship(items.sparkSession)
    have = items.where("v IS NOT NULL")
    kept = F.filter(F.transform("v", lambda x, p: F.struct(p.alias("p"), x.cast("double").alias("x"))), lambda e: e["x"] != 0)
    rows = have.select("id", "ord", F.size("v").alias("dims"), kept.alias("e")).select("id", "ord", "dims", F.col("e.p").alias("p"), F.col("e.x").alias("x"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ord", "id"], kind="stable").reset_index(drop=True)
        ids = frame["id"].to_numpy()
        return pd.DataFrame({"id": ids, "cluster": ids[joined(frame["p"].tolist(), frame["x"].tolist(), int(frame["dims"].max()), threshold)]})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "id bigint, cluster bigint")


def fused(total: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of total the row it ends in: the closest pair of normalised rows is fused while it is at or above the
    threshold, of equals (to twelve digits) the earliest. Each row keeps its best later row only, so that memory grows with the
    rows alone, and is compared with others over the places that it has."""
    k = len(total)
    total, goes = total.copy(), np.arange(k)
    norm = np.linalg.norm(total, axis=1)
    unit = np.ascontiguousarray((total / np.where(norm > 0, norm, 1.0)[:, None]).T)  # by place
    alive, best, to = np.ones(k, dtype=bool), np.full(k, -np.inf), np.zeros(k, dtype=int)

    def near(r: int, part: slice) -> np.ndarray:
        p = np.flatnonzero(unit[:, r])
        out = np.zeros(len(range(*part.indices(k))))
        for q in p.tolist():
            out += unit[q, r] * unit[q, part]
        return np.round(out, 12)

    def seek(r: int) -> None:
        best[r] = -np.inf
        if r + 1 < k:
            sims = np.where(alive[r + 1 :], near(r, slice(r + 1, k)), -np.inf)
            m = int(np.argmax(sims))
            best[r], to[r] = sims[m], r + 1 + m

    for r in range(k):
        seek(r)
    while k:
        i = int(np.argmax(best))
        if best[i] < threshold or not np.isfinite(best[i]):
            break
        j = int(to[i])
        total[i] += total[j]
        unit[:, i] = total[i] / (np.linalg.norm(total[i]) or 1.0)
        alive[j], best[j] = False, -np.inf
        goes[goes == j] = i
        sims = near(i, slice(0, i))
        nearer = np.flatnonzero(alive[:i] & ((sims > best[:i]) | ((sims == best[:i]) & (i < to[:i]))))
        stale = alive & ((to == i) | (to == j)) & np.isfinite(best)
        best[nearer], to[nearer] = sims[nearer], i
        stale[nearer] = False
        stale[i] = True
        for r in np.flatnonzero(stale):
            seek(int(r))
    return goes


def merged_centroids(clusters: DataFrame, threshold: float) -> DataFrame:
    """(cluster, merged) from (cluster, n, total array): the closest pair of normalised centroids is fused while it is at or
    above the threshold. Done once over all clusters in one task: no bound on their likeness tells which can't meet after
    fusions. A cluster without total stays alone."""
    ship(clusters.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cluster").reset_index(drop=True)
        ids = frame["cluster"].to_numpy()
        return pd.DataFrame({"cluster": ids, "merged": ids[fused(np.array(frame["total"].tolist(), dtype=float), threshold)]})

    have = clusters.where("total IS NOT NULL").select(F.col("cluster").cast("bigint").alias("cluster"), "total")
    alone = clusters.where("total IS NULL").select(F.col("cluster").cast("bigint").alias("cluster"), F.col("cluster").cast("bigint").alias("merged"))
    return have.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "cluster bigint, merged bigint").unionByName(alone)


def best_partition(members: list, sims: dict, conflicts: set) -> list[list]:
    """The partition into conflict-free groups with the greatest sum of similarities within groups.

    By dynamic programming over subsets: the group of the least member left is chosen among all conflict-free subsets, and
    the best partition of the others is looked up. Of equal sums, each member in order goes into the earliest group it can.
    """
    names = sorted(members)
    n = len(names)
    place = {m: k for k, m in enumerate(names)}
    apart = [0] * n
    for a, b in conflicts:
        if a in place and b in place:
            apart[place[a]] |= 1 << place[b]
            apart[place[b]] |= 1 << place[a]
    gain = np.zeros((n, n))
    for (a, b), s in sims.items():
        if a in place and b in place:
            gain[place[a], place[b]] = gain[place[b], place[a]] = s
    worth, fine = [0.0] * (1 << n), [True] * (1 << n)
    for mask in range(1, 1 << n):
        top = mask.bit_length() - 1
        rest = mask ^ (1 << top)
        fine[mask] = fine[rest] and not apart[top] & rest
        worth[mask] = worth[rest] + sum(gain[top, k] for k in range(top) if rest >> k & 1)
    early = [int(f"{mask:0{n}b}"[::-1], 2) if n else 0 for mask in range(1 << n)]  # compares subsets by their earliest members
    best: list[tuple[float, int]] = [(0.0, 0)] * (1 << n)
    for mask in range(1, 1 << n):
        low = mask & -mask
        others = mask ^ low
        part, found = others, None
        while True:
            group = part | low
            if fine[group]:
                total = round(worth[group] + best[mask ^ group][0], 12)
                if found is None or (total, early[group]) > (found[0], early[found[1]]):
                    found = (total, group)
            if not part:
                break
            part = (part - 1) & others
        best[mask] = found
    out, left = [], (1 << n) - 1
    while left:
        group = best[left][1]
        out.append([names[k] for k in range(n) if group >> k & 1])
        left ^= group
    return out


def greedy_partition(members: list, sims: dict, conflicts: set) -> list[list]:
    """Pairs by falling similarity; a pair is admitted where no member of the one group conflicts with one of the other."""
    group = {m: {m} for m in members}
    for a, b in sorted(sims, key=lambda p: (-sims[p], p)):
        x, y = group[a], group[b]
        if x is not y and all((min(p, q), max(p, q)) not in conflicts for p in x for q in y):
            x |= y
            for m in y:
                group[m] = x
    return sorted({tuple(sorted(g)) for g in group.values()})


def merge_groups(confirmed: DataFrame, conflicts: DataFrame, limit: int = C.DEFAULT.exact_partition, label: str = "groups") -> DataFrame:
    """(id, group_id) from confirmed pairs (a, b, sim) and conflicting pairs (a, b): conflict-free groups of two or more.

    A component without a conflict is one group and never leaves the cluster's aggregates; only components with conflicts
    are partitioned one by one, exactly up to limit members and greedily beyond.
    """
    ship(confirmed.sparkSession)
    pairs = stash(confirmed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim")), label + "-p")
    comp = stash(components(pairs, label=label), label + "-c")
    ca, cb = comp.select(F.col("id").alias("a"), F.col("component").alias("x")), comp.select(F.col("id").alias("b"), F.col("component").alias("y"))
    against = conflicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(ca, "a").join(cb, "b").where("x = y").select("a", "b", F.col("x").alias("component"))
    torn = against.select("component").distinct()
    calm = comp.join(torn, "component", "left_anti").select("id", F.col("component").alias("group_id"))
    rows = pairs.join(ca, "a").select("a", "b", "sim", F.col("x").alias("component")).join(torn, "component", "left_semi").unionByName(against.select("a", "b", F.lit(None).cast("double").alias("sim"), "component"))
    kind = confirmed.schema["a"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        links = frame[frame["sim"].notna()]
        sims = {(a, b): s for a, b, s in zip(links["a"], links["b"], links["sim"])}
        bad = {(a, b) for a, b in zip(frame.loc[frame["sim"].isna(), "a"], frame.loc[frame["sim"].isna(), "b"])}
        members = sorted({x for p in sims for x in p})
        sims = {p: s for p, s in sims.items() if p not in bad}
        found = best_partition(members, sims, bad) if len(members) <= limit else greedy_partition(members, sims, bad)
        out = [(m, min(g)) for g in found if len(g) > 1 for m in g]
        return pd.DataFrame(out, columns=["id", "group_id"])

    return calm.unionByName(rows.groupBy("component").applyInPandas(run, f"id {kind}, group_id {kind}"))


def medoids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster, medoid, sim): of each cluster (id, cluster) the member with the greatest dot product with the mean vector."""
    rows = members.join(vectors.select("id", "v"), "id").where("v IS NOT NULL")
    mean = rows.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("cluster").agg(F.expr("transform(array_sort(collect_list(struct(pos, x))), p -> p.x)").alias("c"))  # one vector per cluster
    sims = rows.join(mean, "cluster").select("cluster", "id", F.round(F.aggregate(F.zip_with("v", "c", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x), 9).alias("sim"))
    best = sims.groupBy("cluster").agg(F.min(F.struct(-F.col("sim"), F.col("id"))).alias("m"))
    return best.select("cluster", F.col("m.id").alias("medoid"), F.round(-F.col("m.col1"), 6).alias("sim"))
