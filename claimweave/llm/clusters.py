"""Problem 3: grouping records into similarity clusters.

Cluster-feature trees (Zhang et al. 1996) per partition, whose leaf summaries (count, linear sum, founding record) are
mergeable; leaves that meet in a tree node are joined by Ward's criterion on their features, the features of a cluster's
leaves are summed up by partial aggregates, one full pass assigns every record, and the members nearest the centroid
describe each cluster. A record is its set of words; the inner nodes of a tree are the rarest words, so trees built apart
agree. Filing under few words is a short cut: clusters and records it leaves apart are then joined exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.bucketjoin import HOT_BUCKET, bucket_pairs, odd_sketch, sketch_columns, verified
from claimweave.llm.components import seed_tree_components
from claimweave.llm.hashing import flat_of, list_array
from claimweave.llm.wordsets import bucket_of, classes_of, document_frequency, word_rows
from claimweave.runtime import bounded, keyed_join, ship, stash

LIKENESS = 0.3
#: A record or leaf is filed under those of its ROUTES rarest words that another record may share, and under LEAST in any case.
ROUTES, LEAST = 3, 2
#: A large cluster makes its own words frequent, so that its records are not filed under them. A record that meets nothing is
#: therefore also compared with the RECENT latest and the HEAVY largest leaves of its tree.
RECENT, HEAVY = 256, 256
#: Leaves a tree holds before it is written out and begun anew; leaves of all trees are merged alike.
TREE_LEAVES = 40_000
#: Words a leaf counts: beyond, the least frequent half is forgotten. A centroid has the words of more than half of the
#: records, of which there are far fewer than this half.
LEAF_WORDS = 2048
#: Words of 64 parity bits in the sketches of the exact join.
SKETCH = 6
TYPICAL = 5


def rare_first(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, filing: tuple[int, int] = (ROUTES, LEAST)) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words, within each set from the rarest to the most frequent, and which of them it is filed under."""
    n = counts[bucket_of(words)].astype(np.int64)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((words, n, row))
    alone = n[order] < 2
    place = np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))
    before = np.concatenate([[0], np.cumsum(~alone)])
    shared_place = before[:-1] - np.repeat(before[starts[:-1]], np.diff(starts)) if len(words) else place
    return order, ~alone & ((place < filing[0]) | (shared_place < filing[1]))


class Leaf:
    """A cluster feature: N, the linear sum per word, and the words most of its records have (its rounded centroid)."""

    __slots__ = ("id", "n", "sums", "core", "odd", "size", "seed", "due", "slots")

    def __init__(self, cid: int, words: list[int], odd: int):
        self.id, self.n, self.core, self.seed, self.due = cid, 1, frozenset(words), words, 2
        self.odd, self.size, self.slots = odd, len(words), []
        self.sums = dict.fromkeys(words, 1)

    def add(self, words: list[int]) -> bool:
        """Sum one more record up; whether the centroid was taken anew."""
        self.n += 1
        sums = self.sums
        for w in words:
            sums[w] = sums.get(w, 0) + 1
        if len(sums) > LEAF_WORDS:
            keep = sorted(sums.items(), key=lambda x: -x[1])[: LEAF_WORDS // 2]
            self.sums = sums = dict(keep)
        if self.n >= self.due:
            core = frozenset(w for w, c in sums.items() if 2 * c > self.n)
            if core:
                self.core, self.odd, self.size = core, odd_bits(core), len(core)
            self.due = self.n + 1 + self.n // 3
            return True
        return False


def odd_bits(words) -> int:
    """256 parity bits of a set: two sets differ in at least as many words as their bits do."""
    out = 0
    for w in words:
        out ^= 1 << (w & 255)
    return out


def odd_row(odd: int) -> np.ndarray:
    return np.frombuffer(odd.to_bytes(32, "little"), dtype="<u8")


class Shelf:
    """The latest and the largest leaves of a tree, compared with a record all at once by their parity bits."""

    def __init__(self, recent: int = RECENT, heavy: int = HEAVY):
        self.recent, k = recent, recent + heavy
        self.bits, self.size, self.n = np.zeros((k, 4), "<u8"), np.full(k, -(10**9), np.int64), np.zeros(k, np.int64)
        self.leaves: list[Leaf | None] = [None] * k
        self.turn = 0

    def put(self, slot: int, leaf: Leaf) -> None:
        old = self.leaves[slot]
        if old is not None:
            old.slots.remove(slot)
        self.leaves[slot] = leaf
        leaf.slots.append(slot)
        self.changed(leaf)

    def latest(self, leaf: Leaf) -> None:
        self.put(self.turn % self.recent, leaf)
        self.turn += 1

    def changed(self, leaf: Leaf) -> None:
        for slot in leaf.slots:
            self.bits[slot], self.size[slot], self.n[slot] = odd_row(leaf.odd), leaf.size, leaf.n

    def grown(self, leaf: Leaf) -> None:
        """Called where a leaf reaches a power of two; the smallest leaf on the shelf of large ones makes room."""
        if any(s >= self.recent for s in leaf.slots):
            self.changed(leaf)
            return
        slot = self.recent + int(np.argmin(self.n[self.recent :]))
        if self.n[slot] < leaf.n:
            self.put(slot, leaf)

    def near(self, odd: int, size: int, apart: float) -> list[Leaf]:
        far = np.bitwise_count(self.bits ^ odd_row(odd)).sum(axis=1)
        return [self.leaves[k] for k in np.flatnonzero(far <= apart * (self.size + size)).tolist()]


LEAF_COLUMNS = ["leaf", "cid", "n", "core", "words", "sums", "seed", "routes"]


def likeness(a: frozenset | set, b: frozenset | set) -> float:
    shared = len(a & b)
    either = len(a) + len(b) - shared
    return shared / either if either else 0.0


def leaf_rows(classes: DataFrame, counts_bc, threshold: float, filing: tuple[int, int] = (ROUTES, LEAST), shelves: tuple[int, int] = (RECENT, HEAVY)) -> DataFrame:
    """(leaf, cid, n, core, words, sums, seed, routes): a row per record with its leaf and (as core) its words, and a row per
    leaf (cid null) with its feature: count, linear sum by word, rounded centroid (core) and founding record (seed)."""

    def run(batches):
        counts = counts_bc.value
        apart = (1 - threshold) / (1 + threshold) + 1e-9  # of all their words, sets at the threshold differ in so many at most
        leaves: list[Leaf] = []
        filed: dict[int, list[Leaf]] = {}
        shelf = Shelf(*shelves)

        def summaries():
            for lo in range(0, len(leaves), 4000):
                some = leaves[lo : lo + 4000]
                core = [sorted(x.core) for x in some]
                sizes = np.array([len(c) for c in core], np.int64)
                flat = np.array([w for c in core for w in c], np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                order, filed_under = rare_first(flat, starts, counts, filing)
                ranked = flat[order]
                routes = [ranked[a:b][filed_under[a:b]].tolist() for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.id for x in some], pa.int64()),
                        pa.nulls(len(some), pa.int64()),
                        pa.array([x.n for x in some], pa.int64()),
                        list_array(flat, sizes),
                        pa.array([list(x.sums) if x.n > 1 else [] for x in some], pa.list_(pa.int64())),
                        pa.array([list(x.sums.values()) if x.n > 1 else [] for x in some], pa.list_(pa.int64())),
                        pa.array([x.seed if x.n > 1 else [] for x in some], pa.list_(pa.int64())),
                        pa.array(routes, pa.list_(pa.int64())),
                    ],
                    LEAF_COLUMNS,
                )

        for batch in batches:
            cids = batch.column(0).to_pylist()
            flat, starts = flat_of(batch.column(1))
            order, take = rare_first(flat, starts, counts, filing)
            ranked = flat[order].tolist()
            routes = flat[order][take].tolist()
            ends = np.concatenate([[0], np.cumsum(take)])[starts].tolist()
            bounds = starts.tolist()
            where = []
            for i, cid in enumerate(cids):
                words = ranked[bounds[i] : bounds[i + 1]]
                have, odd, size = set(words), odd_bits(words), len(words)
                best, near = None, threshold
                tried = set()
                under = routes[ends[i] : ends[i + 1]]
                for r in under:
                    for leaf in filed.get(r, ()):
                        if leaf.id in tried:
                            continue
                        tried.add(leaf.id)
                        if (odd ^ leaf.odd).bit_count() > apart * (size + leaf.size):
                            continue
                        s = likeness(have, leaf.core)
                        if s >= near and (best is None or s > near):
                            best, near = leaf, s
                if best is None:
                    for leaf in shelf.near(odd, size, apart):
                        s = likeness(have, leaf.core)
                        if s >= near and (best is None or s > near):
                            best, near = leaf, s
                if best is None:
                    best = Leaf(cid, words, odd)
                    leaves.append(best)
                    shelf.latest(best)
                    for r in under:
                        filed.setdefault(r, []).append(best)
                else:
                    if best.add(words):
                        shelf.changed(best)
                    if best.n & (best.n - 1) == 0:
                        shelf.grown(best)
                where.append(best.id)
            k = len(cids)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(k + 1, np.int32)), pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(cids, pa.int64()), pa.nulls(k, pa.int64()), batch.column(1), none, none, none, none], LEAF_COLUMNS)
            if len(leaves) > TREE_LEAVES:
                yield from summaries()
                leaves, filed, shelf = [], {}, Shelf(*shelves)
        yield from summaries()

    return classes.select("cid", "words").mapInArrow(run, "leaf bigint, cid bigint, n bigint, core array<bigint>, words array<bigint>, sums array<bigint>, seed array<bigint>, routes array<bigint>")


def ward_cost(n: int, size: int, m: int, square: float, dot: float) -> float:
    """The rise of the squared error when n records with the centroid of size words are merged into m records whose linear
    sum has this square and this dot product with the centroid."""
    return n * m / (n + m) * (size + square / (m * m) - 2 * dot / m)


def ward_links(leaves: DataFrame, threshold: float) -> DataFrame:
    """(a, b): leaves joined under an inner node. Each leaf, the largest first, meets the leaders filed there before it and is
    merged into the one whose merger raises the squared error least (Ward), of those whose centroid reaches the threshold;
    a leader's feature takes up the leaf's. Rows stream in sorted order; only leaders are held. Words come as 32-bit values
    here, and leaves by their rounded centroids: the assignment pass decides exactly."""

    def run(batches):
        route, leaders, filed = None, [], {}
        for batch in batches:
            routes, ids, ns = (batch.column(i).to_numpy() for i in range(3))
            if not len(routes):
                continue
            flat, starts = flat_of(batch.column(3))
            # nodes with one leaf need no work; the node at either edge of the batch may go on in another
            same = np.concatenate([[routes[0] == route], routes[1:] == routes[:-1]])
            live = same | np.concatenate([same[1:], [True]])
            out_a, out_b = [], []
            for i in np.flatnonzero(live):
                if routes[i] != route:
                    route, leaders, filed = int(routes[i]), [], {}
                words = flat[starts[i] : starts[i + 1]].tolist()
                n, size = int(ns[i]), len(words)
                meets: dict[int, int] = {}
                for w in words:
                    for k in filed.get(w, ()):
                        meets[k] = meets.get(k, 0) + 1
                best, cost = None, float("inf")
                for k, shared in meets.items():
                    _, m, core, sums, square = leaders[k]
                    if shared >= threshold * (size + core - shared):
                        rise = ward_cost(n, size, m, square, sum(sums.get(w, 0) for w in words))
                        if rise < cost:
                            best, cost = k, rise
                if best is None:
                    for w in words:
                        filed.setdefault(w, []).append(len(leaders))
                    leaders.append([int(ids[i]), n, size, dict.fromkeys(words, n), float(n * n * size)])
                else:
                    one = leaders[best]
                    out_a.append(one[0])
                    out_b.append(int(ids[i]))
                    one[1] += n
                    for w in words:
                        was = one[3].get(w, 0)
                        one[3][w] = was + n
                        one[4] += n * (2 * was + n)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    # the low half of a 64-bit word hash
    narrow = F.expr("transform(core, w -> cast((w & 4294967295L) - 2147483648L as int))")
    filed = leaves.select(F.explode("routes").alias("route"), "leaf", "n", narrow.alias("core"))
    filed = filed.repartition("route").sortWithinPartitions("route", F.desc("n"), "leaf")
    return filed.select("route", "leaf", "n", "core").mapInArrow(run, "a bigint, b bigint")


def merged_features(leaves: DataFrame, placed: DataFrame, label: str) -> DataFrame:
    """(cluster, size, core, rep) of clusters of two or more records from leaves and (leaf, n, cluster).

    Linear sums are added up per cluster and word by partial aggregates before and after the shuffle, so that a cluster with
    very many leaves is summed up by many tasks. core has the words of more than half of the records (the rounded
    centroid), rep the founding record of the largest leaf.
    """
    best = F.max_by("leaf", F.struct(F.col("n"), -F.col("leaf")))
    top = stash(placed.groupBy("cluster").agg(F.sum("n").alias("size"), best.alias("best"), F.count("*").alias("leaves")).where("size > 1"), label + "-t")
    # a cluster of one leaf has that leaf's feature
    own = leaves.join(bounded(placed.select("leaf", "cluster").join(bounded(top.where("leaves > 1").select("cluster")), "cluster", "left_semi")), "leaf")
    word = F.when(F.size("words") > 0, F.arrays_zip(F.col("words").alias("w"), F.col("sums").alias("s"))).otherwise(F.transform("core", lambda w: F.struct(w.alias("w"), F.lit(1).cast("bigint").alias("s"))))
    sums = own.select("cluster", F.explode(word).alias("x")).groupBy("cluster", F.col("x.w").alias("w")).agg(F.sum("x.s").alias("s"))
    core = sums.join(bounded(top.select("cluster", "size")), "cluster").where("2 * s > size").groupBy("cluster").agg(F.collect_list("w").alias("core"))  # fewer than two records' words
    founder = leaves.select(F.col("leaf").alias("best"), F.when(F.size("seed") > 0, F.col("seed")).otherwise(F.col("core")).alias("rep"), F.col("core").alias("own"))
    return stash(founder.join(bounded(top), "best").join(core, "cluster", "left").select("cluster", "size", F.coalesce("core", "own").alias("core"), "rep"), label + "-p")


def nearness(joined: DataFrame, threshold: float) -> DataFrame:
    """(cid, cluster, near, ok) from (cid, cluster, words, core, rep): near is the likeness to the centroid, ok whether the
    likeness to the cluster's representative record reaches the threshold."""

    def run(batches):
        for batch in batches:
            w, c, r = (flat_of(batch.column(i)) for i in (2, 3, 4))
            near, ok = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            wl, cl, rl = w[0].tolist(), c[0].tolist(), r[0].tolist()
            ws, cs, rs = w[1].tolist(), c[1].tolist(), r[1].tolist()
            last = None
            for i, cluster in enumerate(batch.column(1).to_pylist()):
                if cluster != last:  # rows of one cluster mostly follow each other
                    last, core, rep = cluster, set(cl[cs[i] : cs[i + 1]]), set(rl[rs[i] : rs[i + 1]])
                have = set(wl[ws[i] : ws[i + 1]])
                near[i] = likeness(have, core)
                ok[i] = likeness(have, rep) >= threshold - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(ok)], ["cid", "cluster", "near", "ok"])

    return joined.select("cid", "cluster", "words", "core", "rep").mapInArrow(run, "cid bigint, cluster bigint, near double, ok boolean")


def prefix_rows(sets: DataFrame, counts_bc, threshold: float) -> DataFrame:
    """(key, id, n, o0, …): each set (id, words) under the words it must share one of with any set at the threshold: all but
    ceil(threshold x n) - 1 of its n words, the rarest ones. Words no other set has are left out."""

    def run(batches):
        counts = counts_bc.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat, starts = flat_of(batch.column(1))
            if not len(flat):
                continue
            sizes = np.diff(starts)
            row = np.repeat(np.arange(len(ids)), sizes)
            seen = counts[bucket_of(flat)]
            order = np.lexsort((flat, seen, row))
            place = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
            prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            take = (place < np.repeat(prefix, sizes)) & (seen[order] > 1)
            odd = odd_sketch(flat, starts, SKETCH)[row[take]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[order][take]), pa.array(ids[row[take]]), pa.array(sizes[row[take]].astype(np.int64)), *[pa.array(odd[:, i].copy()) for i in range(SKETCH)]], ["key", "id", "n", *sketch_columns(SKETCH)])

    return sets.mapInArrow(run, "key bigint, id bigint, n bigint, " + ", ".join(f"{c} bigint" for c in sketch_columns(SKETCH)))


def exact_links(sets: DataFrame, threshold: float, hot: int = HOT_BUCKET, label: str = "exact") -> DataFrame:
    """(a, b, likeness): all pairs of non-empty sets (id, words) at or above the threshold, by prefix filtering and parity
    sketches, none of which loses a pair."""
    counts, _ = document_frequency(sets)
    counts_bc = sets.sparkSession.sparkContext.broadcast(counts)
    return stash(verified(bucket_pairs(prefix_rows(sets, counts_bc, threshold), threshold, SKETCH, hot, label + "-b"), sets, threshold), label + "-x")


def class_clusters(classes: DataFrame, threshold: float = LIKENESS, label: str = "clusters", **short_cuts) -> DataFrame:
    """(cid, cluster, near): the cluster of every class that shares one with another class, as a written table.

    After the assignment pass the representatives of clusters, and the records that belong to no cluster yet or are not
    like their cluster's representative, are joined with each other exactly. In that join a cluster is one record, so
    that its words are no longer frequent; what is alike there becomes one cluster. So no link to a representative is lost,
    however few words records were filed under (filing) or however short the lists of leaves are (shelves).
    """
    spark = classes.sparkSession
    counts, _ = document_frequency(classes)
    counts_bc = spark.sparkContext.broadcast(counts.astype(np.int32))
    rows = stash(leaf_rows(classes, counts_bc, threshold, **short_cuts), label + "-l")
    leaves = rows.where("cid IS NULL").drop("cid")
    records = rows.where("cid IS NOT NULL").select("cid", "leaf", F.col("core").alias("words"))
    merged = seed_tree_components(ward_links(leaves, threshold), "a", "b", label)
    merged = stash(merged.select(F.col("id").alias("leaf"), F.col("group_id").alias("cluster")), label + "-w")
    placed = stash(leaves.select("leaf", "n").join(merged, "leaf", "left").select("leaf", "n", F.coalesce("cluster", "leaf").alias("cluster")), label + "-c")
    profile = merged_features(leaves, placed, label)
    # the assignment pass: every record is compared with the cluster of its leaf; a leaf has no more records than one task reads
    home = bounded(placed.join(bounded(profile.select("cluster")), "cluster", "left_semi").select("leaf", "cluster"))
    looked = stash(nearness(keyed_join(records.join(home, "leaf").select("cid", "words", "cluster"), profile, "cluster", n="size"), threshold), label + "-n")
    sure = looked.where("ok").select("cid", "cluster", "near")
    failed = records.join(bounded(looked.where("NOT ok").select("cid")), "cid", "left_semi")
    alone = records.join(home, "leaf", "left_anti").unionByName(failed)
    # clusters go by -cluster - 1 among the records left over
    apart = stash(alone.select(F.col("cid").alias("id"), "words").unionByName(profile.select((-F.col("cluster") - 1).alias("id"), F.col("rep").alias("words"))), label + "-r")
    links = exact_links(apart, threshold, label=label)
    joined = stash(seed_tree_components(links, "a", "b", label + "-j"), label + "-g")
    renamed = joined.where("id < 0").select((-F.col("id") - 1).alias("cluster"), "group_id")
    found = sure.join(bounded(renamed), "cluster", "left").select("cid", F.coalesce("group_id", -F.col("cluster") - 1).alias("cluster"), "near")
    best = links.select(F.explode(F.array(F.struct(F.col("a").alias("cid"), "likeness"), F.struct(F.col("b").alias("cid"), "likeness"))).alias("x")).groupBy("x.cid").agg(F.max("x.likeness").alias("near"))
    late = joined.where("id >= 0").select(F.col("id").alias("cid"), F.col("group_id").alias("cluster")).join(best, "cid")
    return found.unionByName(late)


def similarity_clusters(df: DataFrame, id_col: str, text_col: str, threshold: float = LIKENESS, label: str = "clusters", **short_cuts) -> DataFrame:
    """(id, cluster_id, size, near): one row per id with at least one word; cluster_id is the smallest id of the cluster.

    Null ids, and null, empty or word-less texts, belong to no cluster and have no row. An id like no other is a cluster of
    one. Rows that repeat an id and its text count once; other columns are ignored. near is the likeness to the centroid, or,
    of a record the last join brought in, to the nearest record or representative there.
    """
    ship(df.sparkSession)
    members, classes = classes_of(word_rows(df, id_col, text_col), label)
    members = stash(members.withColumnRenamed("id", "rid"), label + "-i")
    found = stash(class_clusters(classes, threshold, label, **short_cuts), label + "-f")
    copies = stash(members.groupBy("cid").agg(F.count("*").alias("n")).join(found, "cid", "left").select("cid", "n", F.coalesce("cluster", "cid").alias("cluster"), F.coalesce("near", F.lit(1.0)).alias("near")), label + "-q")
    placed = stash(keyed_join(members, copies, "cid").select(F.col("rid").alias("id"), "cluster", "near"), label + "-o")
    size = stash(placed.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size"), F.count("*").alias("n")), label + "-s")
    return keyed_join(placed, size, "cluster").select("id", "cluster_id", "size", "near")


def described(clusters: DataFrame, labels: DataFrame | None = None, least: int = 3, typical: int = TYPICAL) -> DataFrame:
    """(cluster_id, size, rank, id, near): the typical members nearest the centroid of each cluster of at least `least` ids;
    with labels (id, label) also label and label_share: the most frequent one of the cluster's members and its share.

    Ranking drops all but the first few rows of a cluster before anything is shuffled. Null labels are not counted.
    """
    w = Window.partitionBy("cluster_id").orderBy(F.desc("near"), "id")
    large = clusters.where(F.col("size") >= least)
    out = large.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical).select("cluster_id", "size", "rank", "id", F.round("near", 6).alias("near"))
    if labels is None:
        return out
    counted = large.select("id", "cluster_id").join(labels.where("label IS NOT NULL").distinct(), "id").groupBy("cluster_id", "label").agg(F.count("*").alias("k"))
    top = counted.groupBy("cluster_id").agg(F.min_by(F.struct("label", "k"), F.struct(-F.col("k"), F.col("label"))).alias("t")).select("cluster_id", "t.label", "t.k")
    return out.join(top, "cluster_id", "left").select(*out.columns, "label", F.round(F.col("k") / F.col("size"), 6).alias("label_share"))
