"""C and G: clustering, deduplication and graph algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.operators import chunks as H
from claimweave.operators import clustering as U
from claimweave.operators import compile as K
from claimweave.operators import graph as G
from claimweave.operators import reconcile as Q
from claimweave.operators import similarity as M
from claimweave.operators.components import components
from claimweave.plans import aggregates, filters, joins, relations
from claimweave.plans.registry import Tables, query
from claimweave.runtime import stash

def vectors(t: Tables, kind: str | None = None) -> DataFrame:
    """(key, id, ord, v) of the nodes of a type with hashed word vectors of their contents; id numbers them in their order."""
    n = t.nd("type", "ord", "content")
    n = n if kind is None else n.where(F.col("type") == kind)
    n = stash(K.positions(n.select(F.col("id").alias("key"), "ord", "content"), [F.col("ord"), F.col("key")], "order", "id"), "vectors")
    return n.join(M.hashed_vectors(n, "id", "content"), "id").select("key", "id", F.col("id").alias("ord"), "v")


def named(t: Tables, rows: DataFrame, v: DataFrame, column: str) -> DataFrame:
    """(id, column): numbers of vectors turned back into node ids."""
    back = v.select("id", "key")
    out = rows.join(back, "id").select(F.col("key").alias("node"), F.col(column).alias("id"))
    return out.join(back, "id").select(F.col("node").alias("id"), F.col("key").alias(column))


@query("C01_exact_dedup", "SELECT id, first_value(id) OVER (PARTITION BY trim(content) ORDER BY ord, id) AS leader FROM {nd} WHERE content IS NOT NULL")
def c01(t: Tables):
    """The fallback without vectors: exact equality of trimmed content; the earliest record leads."""
    n = t.nd("content", "ord").where("content IS NOT NULL").select("id", "ord", F.xxhash64(F.trim("content")).alias("h"), F.trim("content").alias("c"))
    lead = n.groupBy("h", "c").agg(F.min(F.struct("ord", "id")).alias("l")).select("h", "c", F.col("l.id").alias("leader"))
    return n.join(lead, ["h", "c"]).select("id", "leader")


@query("C01_leader_dedup")
def c01_vectors(t: Tables):
    """A record is taken up by the most similar one kept before it, of any type, at the dedup threshold."""
    v = stash(vectors(t), "c01-v")
    return named(t, U.seed_clusters(v, C.DEFAULT.dedup, first_match=False, label="c01"), v, "seed")


@query("C02_chunk_dedup")
def c02(t: Tables):
    """Blocks of bodies; one that is like an earlier one is a duplicate of it and is not compared with later ones."""
    b = stash(K.positions(H.blocks(t.bd, C.DEFAULT.chunk_chars), [F.col("capture_id"), F.col("idx")], "c02", "id"), "c02-b")
    v = M.hashed_vectors(b, "id", "text").withColumn("ord", F.col("id"))
    seeds = U.seed_clusters(v, C.DEFAULT.chunk_duplicate, label="c02")
    first = b.select(F.col("id").alias("seed"), F.col("capture_id").alias("first_capture"), F.col("idx").alias("first_idx"))
    return b.join(seeds, "id").join(first, "seed").select("capture_id", "idx", "first_capture", "first_idx", (F.col("id") != F.col("seed")).alias("duplicate"))


@query("C03_seed_clusters")
def c03(t: Tables):
    v = stash(vectors(t, "evidence"), "c03-v")
    return named(t, U.seed_clusters(v, C.DEFAULT.cluster, label="c03"), v, "seed")


@query("C04_themes")
def c04(t: Tables):
    """Themes: seed clusters of presuppositions by size with medoid, label, up to fifteen claims that presuppose a member, and
    impact by whether any member is to be reviewed."""
    v = stash(vectors(t, "presupposition"), "c04-v")
    m = stash(U.seed_clusters(v, C.DEFAULT.cluster, label="c04").select("id", F.col("seed").alias("cluster")), "c04-m")
    reviewed = relations.reviewed_nodes(t, "content").select(F.col("id").alias("key"), "needs_review", "content")
    info = m.join(v.select("id", "key"), "id").join(reviewed, "key")
    size = info.groupBy("cluster").agg(F.count("*").alias("n"), F.bool_or("needs_review").alias("needs"))
    top = size.orderBy(F.desc("n"), "cluster").limit(C.DEFAULT.max_themes)
    k = F.row_number().over(Window.orderBy(F.desc("n"), "cluster"))  # at most max_themes rows
    head = top.withColumn("theme_id", F.format_string("theme_%02d", k - 1)).join(U.medoids(m, v), "cluster")
    middle = info.select(F.col("id").alias("medoid"), F.col("key").alias("medoid_id"), F.substring("content", 1, 200).alias("label"))
    edges = t.ge.where("type = 'presupposes'").select(F.col("src").alias("claim_id"), F.col("dst").alias("key"))
    claims = info.join(edges, "key").join(t.nd("type", "ord").where("type = 'claim'").select(F.col("id").alias("claim_id"), "ord"), "claim_id").select("cluster", "claim_id", "ord").distinct()
    first = claims.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("ord", "claim_id"))).where("k <= 15").groupBy("cluster").agg(K.listed(F.col("claim_id")).alias("claim_ids"))
    return head.join(middle, "medoid").join(first, "cluster", "left").select("theme_id", "medoid_id", "label", F.col("n").alias("member_count"), F.coalesce("claim_ids", F.lit("")).alias("claim_ids"), F.when(F.col("needs"), "FATAL").otherwise("MAJOR").alias("impact"))


@query("C05_claim_clusters")
def c05(t: Tables):
    v = stash(vectors(t, "claim"), "c05-v")
    m = stash(U.seed_clusters(v, C.DEFAULT.cluster, label="c05").select("id", F.col("seed").alias("cluster")), "c05-m")
    n = m.groupBy("cluster").agg(F.count("*").alias("member_count"))
    named_ = v.select(F.col("id").alias("medoid"), F.col("key").alias("representative"))
    return U.medoids(m.join(v.where("v IS NOT NULL").select("id"), "id", "left_semi"), v).join(n, "cluster").join(named_, "medoid").select("cluster", "representative", "member_count")


@query("C06_centroid_clusters")
def c06(t: Tables):
    """Shared questions, the longest first, by centroids."""
    q = stash(aggregates.question_vectors(t), "c06-q")
    c = U.centroid_clusters(q.where("v IS NOT NULL").select("id", "ord", "v"), C.DEFAULT.proposition, label="c06")
    names = q.select("id", "q")
    return c.join(names, "id").select(F.col("cluster").alias("id"), F.col("q").alias("question")).join(names, "id").select("question", F.col("q").alias("cluster"))


@query("C07_merged_centroids")
def c07(t: Tables):
    """Shared questions after the closest centroids were merged."""
    return aggregates.clustered_questions(t, "c07")[0].select(F.col("q").alias("question"), "cluster")


_LINK = "WITH RECURSIVE p AS " + joins._SAME + ", l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(a, g) AS (SELECT a, a FROM l UNION SELECT l.b, r.g FROM r JOIN l ON l.a = r.a AND r.g < l.b), cc AS (SELECT a AS id, min(g) AS component FROM r GROUP BY 1) "


@query("G01_components", _LINK + "SELECT id, component FROM cc")
def g01(t: Tables):
    return components(joins.same_pairs(t))


def confirmed(t: Tables) -> DataFrame:
    ids = t.nodes.select("id").distinct()
    e = t.rl.where("type = 'same_as'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.coalesce("strength", F.lit(0.75))).alias("sim"))


def merge_groups(t: Tables, label: str) -> DataFrame:
    return U.merge_groups(confirmed(t), G.conflict_pairs(t.ge), label=label)


@query("G02_clique_partition")
def g02(t: Tables):
    return merge_groups(t, "g02")


@query("G03_greedy_partition")
def g03(t: Tables):
    return U.merge_groups(confirmed(t), G.conflict_pairs(t.ge), limit=0, label="g03")


@query("G04_group_resolution")
def g04_groups(t: Tables):
    """Components, each resolved whole without conflicts, exactly up to twelve members, and greedily beyond."""
    return merge_groups(t, "g04r")


@query("G04_calm_groups", _LINK + f", torn AS (SELECT DISTINCT x.component FROM {joins._CONF} k JOIN cc x ON x.id = k.a JOIN cc y ON y.id = k.b WHERE x.component = y.component) SELECT component AS group_id, count(*) AS n FROM cc WHERE component NOT IN (SELECT component FROM torn) GROUP BY 1")
def g04(t: Tables):
    """Groups without any conflict: exactly the components none of whose pairs conflict."""
    cc = stash(components(joins.same_pairs(t), label="g04"), "g04")
    k = G.conflict_pairs(t.ge).join(cc.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(cc.select(F.col("id").alias("b"), F.col("component").alias("y")), "b").where("x = y")
    return cc.join(k.select(F.col("x").alias("component")).distinct(), "component", "left_anti").groupBy(F.col("component").alias("group_id")).agg(F.count("*").alias("n"))


_CAN = _LINK + ", cm AS (SELECT id, first_value(id) OVER (PARTITION BY component ORDER BY w DESC, id) AS canonical FROM (SELECT cc.id, cc.component, coalesce(n.evidential_weight, 0) AS w FROM cc JOIN {nd} n ON n.id = cc.id)) "


def canonical(t: Tables, label: str) -> DataFrame:
    return G.canonical_members(components(joins.same_pairs(t), label=label).select("id", F.col("component").alias("group_id")), t.nodes)


@query("G05_merged_relations", _CAN + "SELECT src, dst, type, max(strength) AS strength FROM (SELECT coalesce(a.canonical, e.src) AS src, coalesce(b.canonical, e.dst) AS dst, e.type, e.strength FROM {ge} e LEFT JOIN cm a ON a.id = e.src LEFT JOIN cm b ON b.id = e.dst) WHERE src <> dst GROUP BY 1, 2, 3")
def g05(t: Tables):
    return G.redirected(t.ge.select("src", "dst", "type", "strength"), stash(canonical(t, "g05"), "g05"))


@query("G05_canonical_nodes", _CAN + "SELECT id, canonical FROM cm")
def g05_nodes(t: Tables):
    return canonical(t, "g05n")


_SHARED = "(SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {ge} WHERE type = 'contradicts')"
_ROUTED = (
    joins._sets(_SHARED)
    + f", qw AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(coalesce(strength, 0)) AS sim, max(nullif(trim(shared_question), '')) AS q FROM {{ge}} WHERE type = 'contradicts' GROUP BY 1, 2), tk AS (SELECT id, {joins._w4('content')} AS ws FROM {{nd}} WHERE content IS NOT NULL), "
    f"qs AS (SELECT qw.a, qw.b, qw.sim, least(len(list_intersect({joins._w4('q')}, x.ws))::DOUBLE / nullif(sqrt(len({joins._w4('q')}) * len(x.ws)), 0), len(list_intersect({joins._w4('q')}, y.ws))::DOUBLE / nullif(sqrt(len({joins._w4('q')}) * len(y.ws)), 0)) AS qsim, q IS NOT NULL AND x.ws IS NOT NULL AND y.ws IS NOT NULL AS known FROM qw LEFT JOIN tk x ON x.id = qw.a LEFT JOIN tk y ON y.id = qw.b), "
    "ro AS (SELECT f.a, f.b, qs.sim, CASE WHEN same_document OR same_author THEN 'self_inconsistency' WHEN known AND qsim < 0.5 THEN 'weak_contradicts' ELSE 'contradicts' END AS type FROM f JOIN qs ON qs.a = f.a AND qs.b = f.b) "
)


def question_similarity(t: Tables, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, q) with qsim: the smaller cosine of the words of q with those of either content; null where one is missing."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), 1))
    n = t.nd("content").where("content IS NOT NULL").select("id", words(F.col("content")).alias("w"))
    both = pairs.join(n.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a", "left").join(n.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b", "left").withColumn("wq", words(F.col("q")))
    cos = lambda x: F.try_divide(F.size(F.array_intersect("wq", x)).cast("double"), F.sqrt((F.size("wq") * F.size(x)).cast("double")))
    known = F.col("q").isNotNull() & F.col("wa").isNotNull() & F.col("wb").isNotNull()
    return both.withColumn("qsim", F.when(known, F.least(cos("wa"), cos("wb")))).drop("wa", "wb", "wq")


def routed(t: Tables, pairs: DataFrame) -> DataFrame:
    """Contradictions (a, b, sim, q) as directed edges of the kind their sources, authors and question make them."""
    flagged = Q.cross_source_pairs(question_similarity(t, pairs), t.attestations, t.nd("source_author"))
    return Q.route_contradictions(flagged, "qsim", C.DEFAULT.shared_question)


@query("G06_routed_contradictions", _ROUTED + "SELECT a AS src, b AS dst, type, sim AS strength FROM ro UNION ALL SELECT b, a, type, sim FROM ro")
def g06(t: Tables):
    p = t.ge.where("type = 'contradicts'").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.coalesce("strength", F.lit(0.0))).alias("sim"), F.max(F.nullif(F.trim("shared_question"), F.lit(""))).alias("q"))
    return routed(t, p)


@query("G07_divergence_edges", "SELECT src, dst, max(strength) AS strength FROM (SELECT src, dst, coalesce(strength, 0) AS strength FROM {ge} WHERE type = 'quantitative_divergence' UNION ALL SELECT dst, src, coalesce(strength, 0) FROM {ge} WHERE type = 'quantitative_divergence') GROUP BY 1, 2")
def g07(t: Tables):
    e = t.ge.where("type = 'quantitative_divergence'").select("src", "dst", F.coalesce("strength", F.lit(0.0)).alias("strength"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength")).groupBy("src", "dst").agg(F.max("strength").alias("strength"))


@query("G08_removed_nodes", "SELECT e.src, e.dst, e.type FROM {ge} e WHERE e.dst IN (SELECT id FROM {nd} WHERE status = 'archived') AND e.src NOT IN (SELECT id FROM {nd} WHERE status = 'archived')")
def g08(t: Tables):
    """Edges left dangling when archived nodes are removed."""
    gone = t.nodes.where("status = 'archived'").select("id").distinct()
    return t.ge.select("src", "dst", "type").join(gone.select(F.col("id").alias("dst")), "dst", "left_semi").join(gone.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst", "type")


@query("G09_presupposes_fan_out", "SELECT DISTINCT m.claim_id AS src, e.dst, 'presupposes' AS type, 0.9::DOUBLE AS strength FROM {cx} r JOIN {ge} e ON e.src = r.claim_id AND e.type = 'presupposes' JOIN {cx} m ON m.crux = r.crux WHERE m.claim_id <> e.dst")
def g09(t: Tables):
    """Every claim of a cluster (here: of a key question) takes over the presuppositions of the others."""
    m = relations.crux_claims(t)
    pre = m.join(t.ge.where("type = 'presupposes'").select(F.col("src").alias("claim_id"), "dst"), "claim_id").select("crux", "dst").distinct()
    return m.join(pre, "crux").where("claim_id <> dst").select(F.col("claim_id").alias("src"), "dst", F.lit("presupposes").alias("type"), F.lit(0.9).alias("strength")).distinct()


def reconciled(t: Tables, label: str) -> dict[str, DataFrame]:
    """The whole step in its order, each stage as a table.

    Own edges are cleared; pairs of one question across sources are taken that no conflict edge and no stance keeps apart;
    from the automatic threshold up they merge, below it the recorded verdict decides; groups are resolved and merged into
    canonical nodes; contradictions among survivors are routed anew; attestations are pruned, status is computed and the
    strengths are reported.
    """
    base = stash(t.ge.where("source IS NULL OR source <> 'reconcile'").select("src", "dst", "type", "strength", "shared_question"), label + "-b")
    conflicts = stash(G.conflict_pairs(base), label + "-k")
    free = Q.merge_candidates(confirmed(t), t.attestations, t.nd("source_author"), conflicts).select("a", "b", "sim")
    apart = filters.f17(t).where("conflict").select("a", "b")
    pairs = stash(free.join(apart, ["a", "b"], "left_anti"), label + "-c")
    high = F.col("sim") >= C.DEFAULT.auto_merge
    said = Q.judged(pairs.where(~high), joins.recorded_verdicts(t)).where("verdict = 'same'").select("a", "b", "sim")
    groups = stash(U.merge_groups(pairs.where(high).unionByName(said), conflicts, label=label + "-g"), label + "-gr")
    ids = stash(G.canonical_members(groups, t.nodes), label + "-m")
    survivors = stash(t.nodes.select("id").distinct().join(ids.where("id <> canonical").select("id"), "id", "left_anti"), label + "-s")
    moved = G.redirected(base.where("type <> 'contradicts'").select("src", "dst", "type", "strength"), ids)
    a, b = ids.select(F.col("id").alias("src"), F.col("canonical").alias("s2")), ids.select(F.col("id").alias("dst"), F.col("canonical").alias("d2"))
    against = base.where("type = 'contradicts'").join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("s2", "src").alias("x"), F.coalesce("d2", "dst").alias("y"), "strength", "shared_question").where("x <> y")
    swept = against.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.coalesce("strength", F.lit(0.0))).alias("sim"), F.max(F.nullif(F.trim("shared_question"), F.lit(""))).alias("q"))
    edges = stash(moved.unionByName(routed(t, swept)).groupBy("src", "dst", "type").agg(F.max("strength").alias("strength")), label + "-e")
    kept = filters.pruned_attestations(t).join(ids.select(F.col("id").alias("node_id"), "canonical"), "node_id", "left").withColumn("node_id", F.coalesce("canonical", "node_id")).drop("canonical")
    kept = stash(kept.distinct(), label + "-a")
    report = aggregates.strength_report(edges, kept, t.nd("source_author"))
    return {"pairs": pairs, "members": ids, "survivors": survivors, "edges": edges, "attestations": kept, "status": Q.epistemic_fields(survivors, kept, edges), "report": report}


@query("G10_reconciled")
def g10(t: Tables):
    """The status of every surviving node at the end of the step."""
    return reconciled(t, "g10")["status"]


@query("G10_edges_by_type")
def g10_edges(t: Tables):
    return reconciled(t, "g10e")["edges"].groupBy("type").agg(F.count("*").alias("n"))


@query("G10_report")
def g10_report(t: Tables):
    return reconciled(t, "g10r")["report"]


@query("G10_candidate_pairs", "SELECT count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label WHERE " + joins._DOT + " >= 0.4")
def g10_pairs(t: Tables):
    """The exact vector join on the vectors of the test tables, within a label."""
    p = M.vector_pairs(t.embeddings, "vec_id", "embedding", 0.4)
    kind = t.embeddings.select("vec_id", "label")
    return p.join(kind.select(F.col("vec_id").alias("a"), F.col("label").alias("x")), "a").join(kind.select(F.col("vec_id").alias("b"), F.col("label").alias("y")), "b").where("x = y").agg(F.count("*").alias("n"))
