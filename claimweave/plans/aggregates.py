"""A, W and O: aggregations, ranking and ordered views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.functions import text as X
from claimweave.operators import clustering, methodology
from claimweave.operators import compile as K
from claimweave.operators import graph as G
from claimweave.operators import reconcile as Q
from claimweave.operators import similarity as M
from claimweave.plans import filters, joins, relations
from claimweave.plans.registry import Tables, query
from claimweave.runtime import bounded, stash

_EPI = (
    "WITH att AS (SELECT DISTINCT node_id, sk FROM {ak} WHERE sk IS NOT NULL), su AS (SELECT node_id AS id, count(*) AS n FROM att GROUP BY 1), "
    "ag AS (SELECT e.dst AS id, count(DISTINCT sk) FILTER (WHERE e.type = 'contradicts' AND coalesce(strength, 0) >= 0.55) AS s, count(DISTINCT sk) FILTER (WHERE NOT (e.type = 'contradicts' AND coalesce(strength, 0) >= 0.55)) AS w FROM {ge} e JOIN att ON att.node_id = e.src WHERE e.type IN ('contradicts', 'weak_contradicts') GROUP BY 1), "
    "ep AS (SELECT n.id, n.type, coalesce(su.n, 0) AS support_count, coalesce(ag.s, 0) AS contradict_count, coalesce(ag.w, 0) AS weak_contradict_count, CASE WHEN coalesce(ag.s, 0) > 0 THEN 'contested' WHEN coalesce(ag.w, 0) > 0 THEN 'contested_weak' WHEN coalesce(su.n, 0) >= 3 THEN 'well_established' WHEN coalesce(su.n, 0) = 2 THEN 'supported' ELSE 'single_source' END AS epistemic_status FROM {nd} n LEFT JOIN su ON su.id = n.id LEFT JOIN ag ON ag.id = n.id) "
)


def epistemic(t: Tables):
    return Q.epistemic_fields(t.nodes.select("id"), t.attestations, t.ge)


@query("A01_epistemic_fields", _EPI + "SELECT id, support_count, contradict_count, weak_contradict_count, epistemic_status FROM ep")
def a01(t: Tables):
    return epistemic(t)


@query("A02_source_counts", "SELECT node_id, count(DISTINCT sk) AS n_sources FROM {ak} GROUP BY 1")
def a02(t: Tables):
    return t.ak.groupBy("node_id").agg(F.count_distinct("sk").alias("n_sources"))


@query("A03_attestations_by_source", "SELECT node_id, coalesce(sk, 'anonymous ' || att_ord) AS source, count(*) AS n, count(DISTINCT nullif(trim(quote), '')) AS n_quotes FROM {ak} GROUP BY 1, 2")
def a03(t: Tables):
    return t.ak.groupBy("node_id", F.coalesce("sk", F.concat(F.lit("anonymous "), F.col("att_ord").cast("string"))).alias("source")).agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.trim("quote"), F.lit(""))).alias("n_quotes"))


@query("A04_graph_stats", "SELECT coalesce(type, 'total') AS type, count(*) AS n FROM {nd} GROUP BY ROLLUP (type)")
def a04(t: Tables):
    return t.nd("type").rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("total")).alias("type"), "n")


@query(
    "A05_invariants",
    "SELECT 'self_loops' AS invariant, count(*) AS n FROM {rr} WHERE src = dst UNION ALL SELECT 'duplicate_relations', count(*) - count(DISTINCT src || '|' || dst || '|' || type) FROM {rr} UNION ALL SELECT 'dangling_targets', count(*) FROM {rl} WHERE dst NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'unknown_types', count(*) FROM {rl} WHERE type NOT IN (" + ", ".join(f"'{x}'" for x in C.RELATION_TYPES) + ") UNION ALL SELECT 'attestations_without_source', count(*) FROM {ak} WHERE sk IS NULL UNION ALL SELECT 'unattested_claims', count(*) FROM {nd} WHERE type IN ('claim', 'evidence') AND id NOT IN (SELECT node_id FROM attestations)",
)
def a05(t: Tables):
    r = t.relations.select(F.lower(F.trim("src")).alias("src"), F.lower(F.trim("dst")).alias("dst"), G.relation_type().alias("type"))
    rl, ids = t.rl, t.nodes.select("id").distinct()
    one = lambda name, df: df.agg(F.lit(name).alias("invariant"), F.count("*").alias("n"))
    parts = [
        one("self_loops", r.where("src = dst")),
        r.groupBy("src", "dst", "type").agg((F.count("*") - 1).alias("k")).agg(F.lit("duplicate_relations").alias("invariant"), F.coalesce(F.sum("k"), F.lit(0)).alias("n")),
        one("dangling_targets", rl.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")),
        one("unknown_types", rl.where(~F.col("type").isin(*C.RELATION_TYPES))),
        one("attestations_without_source", t.ak.where("sk IS NULL")),
        one("unattested_claims", t.nd("type").where("type IN ('claim', 'evidence')").join(t.attestations.select(F.col("node_id").alias("id")), "id", "left_anti")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("A06_status_summary", _EPI + "SELECT s.status, count(ep.id) AS n FROM (SELECT unnest(['contested', 'contested_weak', 'well_established', 'supported', 'single_source']) AS status) s LEFT JOIN ep ON ep.epistemic_status = s.status AND ep.type IN ('claim', 'evidence') GROUP BY 1")
def a06(t: Tables):
    dim = t.spark.createDataFrame([(s,) for s in C.STATUSES], "status string")
    n = epistemic(t).join(t.nd("type").where("type IN ('claim', 'evidence')"), "id", "left_semi").groupBy(F.col("epistemic_status").alias("status")).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


_BUCKET = "least(floor((least(greatest(coalesce(strength, 0), 0.4::DOUBLE), 0.9999999990::DOUBLE) - 0.4::DOUBLE) / 0.05::DOUBLE), 11)::INT"


@query(
    "A07_strength_report",
    joins._sets("(SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {ge} WHERE type IN ('contradicts', 'weak_contradicts'))")
    + f"SELECT {_BUCKET} AS bucket, count(*) AS n, count(*) FILTER (WHERE coalesce(strength, 0) < 0.55) AS below_floor, count(*) FILTER (WHERE f.same_document) AS intra_document, count(*) FILTER (WHERE f.same_author) AS same_author FROM {{ge}} e JOIN f ON f.a = least(e.src, e.dst) AND f.b = greatest(e.src, e.dst) WHERE e.type IN ('contradicts', 'weak_contradicts') GROUP BY 1",
)
def a07(t: Tables):
    return strength_report(t.ge, t.attestations, t.nd("source_author"))


def strength_report(edges, attestations, nodes):
    """Directed contradictions by bucket of strength: all, those below the floor, within one document, by the same authors."""
    e = edges.where("type IN ('contradicts', 'weak_contradicts')").select("src", "dst", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("strength", F.lit(0.0)).alias("s"))
    flags = Q.cross_source_pairs(e.select("a", "b").distinct(), attestations, nodes)
    return e.join(flags, ["a", "b"]).groupBy(Q.strength_bucket(F.col("s")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("s") < C.DEFAULT.strong_contradiction).alias("below_floor"), F.count_if("same_document").alias("intra_document"), F.count_if("same_author").alias("same_author"))


@query(
    "A08_propositions",
    "WITH k AS (SELECT q, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS edge_types FROM (SELECT q, type, count(*) AS n FROM {qe} GROUP BY 1, 2) GROUP BY 1), l AS (SELECT q, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids FROM {qc} GROUP BY 1) SELECT printf('prop_%04d', row_number() OVER (ORDER BY edge_count DESC, p.q) - 1) AS prop_id, p.q, edge_count, edge_types, claim_ids, n_sources, status FROM {pp} p JOIN k ON k.q = p.q JOIN l ON l.q = p.q",
)
def a08(t: Tables):
    """Propositions of equal questions; A08_clustered_propositions has them of clustered questions."""
    return K.proposition_records(t.ge, t.ak, "a08")


def question_vectors(t: Tables):
    """(id, ord, v, q): the distinct shared questions in their order (longest first, then by text), with hashed word vectors."""
    q = K.positions(K.question_edges(t.ge).select("q").distinct(), [F.desc(F.length("q")), F.col("q")], "questions", "id")
    v = M.hashed_vectors(q, "id", "q")
    return q.join(v, "id").select("id", F.col("id").alias("ord"), "v", "q")


def clustered_questions(t: Tables, label: str):
    """(q, cluster): questions under the first question of their cluster, by centroids and then merging of centroids."""
    q = stash(question_vectors(t), label + "-q")
    have = q.where("v IS NOT NULL")
    first = stash(clustering.centroid_clusters(have.select("id", "ord", "v"), C.DEFAULT.proposition, label), label + "-c")
    parts = first.join(have, "id").select("cluster", F.size("v").alias("dims"), F.posexplode("v").alias("pos", "x")).where("x <> 0").groupBy("cluster", "pos").agg(F.sum("x").alias("x"), F.max("dims").alias("dims"))
    total = parts.groupBy("cluster").agg(F.expr("transform(sequence(0, max(dims) - 1), p -> coalesce(try_element_at(map_from_entries(collect_list(struct(pos, x))), p), 0D))").alias("total"))
    total = stash(total, label + "-t")
    fused = clustering.merged_centroids(total, C.DEFAULT.proposition)
    named = first.join(fused, "cluster").join(have.select(F.col("id").alias("merged"), F.col("q").alias("name")), "merged")
    return q.join(named.select("id", "name"), "id", "left").select("q", F.coalesce("name", "q").alias("cluster")), total


@query("A08_clustered_propositions")
def a08_clustered(t: Tables):
    names = stash(clustered_questions(t, "a08c")[0], "a08c-n")
    e = K.question_edges(t.ge).join(names, "q").select("src", "dst", "type", "strength", F.col("cluster").alias("shared_question"), F.lit(None).cast("string").alias("rationale"))
    return K.proposition_records(e, t.ak, "a08d")


def props(t: Tables):
    return K.propositions(t.ge, t.ak)


@query("A09_boundary_calibration")
def a09(t: Tables):
    """Edges per proposition of clustered questions, the pairs of centroids still at or above the threshold, and the closest."""
    names, total = clustered_questions(t, "a09")
    names = stash(names, "a09-n")
    n = K.question_edges(t.ge).join(names, "q").groupBy("cluster").agg(F.count("*").alias("n")).agg(F.sum("n").alias("edges"), F.count("*").alias("propositions"))
    norm = F.sqrt(F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x))
    unit = total.withColumn("norm", norm).select(F.col("cluster").alias("id"), F.transform("total", lambda x: x / F.col("norm")).alias("v"))
    near = stash(M.vector_pairs(unit, "id", "v", 0.5), "a09-p")
    pairs = near.agg(F.count_if(F.col("sim") >= C.DEFAULT.proposition).alias("boundary_pairs"), F.round(F.max("sim"), 6).alias("closest"))
    out = n.withColumn("boundary_pairs", pairs.select("boundary_pairs").scalar()).withColumn("closest", pairs.select("closest").scalar())
    return out.withColumn("collapse_ratio", F.round(F.try_divide("edges", "propositions"), 6))


def _coverage(floor: float) -> str:
    return f"SELECT {floor}::DOUBLE AS floor, sum(edge_count)::BIGINT AS m, coalesce(sum(edge_count) FILTER (WHERE hit), 0)::BIGINT AS m_covered, count(*) AS n, round(coalesce(sum(edge_count) FILTER (WHERE hit), 0)::DOUBLE / nullif(sum(edge_count), 0), 4) AS coverage FROM (SELECT p.*, p.q IN (SELECT q FROM {{bm}} WHERE q IS NOT NULL AND coalesce(j, 0) >= {floor}) AS hit FROM {{pp}} p WHERE status = 'contested' AND n_sources >= 2)"


@query("A10_dispute_coverage", _coverage(0.0) + " UNION ALL " + _coverage(0.1))
def a10(t: Tables):
    p, m = props(t), joins.matches(t)
    out = None
    for floor in (0.0, C.DEFAULT.jaccard_floor):
        covered = F.coalesce(F.sum(F.when(F.col("covered"), F.col("edge_count"))), F.lit(0))
        one = K.disputes(p, m, floor).agg(F.lit(floor).alias("floor"), F.sum("edge_count").alias("m"), covered.alias("m_covered"), F.count("*").alias("n"), F.round(F.try_divide(covered, F.sum("edge_count")), 4).alias("coverage"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "A11_alignment_summary",
    "SELECT count(*) AS n_cruxes, count(*) FILTER (WHERE coalesce(j, 0) >= 0.3) AS strong, count(*) FILTER (WHERE coalesce(j, 0) < 0.1) AS orphan_cruxes, round(avg(coalesce(j, 0)), 6) AS mean_jaccard, (SELECT count(*) FROM {pp} WHERE status = 'contested' AND edge_count >= 2 AND n_sources >= 2 AND q NOT IN (SELECT q FROM {bm} WHERE q IS NOT NULL AND j >= 0.1)) AS orphan_propositions FROM {bm}",
)
def a11(t: Tables):
    m = joins.matches(t)
    orphans = K.disputes(props(t), m, C.DEFAULT.jaccard_floor).where("NOT covered AND edge_count >= 2").agg(F.count("*"))
    head = m.agg(F.count("*").alias("n_cruxes"), F.count_if(F.col("jaccard") >= C.DEFAULT.strong_alignment).alias("strong"), F.count_if(F.col("jaccard") < C.DEFAULT.jaccard_floor).alias("orphan_cruxes"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))
    return head.withColumn("orphan_propositions", orphans.scalar())


_IMP = (
    "WITH n AS (SELECT id, type, coalesce(evidential_weight, 0) AS w FROM {nd} WHERE type IN ('claim', 'evidence')), a AS (SELECT DISTINCT node_id AS id, sk FROM {ak} WHERE sk IS NOT NULL), s AS (SELECT id, count(*) = 1 AS sole FROM a GROUP BY 1), "
    "r AS (SELECT n.*, a.sk, s.sole, n.id IN (SELECT claim_id FROM {cx}) AS crux FROM n JOIN a ON a.id = n.id JOIN s ON s.id = n.id), "
    "g AS (SELECT sk AS source_id, count(*) FILTER (WHERE type = 'claim') AS claims_count, count(*) FILTER (WHERE type = 'evidence') AS evidence_count, count(*) FILTER (WHERE sole) AS unique_claims_count, count(*) FILTER (WHERE sole AND w >= 0.7) AS high_value_unique, count(*) FILTER (WHERE crux) AS crux_claims_count, count(*) FILTER (WHERE crux AND sole) AS crux_exclusive_count, floor((2 * sum(round(w * 10000)::BIGINT) + 10 * count(*))::DOUBLE / (20 * count(*))) / 1000 AS mean_evidential_weight FROM r GROUP BY 1), "
    "im AS (SELECT *, round(2.0 * high_value_unique + 3.0 * crux_exclusive_count + 0.5 * unique_claims_count + 0.25 * crux_claims_count, 2)::DOUBLE AS epistemic_risk, CASE WHEN crux_exclusive_count >= 1 OR crux_claims_count >= 3 THEN 'central' WHEN high_value_unique >= 2 AND unique_claims_count >= 0.6 * (claims_count + evidence_count) THEN 'latent_gem' WHEN crux_claims_count >= 1 OR unique_claims_count >= 2 THEN 'contributory' ELSE 'peripheral' END AS importance_tier FROM g) "
)


def importance(t: Tables):
    return K.source_importance(t.nd("type", "evidential_weight"), t.ak, relations.crux_claims(t))


@query("A12_source_importance", _IMP + "SELECT * FROM im")
def a12(t: Tables):
    return importance(t)


@query("A13_multi_source_cards", "SELECT n.id, count(DISTINCT sk) AS support, coalesce(any_value(n.evidential_weight), 0) AS weight FROM {nd} n JOIN {ak} a ON a.node_id = n.id WHERE n.type IN ('claim', 'evidence') AND coalesce(trim(quote), '') <> '' GROUP BY 1 HAVING count(DISTINCT sk) > 1 ORDER BY support DESC, weight DESC, n.id LIMIT 40")
def a13(t: Tables):
    n = t.ak.where("coalesce(trim(quote), '') <> ''").groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("sk").alias("support")).where("support > 1")
    rows = t.nd("type", "evidential_weight").where("type IN ('claim', 'evidence')").join(n, "id").select("id", "support", F.coalesce("evidential_weight", F.lit(0.0)).alias("weight"))
    return rows.orderBy(F.desc("support"), F.desc("weight"), "id").limit(40)


@query("A14_cluster_source_span", "WITH m AS (SELECT crux, claim_id FROM {cx}), b AS (SELECT crux FROM m GROUP BY 1 HAVING count(*) > 1) SELECT m.crux, count(DISTINCT sk) AS n_sources FROM m JOIN b ON b.crux = m.crux JOIN {ak} a ON a.node_id = m.claim_id GROUP BY 1 HAVING count(DISTINCT sk) > 1")
def a14(t: Tables):
    m = relations.crux_claims(t)
    big = m.groupBy("crux").agg(F.count("*").alias("n")).where("n > 1").select("crux")
    return m.join(big, "crux", "left_semi").join(t.ak.select(F.col("node_id").alias("claim_id"), "sk"), "claim_id").groupBy("crux").agg(F.count_distinct("sk").alias("n_sources")).where("n_sources > 1")


@query("A15_links_by_subfield", "WITH r AS (SELECT coalesce(nullif(trim(n.subfield), ''), 'Uncategorized') AS subfield, e.src, e.dst, e.type, e.strength FROM {ge} e JOIN {nd} n ON n.id = e.src WHERE e.source = 'relate'), g AS (SELECT subfield, count(*) AS group_size FROM r GROUP BY 1) SELECT r.*, g.group_size, row_number() OVER (ORDER BY group_size DESC, r.subfield, coalesce(strength, 0) DESC, src, dst, type) AS pos FROM r JOIN g ON g.subfield = r.subfield")
def a15(t: Tables):
    """Links in groups by subfield, the largest first, within a group the strongest first."""
    sf = t.nd("subfield").select(F.col("id").alias("src"), F.coalesce(F.nullif(F.trim("subfield"), F.lit("")), F.lit("Uncategorized")).alias("subfield"))
    rows = t.ge.where("source = 'relate'").join(sf, "src").select("subfield", "src", "dst", "type", "strength")
    size = bounded(rows.groupBy("subfield").agg(F.count("*").alias("group_size")))
    return K.positions(rows.join(size, "subfield"), [F.desc("group_size"), F.col("subfield"), F.desc(F.coalesce("strength", F.lit(0.0))), F.col("src"), F.col("dst"), F.col("type")], "a15")


@query("A16_quote_counts", "SELECT node_id, sum(greatest(1, q))::BIGINT AS n FROM (SELECT node_id, coalesce(sk, 'anonymous ' || att_ord) AS s, count(DISTINCT nullif(trim(quote), '')) AS q FROM {ak} GROUP BY 1, 2) GROUP BY 1")
def a16(t: Tables):
    q = t.ak.groupBy("node_id", F.coalesce("sk", F.concat(F.lit("anonymous "), F.col("att_ord").cast("string"))).alias("s")).agg(F.count_distinct(F.nullif(F.trim("quote"), F.lit(""))).alias("q"))
    return q.groupBy("node_id").agg(F.sum(F.greatest(F.lit(1), "q")).alias("n"))


CRITERIA = (("peer_reviewed", "FATAL"), ("journalism", "MAJOR"), ("essay_reflection", "MINOR"))
_EVAL = "WITH ev AS (SELECT DISTINCT source_id, source_type AS criterion_id, CASE WHEN quote IS NULL THEN 'not_applicable' WHEN trim(quote) = '' THEN 'not_declared' WHEN length(quote) % 3 = 0 THEN 'red_flag' ELSE 'declared' END AS status FROM attestations WHERE coalesce(trim(source_id), '') <> ''), cr AS (SELECT 'peer_reviewed' AS criterion_id, 3 AS w UNION ALL SELECT 'journalism', 2 UNION ALL SELECT 'essay_reflection', 1), hi AS (SELECT source_id, count(*) AS n FROM attestations WHERE trim(quote) = '' GROUP BY 1), sc AS (SELECT ev.source_id, count(*) FILTER (WHERE status <> 'not_applicable') AS n_applicable, count(*) FILTER (WHERE status = 'declared') AS n_declared, count(*) FILTER (WHERE status IN ('not_declared', 'red_flag')) AS n_missing, coalesce(sum(coalesce(w, 1)) FILTER (WHERE status = 'declared'), 0)::BIGINT AS earned, coalesce(sum(coalesce(w, 1)) FILTER (WHERE status <> 'not_applicable'), 0)::BIGINT AS possible, any_value(hi.n) AS hits FROM ev LEFT JOIN cr ON cr.criterion_id = ev.criterion_id LEFT JOIN hi ON hi.source_id = ev.source_id GROUP BY 1), ms AS (SELECT source_id, CASE WHEN n_applicable = 0 THEN 0.0::DOUBLE ELSE round(least(greatest(0.0::DOUBLE, coalesce(earned::DOUBLE / nullif(possible, 0), 0) - least(0.01::DOUBLE * coalesce(hits, 0), 0.05::DOUBLE)), 0.65::DOUBLE), 3) END AS score, n_applicable, n_declared, n_missing, earned, possible FROM sc) "


def evaluations(t: Tables):
    """(source_id, criterion_id, status) read off attestations, one each."""
    a = t.attestations.where("coalesce(trim(source_id), '') <> ''")
    status = F.when(F.col("quote").isNull(), "not_applicable").when(F.trim("quote") == "", "not_declared").when(F.length("quote") % 3 == 0, "red_flag").otherwise("declared")
    return a.select("source_id", F.col("source_type").alias("criterion_id"), status.alias("status")).distinct()


def audits(t: Tables):
    a = t.attestations.where("coalesce(trim(source_id), '') <> ''")
    return methodology.methodology_scores(evaluations(t), t.spark.createDataFrame(CRITERIA, "criterion_id string, severity string"), a.where("trim(quote) = ''").groupBy("source_id").agg(F.count("*").alias("n")), 0.65)


@query("A17_methodology_scores", _EVAL + "SELECT source_id, score FROM ms")
def a17(t: Tables):
    return audits(t).select("source_id", "score")


@query("A18_score_breakdown", _EVAL + "SELECT *, n_declared || ' of ' || n_applicable || ' applicable criteria declared (' || earned || '/' || possible || ')' AS rationale FROM ms")
def a18(t: Tables):
    s = lambda c: F.col(c).cast("string")
    return audits(t).withColumn("rationale", F.concat(s("n_declared"), F.lit(" of "), s("n_applicable"), F.lit(" applicable criteria declared ("), s("earned"), F.lit("/"), s("possible"), F.lit(")")))


@query("A19_methodology_average", _EVAL + "SELECT count(*) AS n, round(avg(score), 6) AS mean_score, sum(n_missing)::BIGINT AS n_missing FROM ms")
def a19(t: Tables):
    return audits(t).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum("n_missing").alias("n_missing"))


@query(
    "A19_methodology_gaps",
    _EVAL + ", hit AS (SELECT source_id, node_id, att_ord, row_number() OVER (PARTITION BY source_id ORDER BY node_id, att_ord) AS k FROM (SELECT DISTINCT source_id, node_id, att_ord FROM attestations WHERE trim(quote) = '' AND coalesce(trim(source_id), '') <> '')), ln AS (SELECT source_id, 0 AS part, criterion_id || ': ' || status AS line FROM ev WHERE status IN ('not_declared', 'red_flag') UNION ALL SELECT source_id, 1, 'blank quote: ' || node_id || '/' || att_ord FROM hit WHERE k <= 2) SELECT row_number() OVER (ORDER BY source_id, part, line) AS pos, source_id, line FROM ln ORDER BY source_id, part, line LIMIT 20",
)
def a19_gaps(t: Tables):
    """The first 20 lines of the gaps text: criteria not declared or flagged, and up to two hits per audit."""
    ev = evaluations(t).where("status IN ('not_declared', 'red_flag')").select("source_id", F.lit(0).alias("part"), F.concat("criterion_id", F.lit(": "), "status").alias("line"))
    hits = t.attestations.where("trim(quote) = '' AND coalesce(trim(source_id), '') <> ''").select("source_id", "node_id", "att_ord").distinct()
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("node_id", "att_ord"))).where("k <= 2")
    lines = ev.unionByName(hits.select("source_id", F.lit(1).alias("part"), F.concat(F.lit("blank quote: "), "node_id", F.lit("/"), F.col("att_ord").cast("string")).alias("line")))
    top = lines.orderBy("source_id", "part", "line").limit(20)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("source_id", "part", "line")).cast("bigint")).select("pos", "source_id", "line")


@query("A20_verification_report", filters._PARAM + "SELECT count(*) AS total, count(*) FILTER (WHERE new = 'from_evidence') AS from_evidence, count(*) FILTER (WHERE new = 'external_standard') AS external_standard, count(*) FILTER (WHERE new = 'ungrounded') AS ungrounded, count(*) FILTER (WHERE new <> g) AS overrides, round(100.0 * count(*) FILTER (WHERE new IN ('from_evidence', 'external_standard')) / nullif(count(*), 0), 1)::DOUBLE AS grounded_pct, count(*) FILTER (WHERE g = 'expert_guess') AS invented, (SELECT count(*) FROM (SELECT key_question AS q FROM {nd} WHERE coalesce(trim(key_question), '') <> '' GROUP BY 1 HAVING count(*) FILTER (WHERE type = 'claim') = 0)) AS zero_evidence, (SELECT count(*) FROM (SELECT source_id FROM {bd} GROUP BY 1 HAVING sum(least(length(body), 40000) + 2) - 2 > 100000)) AS truncated FROM r")
def a20(t: Tables):
    """Parameters by grounding; cruxes without a claim, sources whose corpus exceeds the verifier's budget."""
    p, g = filters.parameters(t), F.col("grounding")
    bare = t.nd("type", "key_question").where("coalesce(trim(key_question), '') <> ''").groupBy("key_question").agg(F.count_if(F.col("type") == "claim").alias("k")).where("k = 0").agg(F.count("*"))
    cut = t.bd.groupBy("source_id").agg((F.sum(F.least(F.length("body"), F.lit(40_000)) + 2) - 2).alias("n")).where("n > 100000").agg(F.count("*"))
    n = lambda x: F.count_if(g == x)
    return p.agg(F.count("*").alias("total"), n("from_evidence").alias("from_evidence"), n("external_standard").alias("external_standard"), n("ungrounded").alias("ungrounded"), F.count_if(g != F.col("declared")).alias("overrides"), F.round(F.try_divide(100.0 * F.count_if(g != "ungrounded"), F.count("*")), 1).alias("grounded_pct"), F.count_if(F.col("declared") == "expert_guess").alias("invented")).withColumn("zero_evidence", bare.scalar()).withColumn("truncated", cut.scalar())


@query("A21_groundedness", joins._GROUND + "SELECT coalesce(d.source, 'total') AS section, count(*) AS paragraphs, count(*) FILTER (WHERE grounded) AS grounded, round(100.0 * (count(*) FILTER (WHERE grounded))::DOUBLE / count(*)::DOUBLE, 2)::DOUBLE AS grounded_pct FROM gr JOIN documents d ON d.doc_id = gr.doc_id GROUP BY ROLLUP (d.source)")
def a21(t: Tables):
    """Per source and in total: share of grounded paragraphs of its documents."""
    g = joins.j22(t).join(t.documents.select("doc_id", "source"), "doc_id")
    out = g.rollup("source").agg(F.count("*").alias("paragraphs"), F.count_if("grounded").alias("grounded"))
    return out.select(F.coalesce("source", F.lit("total")).alias("section"), "paragraphs", "grounded", F.round(100.0 * F.col("grounded") / F.col("paragraphs"), 2).alias("grounded_pct"))


_CITE = "cp AS (SELECT e.source AS section, e.src, e.dst, e.type, n.case_name, e.rel_ord, e.dst IN (SELECT id FROM nodes) AS valid FROM {rl} e JOIN {nd} n ON n.id = e.src)"


def citing(t: Tables):
    """One paragraph per relation, which cites its target: (section, case_name, rel_ord, explicit); text and valid ids are joined
    as in a report. A paragraph is explicit where an id it cites exists."""
    text = t.rl.join(t.nd("case_name").withColumnRenamed("id", "src"), "src").select(F.col("source").alias("section"), "case_name", "rel_ord", "src", "type", F.concat(F.lit("It is said to matter [gap_"), "dst", F.lit("].")).alias("text"))
    cited = text.select("*", F.explode_outer(X.cited_ids(F.col("text"))).alias("i")).withColumn("i", X.normal_id(F.col("i")))
    ids = t.nodes.select(F.col("id").alias("i"), F.lit(True).alias("ok")).distinct()
    return cited.join(ids, "i", "left").groupBy("section", "case_name", "rel_ord", "src", "type", "text").agg(F.count_distinct("i").alias("cited"), F.count_distinct(F.when(F.col("ok"), F.col("i"))).alias("valid"))


_WHOLE = "regexp_matches(e.dst, '^[a-f0-9]{8}$')"


@query("A21_citations", "WITH " + _CITE.replace("e.dst IN (SELECT", f"{_WHOLE} AND e.dst IN (SELECT").replace("AS valid", f"AS valid, CASE WHEN {_WHOLE} THEN 1 ELSE 0 END AS cited") + " SELECT coalesce(section, 'total') AS section, count(*) AS paragraphs, sum(cited)::BIGINT AS cited, count(*) FILTER (WHERE valid) AS valid, round(100.0 * (count(*) FILTER (WHERE valid))::DOUBLE / count(*), 2)::DOUBLE AS explicit_pct, round(100.0 * (count(*) FILTER (WHERE valid))::DOUBLE / nullif(sum(cited), 0), 2)::DOUBLE AS validity_pct FROM cp GROUP BY ROLLUP (section)")
def a21_citations(t: Tables):
    out = citing(t).rollup("section").agg(F.count("*").alias("paragraphs"), F.sum("cited").alias("cited"), F.sum("valid").alias("valid"), F.count_if(F.col("valid") > 0).alias("explicit"))
    pct = lambda x, y: F.round(F.try_divide(100.0 * F.col(x), F.col(y)), 2)
    return out.select(F.coalesce("section", F.lit("total")).alias("section"), "paragraphs", "cited", "valid", pct("explicit", "paragraphs").alias("explicit_pct"), pct("valid", "cited").alias("validity_pct"))


@query("A22_crux_criticality", "WITH ti AS (SELECT theme, bool_or(needs) AS needs FROM {th} GROUP BY 1) SELECT crux, sum(CASE WHEN needs THEN 4 ELSE 1 END)::BIGINT AS criticality FROM {ct} c JOIN ti ON ti.theme = c.theme GROUP BY 1")
def a22(t: Tables):
    ti = relations.themes(t).groupBy("theme").agg(F.bool_or("needs").alias("needs"))
    return relations.crux_themes(t).join(ti, "theme").groupBy("crux").agg(F.sum(F.when(F.col("needs"), 4).otherwise(1)).alias("criticality"))


_CEN = "WITH o AS (SELECT src, count(*) AS n, count(*) FILTER (WHERE type = 'presupposes') AS p FROM {ge} GROUP BY 1), ce AS (SELECT n.id, n.ord, coalesce(o.n, 0) AS relation_count, coalesce(o.n, 0) + 2.0::DOUBLE * coalesce(o.p, 0) + 3.0::DOUBLE * coalesce(n.evidential_weight, 0) + CASE WHEN coalesce(specificity_score < 0.3, false) OR NOT coalesce(quote_grounded, false) OR coalesce(polarity_risk IN ('high', 'conflict'), false) THEN 2.0 ELSE 0.0 END AS c FROM {nd} n LEFT JOIN o ON o.src = n.id WHERE n.type = 'claim') "


def centrality(t: Tables):
    return K.centrality(relations.reviewed_nodes(t), t.ge)


@query("A23_centrality", _CEN + "SELECT id, round(c, 6) AS centrality, relation_count FROM ce")
def a23(t: Tables):
    return centrality(t).select("id", F.round("centrality", 6).alias("centrality"), "relation_count")


@query("A24_ingest_counters", "SELECT count(*) AS deliveries, count(DISTINCT id) AS ids, count(*) FILTER (WHERE coalesce(trim(content), '') = '') AS blank, count(DISTINCT source_id) AS sources FROM nodes")
def a24(t: Tables):
    return t.nodes.agg(F.count("*").alias("deliveries"), F.count_distinct("id").alias("ids"), F.count_if(F.coalesce(F.trim("content"), F.lit("")) == "").alias("blank"), F.count_distinct("source_id").alias("sources"))


@query(
    "A24_reconcile_counters",
    joins._sets(joins._SAME)
    + f", st AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(coalesce(strength, 0.75)) AS sim FROM {{rl}} WHERE type = 'same_as' AND src <> dst GROUP BY 1, 2), k AS {joins._CONF}, x AS (SELECT f.*, st.sim, k.a IS NOT NULL AS blocked FROM f JOIN st ON st.a = f.a AND st.b = f.b LEFT JOIN k ON k.a = f.a AND k.b = f.b) SELECT count(*) AS pairs, count(*) FILTER (WHERE cross_paper) AS cross_paper, count(*) FILTER (WHERE cross_paper AND blocked) AS blocked, count(*) FILTER (WHERE cross_paper AND NOT blocked AND sim >= 0.75) AS auto, count(*) FILTER (WHERE cross_paper AND NOT blocked AND sim < 0.75) AS judged FROM x",
)
def a24_reconcile(t: Tables):
    """The reconcile step's counters as one row."""
    st = t.rl.where("type = 'same_as' AND src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.coalesce("strength", F.lit(0.75))).alias("sim"))
    x = joins.flagged_pairs(t).join(st, ["a", "b"]).join(G.conflict_pairs(t.ge).withColumn("blocked", F.lit(True)), ["a", "b"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    cp, free, high = F.col("cross_paper"), F.col("cross_paper") & ~F.col("blocked"), F.col("sim") >= C.DEFAULT.auto_merge
    return x.agg(F.count("*").alias("pairs"), F.count_if(cp).alias("cross_paper"), F.count_if(cp & F.col("blocked")).alias("blocked"), F.count_if(free & high).alias("auto"), F.count_if(free & ~high).alias("judged"))


_FAST = ("click", "view")


@query("A25_cost_ledger", "WITH c AS (SELECT event_type, value AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS o, event_type IN ('click', 'view') AS fast FROM events) SELECT coalesce(event_type, 'total') AS label, round(sum(coalesce(i, 0) * CASE WHEN fast THEN 0.25::DOUBLE ELSE 3.0::DOUBLE END + coalesce(o, 0) * CASE WHEN fast THEN 1.25::DOUBLE ELSE 15.0::DOUBLE END) / 1e6, 6) AS cost, count(*) AS calls FROM c GROUP BY ROLLUP (event_type)")
def a25(t: Tables):
    """A call log priced by tier, input and output tokens apart; events stand for calls, two of their types for the fast tier."""
    e = t.events.select("event_type", F.coalesce("value", F.lit(0.0)).alias("i"), F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("o"))
    return K.cost_ledger(e, "event_type", F.when(F.col("event_type").isin(*_FAST), "fast").otherwise("smart"))


@query(
    "A26_medoids",
    "WITH c AS (SELECT label, list_transform(generate_series(1, 64), lambda i: list_avg(list_transform(vs, lambda v: v[i]))) AS c FROM (SELECT label, list(embedding::DOUBLE[]) AS vs FROM embeddings GROUP BY 1)), s AS (SELECT e.label, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], c.c), 9) AS sim FROM embeddings e JOIN c ON c.label = e.label) SELECT label AS cluster, vec_id AS medoid, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS k FROM s) WHERE k = 1",
)
def a26(t: Tables):
    e = t.embeddings
    return clustering.medoids(e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


@query("A27_display_status", "WITH q AS (SELECT node_id AS id, count(DISTINCT sk) AS n FROM {ak} WHERE coalesce(trim(quote), '') <> '' GROUP BY 1), k AS (SELECT DISTINCT dst AS id FROM {ge} WHERE type = 'contradicts') SELECT n.id, CASE WHEN coalesce(trim(epistemic_status), '') <> '' THEN trim(epistemic_status) WHEN n.id IN (SELECT id FROM k) THEN 'contested' WHEN coalesce(q.n, 0) >= 3 THEN 'well_established' WHEN coalesce(q.n, 0) >= 2 THEN 'supported' ELSE 'single_source' END AS status FROM {nd} n LEFT JOIN q ON q.id = n.id")
def a27(t: Tables):
    q = t.ak.where("coalesce(trim(quote), '') <> ''").groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("sk").alias("n"))
    k = t.ge.where("type = 'contradicts'").select(F.col("dst").alias("id")).distinct().withColumn("k", F.lit(True))
    n = F.coalesce("n", F.lit(0))
    status = F.coalesce(F.nullif(F.trim("epistemic_status"), F.lit("")), F.when(F.col("k"), "contested").when(n >= 3, "well_established").when(n >= 2, "supported").otherwise("single_source"))
    return t.nd("epistemic_status").join(q, "id", "left").join(k, "id", "left").select("id", status.alias("status"))


_NOTE = (
    "WITH " + _CITE.replace("e.dst IN (SELECT", f"{_WHOLE} AND e.dst IN (SELECT").replace("AS valid", f"AS valid, CASE WHEN {_WHOLE} THEN 1 ELSE 0 END AS cited") + ", s AS (SELECT case_name, rel_ord + 1 AS no, CASE WHEN 100.0 * count(*) FILTER (WHERE valid) / count(*) >= 50 THEN 'graph' ELSE 'synthesis' END AS kind FROM cp GROUP BY 1, 2 HAVING count(*) >= 3), "
    "i AS (SELECT *, no - row_number() OVER (PARTITION BY case_name, kind ORDER BY no) AS k FROM s), r AS (SELECT case_name, kind, min(no) AS lo, max(no) AS hi FROM i GROUP BY case_name, kind, k), g AS (SELECT case_name, kind, string_agg(CASE WHEN lo = hi THEN '§' || lo ELSE '§' || lo || '–§' || hi END, ', ' ORDER BY lo) AS ranges FROM r GROUP BY 1, 2), "
    "v AS (SELECT case_name, 100.0 * (count(*) FILTER (WHERE valid))::DOUBLE / nullif(sum(cited), 0) AS pct FROM cp GROUP BY 1) "
    "SELECT v.case_name, concat_ws('; ', a.ranges || ' are graph-derived', b.ranges || ' combine paraphrase with synthesis', CASE WHEN coalesce(pct, 100) >= 99.95 THEN 'no hallucinated references' ELSE CAST(round((100 - pct) * 10)::BIGINT AS VARCHAR) || ' of 1000 cited ids do not resolve' END) AS note FROM v LEFT JOIN g a ON a.case_name = v.case_name AND a.kind = 'graph' LEFT JOIN g b ON b.case_name = v.case_name AND b.kind = 'synthesis'"
)


@query("A28_provenance_note", _NOTE)
def a28(t: Tables):
    """Per case the note on its sections (by ordinal) of three or more paragraphs: those that mostly cite ids, and the others."""
    return K.provenance_notes(citing(t).select("case_name", (F.col("rel_ord") + 1).alias("no"), "cited", "valid"), "case_name")


@query("W01_top_claims", _CEN + "SELECT id, round(c, 2) AS centrality, relation_count FROM ce ORDER BY c DESC, ord, id LIMIT 20")
def w01(t: Tables):
    return centrality(t).orderBy(F.desc("centrality"), "ord", "id").limit(C.DEFAULT.max_ranked).select("id", F.round("centrality", 2).alias("centrality"), "relation_count")


@query("W02_top_per_subfield", "SELECT id, subfield, ((k - 1) // 25)::BIGINT AS batch, k::BIGINT AS k FROM (SELECT *, row_number() OVER (PARTITION BY subfield ORDER BY evidential_weight DESC, ord, id) AS k, count(*) OVER (PARTITION BY subfield) AS n FROM (SELECT id, ord, evidential_weight, coalesce(nullif(trim(subfield), ''), '_general') AS subfield FROM {nd} WHERE type = 'claim' AND evidential_weight >= 0.6)) WHERE k <= 50 AND n >= 2")
def w02(t: Tables):
    c = t.nd("type", "ord", "evidential_weight", "subfield").where(F.col("evidential_weight") >= C.DEFAULT.relate_weight).where("type = 'claim'").select("id", "ord", "evidential_weight", F.coalesce(F.nullif(F.trim("subfield"), F.lit("")), F.lit("_general")).alias("subfield"))
    top = c.withColumn("k", F.row_number().over(Window.partitionBy("subfield").orderBy(F.desc("evidential_weight"), "ord", "id"))).where(F.col("k") <= C.DEFAULT.relate_cap)
    pairs = top.groupBy("subfield").agg(F.max("k").alias("n")).where("n >= 2").select("subfield")
    return top.join(pairs, "subfield", "left_semi").select("id", "subfield", F.floor((F.col("k") - 1) / C.DEFAULT.relate_batch).alias("batch"), F.col("k").cast("bigint").alias("k"))


@query("W03_top_per_theme", "SELECT theme, id, k::BIGINT AS k FROM (SELECT theme, id, row_number() OVER (PARTITION BY theme ORDER BY CASE WHEN needs THEN 0 ELSE 1 END, id) AS k FROM {th}) WHERE k <= 3")
def w03(t: Tables):
    k = F.row_number().over(Window.partitionBy("theme").orderBy(F.when(F.col("needs"), 0).otherwise(1), "id"))
    return relations.themes(t).withColumn("k", k).where("k <= 3").select("theme", "id", F.col("k").cast("bigint").alias("k"))


@query("W04_top_themes", "SELECT 'theme_' || lpad(CAST(k - 1 AS VARCHAR), 2, '0') AS theme_id, theme, n FROM (SELECT theme, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, theme) AS k FROM {th} GROUP BY 1) WHERE k <= 40")
def w04(t: Tables):
    top = relations.themes(t).groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(C.DEFAULT.max_themes)
    k = F.row_number().over(Window.orderBy(F.desc("n"), "theme"))  # at most max_themes rows
    return top.select(F.format_string("theme_%02d", k - 1).alias("theme_id"), "theme", "n")


_PARAS = "WITH p AS (SELECT capture_id, trim(x, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS p, i FROM (SELECT capture_id, unnest(string_split(body, chr(10) || chr(10))) AS x, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS i FROM {bd})), q AS (SELECT * FROM p WHERE p <> '') "


def paragraphs(t: Tables):
    p = t.bd.select("capture_id", F.posexplode(F.split("body", "\n\n")).alias("i", "p"))
    return p.select("capture_id", (F.col("i") + 1).cast("bigint").alias("i"), F.btrim("p", F.lit(" \t\n\f\r")).alias("p")).where("p <> ''")


@query("W05_prior_context", _PARAS + "SELECT capture_id, i, length(right(lag(p) OVER (PARTITION BY capture_id ORDER BY i), 250)) AS context_chars FROM q")
def w05(t: Tables):
    before = F.lag("p").over(Window.partitionBy("capture_id").orderBy("i"))
    return paragraphs(t).select("capture_id", "i", F.length(F.right(before, F.lit(C.DEFAULT.context_chars))).cast("bigint").alias("context_chars"))


@query("W06_carried_sections", _PARAS + rf", s AS (SELECT *, CASE WHEN regexp_matches(p, '{filters._SEC}') THEN p END AS head FROM q), c AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'Body') AS section FROM s) SELECT capture_id, section, count(*) AS n FROM c WHERE head IS NULL GROUP BY 1, 2")
def w06(t: Tables):
    w = Window.partitionBy("capture_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = paragraphs(t).withColumn("head", F.when(X.is_section(F.col("p")), F.col("p"))).withColumn("section", F.coalesce(F.last("head", True).over(w), F.lit("Body")))
    return s.where("head IS NULL").groupBy("capture_id", "section").agg(F.count("*").alias("n"))


_UNC = "u AS (SELECT q, edge_count FROM {pp} WHERE status = 'contested' AND n_sources >= 2 AND q NOT IN (SELECT q FROM {bm} WHERE q IS NOT NULL AND j >= 0.1)), m AS (SELECT sum(edge_count) AS m FROM {pp} WHERE status = 'contested' AND n_sources >= 2)"


@query("W07_running_share", "WITH " + _UNC + " SELECT q, edge_count, round(edge_count::DOUBLE / m, 4) AS share, round(sum(edge_count) OVER (ORDER BY edge_count DESC, q ROWS UNBOUNDED PRECEDING)::DOUBLE / m, 4) AS running FROM u, m")
def w07(t: Tables):
    """Running sums by offset: rows are first added up per edge count (few values), so the global order needs no single task
    over all rows; within one edge count the share of a row is its rank times the count."""
    d = K.disputes(props(t), joins.matches(t), C.DEFAULT.jaccard_floor)
    total = d.agg(F.sum("edge_count")).scalar()
    u = d.where("NOT covered")
    step = u.groupBy("edge_count").agg(F.sum("edge_count").alias("s"))
    before = step.select("edge_count", F.coalesce(F.sum("s").over(Window.orderBy(F.desc("edge_count")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("edge_count").orderBy("q"))
    rows = u.join(before, "edge_count").withColumn("run", F.col("before") + F.col("edge_count") * rank).withColumn("m", total)
    return rows.select("q", "edge_count", F.round(F.col("edge_count") / F.col("m"), 4).alias("share"), F.round(F.col("run") / F.col("m"), 4).alias("running"))


@query("W08_review_targets", joins._SETTLED + "SELECT id, n_sources, w FROM s WHERE n_sources > 1 AND id NOT IN (SELECT id FROM k) ORDER BY n_sources DESC, w DESC, id LIMIT 8")
def w08(t: Tables):
    return joins.settled(t).orderBy(F.desc("n_sources"), F.desc("w"), "id").limit(8)


@query("W09_ranges", "WITH n AS (SELECT DISTINCT source_id AS g, att_ord + 1 AS n FROM attestations WHERE source_id IS NOT NULL), i AS (SELECT g, n, n - row_number() OVER (PARTITION BY g ORDER BY n) AS k FROM n), r AS (SELECT g, min(n) AS lo, max(n) AS hi FROM i GROUP BY g, k) SELECT g AS source_id, string_agg(CASE WHEN lo = hi THEN '§' || lo ELSE '§' || lo || '–§' || hi END, ', ' ORDER BY lo) AS ranges FROM r GROUP BY 1")
def w09(t: Tables):
    return K.ranges(t.attestations.where("source_id IS NOT NULL").select("source_id", (F.col("att_ord") + 1).alias("n")), "source_id", "n")


@query("W10_batches", "SELECT theme, ((row_number() OVER (ORDER BY theme) - 1) // 6)::BIGINT AS batch FROM (SELECT DISTINCT theme FROM {th})")
def w10(t: Tables):
    p = K.positions(relations.themes(t).select("theme").distinct(), [F.col("theme")], "w10")
    return p.select("theme", F.floor((F.col("pos") - 1) / C.DEFAULT.structure_batch).alias("batch"))


@query("W11_budgeted_corpus", "WITH b AS (SELECT source_id, capture_id, least(length(body), 40000) AS n FROM {bd}), r AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY source_id ORDER BY capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT source_id, capture_id, greatest(0, least(n, 100000 - before))::BIGINT AS kept FROM r")
def w11(t: Tables):
    b = t.bd.select("source_id", "capture_id", F.least(F.length("body"), F.lit(40_000)).cast("bigint").alias("n"))
    return K.running_budget(b, "source_id", ["capture_id"], "n", 100_000).select("source_id", "capture_id", F.col("kept").cast("bigint").alias("kept"))


@query("W12_review_sample")
def w12(t: Tables):
    return t.ge.where("type = 'contradicts'").select("src", "dst", "strength").orderBy(F.xxhash64("src", "dst", F.lit(42)), "src", "dst").limit(30)


@query("O01_pair_order", f"SELECT a, b, sim, row_number() OVER (ORDER BY sim DESC, a DESC, b DESC) AS pos FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(coalesce(strength, 0)) AS sim FROM {{rl}} JOIN {joins._SAME} s ON s.a = least(src, dst) AND s.b = greatest(src, dst) WHERE type = 'same_as' GROUP BY 1, 2)")
def o01(t: Tables):
    st = t.rl.where("type = 'same_as'").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.coalesce("strength", F.lit(0.0))).alias("sim"))
    return K.positions(joins.same_pairs(t).join(st, ["a", "b"]), [F.desc("sim"), F.desc("a"), F.desc("b")], "o01")


@query("O02_clusters_by_size", "SELECT crux, n, row_number() OVER (ORDER BY n DESC, crux) AS pos FROM (SELECT crux, count(*) AS n FROM {cx} GROUP BY 1)")
def o02(t: Tables):
    return K.positions(relations.crux_claims(t).groupBy("crux").agg(F.count("*").alias("n")), [F.desc("n"), F.col("crux")], "o02")


@query("O03_question_order", "SELECT q, n, row_number() OVER (ORDER BY n DESC, q) AS pos FROM (SELECT DISTINCT q, length(q) AS n FROM {qe})")
def o03(t: Tables):
    return K.positions(K.question_edges(t.ge).select("q").distinct().select("q", F.length("q").cast("bigint").alias("n")), [F.desc("n"), F.col("q")], "o03")


@query("O04_sources_by_risk", _IMP + "SELECT source_id, epistemic_risk, crux_claims_count, row_number() OVER (ORDER BY epistemic_risk DESC, crux_claims_count DESC, source_id) AS pos FROM im")
def o04(t: Tables):
    return K.positions(importance(t).select("source_id", "epistemic_risk", "crux_claims_count"), [F.desc("epistemic_risk"), F.desc("crux_claims_count"), F.col("source_id")], "o04")


@query("O05_sources_by_tier", _IMP + "SELECT source_id, importance_tier, epistemic_risk, row_number() OVER (ORDER BY CASE importance_tier WHEN 'central' THEN 0 WHEN 'latent_gem' THEN 1 WHEN 'contributory' THEN 2 ELSE 3 END, epistemic_risk DESC, source_id) AS pos FROM im")
def o05(t: Tables):
    tier = F.array_position(F.array(*[F.lit(x) for x in ("central", "latent_gem", "contributory", "peripheral")]), F.col("importance_tier"))
    rows = importance(t).select("source_id", "importance_tier", "epistemic_risk", tier.alias("tier"))
    return K.positions(rows, [F.col("tier"), F.desc("epistemic_risk"), F.col("source_id")], "o05").drop("tier")


@query("O06_cruxes_by_criticality", "WITH ti AS (SELECT theme, bool_or(needs) AS needs FROM {th} GROUP BY 1) SELECT crux, criticality, row_number() OVER (ORDER BY criticality DESC, crux) AS pos FROM (SELECT crux, sum(CASE WHEN needs THEN 4 ELSE 1 END)::BIGINT AS criticality FROM {ct} c JOIN ti ON ti.theme = c.theme GROUP BY 1)")
def o06(t: Tables):
    return K.positions(a22(t), [F.desc("criticality"), F.col("crux")], "o06")


@query("O07_compression_groups", f"SELECT cluster_id, member_count, row_number() OVER (ORDER BY member_count DESC, cluster_id) AS pos FROM (SELECT canonical AS cluster_id, count(*) + 1 AS member_count FROM {joins._CANON} GROUP BY 1)")
def o07(t: Tables):
    groups = joins.star_map(t).groupBy(F.col("canonical").alias("cluster_id")).agg((F.count("*") + 1).alias("member_count"))
    return K.positions(groups, [F.desc("member_count"), F.col("cluster_id")], "o07")


@query("O08_first_contradictions", "SELECT src, dst, strength FROM {ge} WHERE type = 'contradicts' ORDER BY src, dst LIMIT 30")
def o08(t: Tables):
    return t.ge.where("type = 'contradicts'").select("src", "dst", "strength").orderBy("src", "dst").limit(30)


@query("O09_case_summary", "SELECT case_name, count(*) AS nodes, count(*) FILTER (WHERE type = 'claim') AS claims, count(DISTINCT source_id) AS sources, round(avg(evidential_weight), 6) AS mean_weight FROM {nd} GROUP BY 1")
def o09(t: Tables):
    return t.nd("case_name", "type", "source_id", "evidential_weight").groupBy("case_name").agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "claim").alias("claims"), F.count_distinct("source_id").alias("sources"), F.round(F.avg("evidential_weight"), 6).alias("mean_weight"))


@query("O09_theme_view", "SELECT theme, count(*) AS member_count, bool_or(needs) AS needs_review, string_agg(id, ',' ORDER BY id) FILTER (WHERE k <= 10) AS members FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY id) AS k FROM {th}) GROUP BY 1")
def o09_themes(t: Tables):
    """Themes with their first ten members."""
    k = F.row_number().over(Window.partitionBy("theme").orderBy("id"))
    m = relations.themes(t).withColumn("k", k)
    first = m.where("k <= 10").groupBy("theme").agg(K.listed(F.col("id")).alias("members"))
    return m.groupBy("theme").agg(F.count("*").alias("member_count"), F.bool_or("needs").alias("needs_review")).join(first, "theme")


@query("O09_crux_view", "SELECT c.crux, c.claim_id, left(n.content, 80) AS head FROM {cx} c JOIN {nd} n ON n.id = c.claim_id")
def o09_cruxes(t: Tables):
    return relations.crux_claims(t).join(t.nd("content").withColumnRenamed("id", "claim_id"), "claim_id").select("crux", "claim_id", F.substring("content", 1, 80).alias("head"))


@query("O09_list_view", "SELECT 'gaps' AS what, id, left(coalesce(content, ''), 80) AS head FROM {nd} WHERE type = 'gap' UNION ALL SELECT 'chains', chain, left(coalesce(n.content, ''), 80) FROM (SELECT DISTINCT chain FROM " + joins._CH + ") c JOIN {nd} n ON n.id = c.chain")
def o09_list(t: Tables):
    head = F.substring(F.coalesce("content", F.lit("")), 1, 80).alias("head")
    gaps = t.nd("type", "content").where("type = 'gap'").select(F.lit("gaps").alias("what"), "id", head)
    chains = relations.chain_claims(t).select(F.col("chain").alias("id")).distinct().join(t.nd("content"), "id").select(F.lit("chains").alias("what"), "id", head)
    return gaps.unionByName(chains)


@query("O09_debate_view", joins._STATE_ROWS + ", m AS (SELECT node_id AS id, count(DISTINCT sk) AS n_sources FROM {ak} GROUP BY 1) SELECT s.id, CASE WHEN coalesce(m.n_sources, 0) > 1 THEN m.n_sources || ' sources' WHEN n_attestations > 1 THEN n_attestations || ' quotes, 1 source' ELSE '' END AS origin, len(list_filter(string_split(contradicted_by, ','), lambda x: x <> ''))::BIGINT AS n_contradictions FROM st s LEFT JOIN m ON m.id = s.id ORDER BY s.id LIMIT 15")
def o09_debate(t: Tables):
    """The first fifteen debate nodes with their flags."""
    m = t.ak.groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("sk").alias("n_sources"))
    s = joins.j08(t).join(m, "id", "left")
    text = F.when(F.coalesce("n_sources", F.lit(0)) > 1, F.concat(F.col("n_sources").cast("string"), F.lit(" sources"))).when(F.col("n_attestations") > 1, F.concat(F.col("n_attestations").cast("string"), F.lit(" quotes, 1 source"))).otherwise("")
    return s.select("id", text.alias("origin"), F.size(F.filter(F.split("contradicted_by", ","), lambda x: x != "")).cast("bigint").alias("n_contradictions")).orderBy("id").limit(15)


@query("O09_hypothesis_view", filters._PARAM + "SELECT n.key_question AS crux, count(*) AS parameters, count(*) FILTER (WHERE r.new = 'ungrounded') AS ungrounded FROM r JOIN {nd} n ON n.id = r.node_id WHERE coalesce(trim(n.key_question), '') <> '' GROUP BY 1")
def o09_hypotheses(t: Tables):
    p = filters.parameters(t).join(t.nd("key_question").withColumnRenamed("id", "node_id"), "node_id").where("coalesce(trim(key_question), '') <> ''")
    return p.groupBy(F.col("key_question").alias("crux")).agg(F.count("*").alias("parameters"), F.count_if(F.col("grounding") == "ungrounded").alias("ungrounded"))
