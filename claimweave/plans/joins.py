"""J and U: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.functions import text as X
from claimweave.operators import compile as K
from claimweave.operators import graph as G
from claimweave.operators import grounding as GR
from claimweave.operators import reconcile as Q
from claimweave.operators import similarity as M
from claimweave.plans import filters, relations
from claimweave.plans.registry import Tables, query
from claimweave.runtime import bounded, stash

_SAME = "(SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {rl} WHERE type = 'same_as' AND src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"


def _sets(pairs: str) -> str:
    """Common table expressions up to f: the pairs (a, b) with their source flags."""
    return (
        "WITH s AS (SELECT node_id AS id, list_sort(list(DISTINCT sk)) AS ss FROM {ak} WHERE sk IS NOT NULL GROUP BY 1), na AS (SELECT node_id AS id, list_sort(list(DISTINCT nullif(lower(trim(author)), ''))) AS au FROM {ak} WHERE coalesce(trim(author), '') <> '' GROUP BY 1), "
        "au AS (SELECT * FROM na UNION ALL SELECT id, [lower(trim(source_author))] FROM {nd} WHERE coalesce(trim(source_author), '') <> '' AND id NOT IN (SELECT id FROM na)), "
        f"p AS (SELECT a, b FROM {pairs}), f AS (SELECT p.a, p.b, coalesce(len(x.ss) > 0 AND len(y.ss) > 0 AND NOT list_has_any(x.ss, y.ss), false) AS cross_paper, coalesce(list_has_any(x.ss, y.ss), false) AS same_document, coalesce(u.au = v.au, false) AS same_author "
        "FROM p LEFT JOIN s x ON x.id = p.a LEFT JOIN s y ON y.id = p.b LEFT JOIN au u ON u.id = p.a LEFT JOIN au v ON v.id = p.b) "
    )


def _w4(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z]{{4,}}'))"


_SIDE = "attributed_to_ok AND NOT rhet"
_VEC = (
    f"tv AS (SELECT id, type, unnest({_w4('content')}) AS w, len({_w4('content')}) AS n, coalesce(nullif(attributed_to, ''), 'source_author') = 'source_author' AS attributed_to_ok, lower(trim(coalesce(claim_type, ''))) IN ('dismissal', 'rhetorical', 'ad_hominem', 'credibility_attack', 'straw_man') OR (lower(trim(type)) = 'rebuttal' AND lower(trim(coalesce(claim_type, ''))) IN ('', 'unknown', 'interpretive')) AS rhet FROM {{nd}} WHERE content IS NOT NULL), "
)


def _band(low: float, high: float, side: str) -> str:
    pairs = f"pv AS (SELECT x.id AS a, y.id AS b, round(count(*)::DOUBLE / sqrt(any_value(x.n) * any_value(y.n)), 9) AS sim FROM (SELECT * FROM tv WHERE {side}) x JOIN (SELECT * FROM tv WHERE {side}) y ON y.w = x.w AND y.type = x.type AND x.id < y.id GROUP BY 1, 2 HAVING count(*)::DOUBLE / sqrt(any_value(x.n) * any_value(y.n)) >= {low} - 1e-9) "
    flags = _sets("pv")[5:]
    return f"WITH {_VEC}{pairs}, {flags} SELECT pv.a, pv.b, round(pv.sim, 6) AS sim FROM pv JOIN f ON f.a = pv.a AND f.b = pv.b WHERE f.cross_paper AND pv.sim BETWEEN {low} AND {high}"


def cross_paper_band(t: Tables, nodes, low: float, high: float, label: str):
    """(a, b, sim), a < b: records of one type and of different sources whose word sets have a cosine within the band.

    nodes are deliveries, which become hashes of words before they are sent, once, to where both an id's copies and its sources
    are. Words carry the type of their record, so that only records of one type meet. Records carry their source keys, of which
    there are no more than sources, so that pairs with a common one are dropped where they are found.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]{4,})"), 1))
    rows = nodes.where("content IS NOT NULL AND id IS NOT NULL AND type IS NOT NULL").select("id", F.col("type").alias("kind"), F.transform(words, lambda w: F.xxhash64("type", w)).alias("tokens")).repartition("id").distinct()
    sources = t.ak.where("sk IS NOT NULL").groupBy(F.col("node_id").alias("id")).agg(F.collect_set(F.xxhash64("sk")).alias("tags"))
    near = M.like_pairs(rows.join(sources, "id"), low, cosine=True, apart=True, label=label)
    return near.select("a", "b", F.round("likeness", 9).alias("sim")).where(F.col("sim").between(low, high)).select("a", "b", F.round("sim", 6).alias("sim"))


@query("J01_merge_band", _band(C.DEFAULT.merge_low, C.DEFAULT.merge_high, "true"))
def j01(t: Tables):
    return cross_paper_band(t, t.nodes, C.DEFAULT.merge_low, C.DEFAULT.merge_high, "j01")


@query("J02_contradiction_band", _band(C.DEFAULT.contradiction_low, C.DEFAULT.merge_high, _SIDE))
def j02(t: Tables):
    """Rhetorical moves and what is not the author's own are left out before the pairs are made."""
    n = t.nodes.where(~filters.rhetorical() & (F.coalesce(F.nullif("attributed_to", F.lit("")), F.lit("source_author")) == "source_author"))
    return cross_paper_band(t, n, C.DEFAULT.contradiction_low, C.DEFAULT.merge_high, "j02")


_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


_SETS = _sets(_SAME)


def same_pairs(t: Tables):
    ids = t.nodes.select("id").distinct()
    e = t.rl.where("type = 'same_as'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return G.undirected(e)


def flagged_pairs(t: Tables):
    return Q.cross_source_pairs(same_pairs(t), t.attestations, t.nd("source_author"))


@query("J03_pair_sources", _SETS + "SELECT * FROM f")
def j03(t: Tables):
    return flagged_pairs(t)


_CONF = "(SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {ge} WHERE type IN ('contradicts', 'undermines'))"


@query("J04_without_conflicts", f"SELECT a, b FROM {_SAME} p WHERE NOT EXISTS (SELECT 1 FROM {_CONF} c WHERE c.a = p.a AND c.b = p.b)")
def j04(t: Tables):
    return G.without_conflicts(same_pairs(t), G.conflict_pairs(t.ge))


@query("J05_attested_nodes", "SELECT a.node_id, n.type, count(*) AS n FROM attestations a JOIN {nd} n ON n.id = a.node_id GROUP BY 1, 2")
def j05(t: Tables):
    return t.attestations.select("node_id").join(t.nd("type").withColumnRenamed("id", "node_id"), "node_id").groupBy("node_id", "type").agg(F.count("*").alias("n"))


@query("J06_neighbours", "SELECT e.src, e.dst, n.type AS dst_type FROM {ge} e JOIN {nd} n ON n.id = e.dst WHERE e.type = 'supports'")
def j06(t: Tables):
    return t.ge.where("type = 'supports'").join(t.nd("type").select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst").select("src", "dst", "dst_type")


@query("J07_incoming", "SELECT dst AS id, type, count(*) AS n FROM {ge} GROUP BY 1, 2")
def j07(t: Tables):
    return t.ge.groupBy(F.col("dst").alias("id"), "type").agg(F.count("*").alias("n"))


_KINDS = {"contradicts": "contradicted_by", "supports": "supported_by", "undermines": "undermined_by", "requires": "requires_true", "explains": "explained_by"}
_ROLES = ", ".join(f"string_agg(DISTINCT dst, ',' ORDER BY dst) FILTER (WHERE type = '{k}') AS {v}" for k, v in _KINDS.items())
_STATE_ROWS = (
    f"WITH o AS (SELECT src AS id, {_ROLES} FROM {{rl}} GROUP BY 1), w AS (SELECT dst AS id, string_agg(DISTINCT src, ',' ORDER BY src) AS falls FROM {{rl}} WHERE type = 'requires' GROUP BY 1), c AS (SELECT node_id AS id, count(*) AS n FROM attestations GROUP BY 1), "
    "sx AS (SELECT n.id, " + ", ".join(f"coalesce({v}, '') AS {v}" for v in _KINDS.values()) + ", coalesce(w.falls, '') AS if_false_then_falls, coalesce(c.n, 0) AS n_attestations FROM {nd} n LEFT JOIN o ON o.id = n.id LEFT JOIN w ON w.id = n.id LEFT JOIN c ON c.id = n.id WHERE n.type IN ('claim', 'evidence', 'question')), "
    "st AS (SELECT * FROM sx WHERE contradicted_by || supported_by || undermined_by || requires_true || explained_by || if_false_then_falls <> '' OR n_attestations > 1)"
)


@query("J08_debate_state", _STATE_ROWS + " SELECT * FROM st")
def j08(t: Tables):
    return K.debate_state(t.nd("type"), t.rl, t.attestations)


_CH = "(SELECT DISTINCT dst AS chain, src AS claim_id FROM {ge} WHERE type = 'depends_on')"


@query("J09_crux_chains", f"SELECT DISTINCT x.crux, c.chain FROM {{cx}} x JOIN {_CH} c ON c.claim_id = x.claim_id UNION SELECT DISTINCT x.crux, c.chain FROM {{cx}} x JOIN {_CH} c ON c.chain = x.claim_id")
def j09(t: Tables):
    """Any overlap as a union of equi-joins: a shared claim, or a crux claim that the chain ends in."""
    x, c = relations.crux_claims(t), relations.chain_claims(t)
    by_end = x.join(c.select(F.col("chain").alias("claim_id"), "chain"), "claim_id")
    return x.join(c, "claim_id").select("crux", "chain").union(by_end.select("crux", "chain")).distinct()


@query("J10_theme_cruxes", "SELECT theme, count(*) AS n_cruxes, string_agg(crux, '|' ORDER BY crux) AS cruxes FROM {ct} GROUP BY 1")
def j10(t: Tables):
    """The inverted index: each theme with its cruxes in order, as many as it has."""
    return relations.crux_themes(t).groupBy("theme").agg(F.count("*").alias("n_cruxes"), F.array_join(F.array_sort(F.collect_set("crux")), "|").alias("cruxes"))


def matches(t: Tables):
    return K.best_matches(relations.crux_claims(t), K.proposition_claims(K.question_edges(t.ge)))


@query("J11_best_matches", "SELECT crux, q, coalesce(j, 0)::DOUBLE AS jaccard, coalesce(shared, 0) AS shared FROM {bm}")
def j11(t: Tables):
    return matches(t)


def _stops(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TOK = lambda c, stop: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z]{{{{4,}}}}')), lambda w: NOT list_contains({_stops(stop)}, w))"


def _tok(c: str, stop=C.STOP_WORDS) -> str:
    return _TOK(c, stop).replace("{{", "{").replace("}}", "}")


_NEAR = (
    f"WITH g AS (SELECT id, unnest({_tok('content')}) AS w FROM (SELECT DISTINCT id, content FROM nodes WHERE type = 'gap')), gn AS (SELECT id, count(*) AS n FROM g GROUP BY 1), "
    f"x AS (SELECT crux, unnest({_tok('crux')}) AS w FROM (SELECT DISTINCT crux FROM {{cx}})), xn AS (SELECT crux, count(*) AS n FROM x GROUP BY 1), "
    "m AS (SELECT x.crux, g.id, count(*) AS k FROM x JOIN g ON g.w = x.w GROUP BY 1, 2), s AS (SELECT m.crux, m.id, round(k::DOUBLE / (xn.n + gn.n - k), 9) AS sim FROM m JOIN xn ON xn.crux = m.crux JOIN gn ON gn.id = m.id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY crux ORDER BY sim DESC, id) AS k FROM s) "
)


def crux_gaps(t: Tables):
    """(crux, id, sim, k): gaps that share a word with a crux, ranked by lexical overlap.

    Words meet by equi-join and are counted, so no pair without a shared word is ever made; ranks beyond 4 are dropped before
    the shuffle.
    """
    from pyspark.sql import Window

    g = t.nodes.where("type = 'gap'").select("id", "content").distinct().select("id", F.explode(X.token_set(F.col("content"), C.STOP_WORDS)).alias("w"))
    x = relations.crux_claims(t).select("crux").distinct().select("crux", F.explode(X.token_set(F.col("crux"), C.STOP_WORDS)).alias("w"))
    gn, xn = g.groupBy("id").agg(F.count("*").alias("gn")), x.groupBy("crux").agg(F.count("*").alias("xn"))
    met = x.join(g, "w").groupBy("crux", "id").agg(F.count("*").alias("n")).join(xn, "crux").join(gn, "id")
    sims = met.select("crux", "id", F.round(F.col("n") / (F.col("xn") + F.col("gn") - F.col("n")), 9).alias("sim"))
    return sims.withColumn("k", F.row_number().over(Window.partitionBy("crux").orderBy(F.desc("sim"), "id"))).where("k <= 4")


@query("J12_nearest_gap", _NEAR + "SELECT crux, id AS gap_id, round(sim, 6) AS sim FROM r WHERE k = 1 AND sim >= 0.06")
def j12(t: Tables):
    return crux_gaps(t).where((F.col("k") == 1) & (F.col("sim") >= C.DEFAULT.orphan_lexical)).select("crux", F.col("id").alias("gap_id"), F.round("sim", 6).alias("sim"))


_ORPHAN = (
    f"WITH o AS (SELECT src, dst, max(coalesce(nullif(trim(shared_question), ''), rationale, '')) AS hint FROM {{rl}} WHERE src <> dst AND dst NOT IN (SELECT id FROM nodes) AND src IN (SELECT id FROM nodes) GROUP BY 1, 2), ow AS (SELECT src, dst, unnest({_tok('hint')}) AS w FROM o), os AS (SELECT src, dst, count(*) AS n FROM ow GROUP BY 1, 2), "
    f"cw AS (SELECT id, unnest({_tok('content')}) AS w FROM {{nd}} WHERE type = 'claim' AND content IS NOT NULL), cn AS (SELECT id, count(*) AS n FROM cw GROUP BY 1), "
    "om AS (SELECT src, dst, id, count(*) AS k FROM ow JOIN cw ON cw.w = ow.w GROUP BY 1, 2, 3), osim AS (SELECT om.src, om.dst, om.id, round(k::DOUBLE / (os.n + cn.n - k), 9) AS sim FROM om JOIN os ON os.src = om.src AND os.dst = om.dst JOIN cn ON cn.id = om.id), "
    "fix AS (SELECT src, dst, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY sim DESC, id) AS k FROM osim) WHERE k = 1 AND sim >= 0.06) "
)


def repaired(t: Tables):
    """(src, dst, id, sim): references to ids no node carries, with the claim nearest to the reference's question or rationale."""
    o = t.rl.where("src <> dst").join(t.nd().withColumnRenamed("id", "dst"), "dst", "left_anti").join(t.nd().withColumnRenamed("id", "src"), "src", "left_semi")
    hint = F.coalesce(F.nullif(F.trim("shared_question"), F.lit("")), "rationale", F.lit(""))
    hints = o.groupBy("src", "dst").agg(F.max(hint).alias("hint")).select("src", "dst", X.token_set(F.col("hint"), C.STOP_WORDS).alias("tokens"))
    claims = t.nd("type", "content").where("type = 'claim' AND content IS NOT NULL").select("id", X.token_set(F.col("content"), C.STOP_WORDS).alias("tokens"))
    return K.nearest(hints, ["src", "dst"], claims, C.DEFAULT.orphan_lexical)


@query("J12_repaired_orphans", _ORPHAN + "SELECT src, dst, id, round(sim, 6) AS sim FROM fix")
def j12_orphans(t: Tables):
    return repaired(t).select("src", "dst", "id", F.round("sim", 6).alias("sim"))


@query("J13_repaired_references", _ORPHAN + "SELECT DISTINCT e.src, coalesce(n.id, fix.id) AS dst, e.type FROM {rl} e LEFT JOIN {nd} n ON n.id = e.dst LEFT JOIN fix ON fix.src = e.src AND fix.dst = e.dst WHERE e.src <> e.dst AND e.src IN (SELECT id FROM nodes) AND coalesce(n.id, fix.id) IS NOT NULL AND coalesce(n.id, fix.id) <> e.src")
def j13(t: Tables):
    """Every reference kept where its target exists, moved to the nearest claim where it does not, dropped where nothing is near;
    once each."""
    ids = t.nd()
    e = t.rl.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "type")
    sound = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    moved = e.join(repaired(t), ["src", "dst"]).select("src", F.col("id").alias("dst"), "type")
    return sound.select("src", "dst", "type").unionByName(moved).where("src <> dst").distinct()


@query("J14_linked_gaps", _NEAR + "SELECT crux, id AS gap_id, CAST(k AS BIGINT) AS k FROM r WHERE (k <= 4 AND sim >= 0.06) OR (k <= 3 AND crux NOT IN (SELECT crux FROM r WHERE sim >= 0.06))")
def j14(t: Tables):
    g = crux_gaps(t)
    good = g.where(F.col("sim") >= C.DEFAULT.orphan_lexical)
    rest = g.where("k <= 3").join(good.select("crux").distinct(), "crux", "left_anti")
    return good.unionByName(rest).select("crux", F.col("id").alias("gap_id"), F.col("k").cast("bigint").alias("k"))


@query("J15_theme_claims", "SELECT theme, claim_id, CAST(k AS BIGINT) AS k FROM (SELECT theme, claim_id, row_number() OVER (PARTITION BY theme ORDER BY ord, claim_id) AS k FROM (SELECT DISTINCT th.theme, n.id AS claim_id, n.ord FROM {th} th JOIN {ge} e ON e.dst = th.id AND e.type = 'presupposes' JOIN {nd} n ON n.id = e.src AND n.type = 'claim')) WHERE k <= 15")
def j15(t: Tables):
    from pyspark.sql import Window

    e = t.ge.where("type = 'presupposes'").select(F.col("src").alias("claim_id"), F.col("dst").alias("id"))
    claims = t.nd("type", "ord").where("type = 'claim'").select(F.col("id").alias("claim_id"), "ord")
    rows = relations.themes(t).join(e, "id").join(claims, "claim_id").select("theme", "claim_id", "ord").distinct()
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("theme").orderBy("ord", "claim_id"))).where("k <= 15").select("theme", "claim_id", F.col("k").cast("bigint").alias("k"))


@query(
    "J16_crux_evidence",
    _NEAR + ", c AS (SELECT crux, claim_id FROM (SELECT crux, claim_id, row_number() OVER (PARTITION BY crux ORDER BY claim_id) AS k FROM (SELECT DISTINCT crux, claim_id FROM {cx})) WHERE k <= 5), a AS (SELECT crux, dst, row_number() OVER (PARTITION BY crux ORDER BY dst) AS k FROM (SELECT DISTINCT c.crux, e.dst FROM {cx} c JOIN {ge} e ON e.src = c.claim_id AND e.type = 'contradicts')) SELECT crux, 'claim' AS kind, claim_id AS id FROM c UNION ALL SELECT crux, 'against', dst FROM a WHERE k <= 5 UNION ALL SELECT crux, 'gap', id FROM r WHERE k <= 4 AND sim >= 0.06",
)
def j16(t: Tables):
    """Per crux up to five claims, five distinct nodes that any of its claims contradicts, and four gaps near it."""
    from pyspark.sql import Window

    top = lambda df, key: df.withColumn("k", F.row_number().over(Window.partitionBy("crux").orderBy(key))).where("k <= 5").drop("k")
    claims = relations.crux_claims(t)
    a = top(claims.join(t.ge.where("type = 'contradicts'").select(F.col("src").alias("claim_id"), "dst"), "claim_id").select("crux", "dst").distinct(), "dst")
    gaps = crux_gaps(t).where(F.col("sim") >= C.DEFAULT.orphan_lexical).select("crux", F.lit("gap").alias("kind"), "id")
    return top(claims, "claim_id").select("crux", F.lit("claim").alias("kind"), F.col("claim_id").alias("id")).unionByName(a.select("crux", F.lit("against").alias("kind"), F.col("dst").alias("id"))).unionByName(gaps)


@query("J17_contradiction_pairs", "SELECT least(e.src, e.dst) AS a, greatest(e.src, e.dst) AS b, max(e.strength) AS strength FROM {ge} e JOIN {nd} n ON n.id = e.src AND n.type = 'claim' WHERE e.type = 'contradicts' GROUP BY 1, 2")
def j17(t: Tables):
    claims = t.nd("type").where("type = 'claim'").select(F.col("id").alias("src"))
    return t.ge.where("type = 'contradicts'").join(claims, "src", "left_semi").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("strength").alias("strength"))


@query("J18_active_contradictions", "SELECT e.src AS claim_a, e.dst AS claim_b, left(coalesce(a.content, ''), 200) AS content_a, left(coalesce(b.content, ''), 200) AS content_b, e.strength FROM {ge} e JOIN {nd} a ON a.id = e.src JOIN {nd} b ON b.id = e.dst WHERE e.type = 'contradicts' AND a.type IN ('claim', 'evidence', 'question')")
def j18(t: Tables):
    clip = lambda c: F.substring(F.coalesce("content", F.lit("")), 1, 200).alias(c)
    a = t.nd("type", "content").where("type IN ('claim', 'evidence', 'question')").select(F.col("id").alias("claim_a"), clip("content_a"))
    b = t.nd("content").select(F.col("id").alias("claim_b"), clip("content_b"))
    e = t.ge.where("type = 'contradicts'").select(F.col("src").alias("claim_a"), F.col("dst").alias("claim_b"), "strength")
    return e.join(a, "claim_a").join(b, "claim_b").select("claim_a", "claim_b", "content_a", "content_b", "strength")


_AUD = "(SELECT source_id, round(avg(CASE WHEN coalesce(trim(quote), '') <> '' THEN 1.0 ELSE 0.0 END), 3) AS score FROM attestations WHERE coalesce(trim(source_id), '') <> '' GROUP BY 1)"


def quote_scores(t: Tables):
    return t.attestations.where("coalesce(trim(source_id), '') <> ''").groupBy("source_id").agg(F.round(F.avg(F.when(F.coalesce(F.trim("quote"), F.lit("")) != "", 1.0).otherwise(0.0)), 3).alias("score"))


@query("J19_scored_attestations", f"SELECT a.node_id, count(*) AS n, round(avg(s.score), 6) AS mean_score FROM attestations a JOIN {_AUD} s ON s.source_id = a.source_id GROUP BY 1")
def j19(t: Tables):
    return t.attestations.select("node_id", "source_id").join(quote_scores(t), "source_id").groupBy("node_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


_IMPORT = (
    ", n AS (SELECT id, coalesce(evidential_weight, 0) AS w FROM {nd} WHERE type IN ('claim', 'evidence')), a2 AS (SELECT DISTINCT node_id AS id, sk FROM {ak} WHERE sk IS NOT NULL), s2 AS (SELECT id, count(*) = 1 AS sole FROM a2 GROUP BY 1), "
    "r2 AS (SELECT n.*, a2.sk, s2.sole, n.id IN (SELECT claim_id FROM {cx}) AS crux FROM n JOIN a2 ON a2.id = n.id JOIN s2 ON s2.id = n.id), im AS (SELECT sk AS source_id, round(2.0 * count(*) FILTER (WHERE sole AND w >= 0.7) + 3.0 * count(*) FILTER (WHERE crux AND sole) + 0.5 * count(*) FILTER (WHERE sole) + 0.25 * count(*) FILTER (WHERE crux), 2)::DOUBLE AS epistemic_risk FROM r2 GROUP BY 1) "
)


@query("J20_sources_with_audits", f"WITH au AS {_AUD}" + _IMPORT + "SELECT im.source_id, im.epistemic_risk, au.score, coalesce(nullif(s.role, ''), 'unknown') AS role FROM im LEFT JOIN au ON au.source_id = im.source_id LEFT JOIN {so} s ON s.source_id = im.source_id")
def j20(t: Tables):
    """Importance of each source with the score of its audit and its role, where there are any."""
    im = K.source_importance(t.nd("type", "evidential_weight"), t.ak, relations.crux_claims(t)).select("source_id", "epistemic_risk")
    roles = bounded(t.so.select("source_id", F.nullif("role", F.lit("")).alias("role")))
    return im.join(quote_scores(t), "source_id", "left").join(roles, "source_id", "left").select("source_id", "epistemic_risk", "score", F.coalesce("role", F.lit("unknown")).alias("role"))


_JUDGE = "CASE WHEN quote IS NULL THEN NULL WHEN trim(quote) = '' THEN 'ungrounded' ELSE g END"


@query(
    "J21_merged_verdicts",
    filters._PARAM + f", v AS (SELECT node_id, att_ord, g AS declared, max(new) AS det, max({_JUDGE}) AS said FROM r GROUP BY 1, 2, 3), m AS (SELECT *, CASE WHEN det = 'ungrounded' THEN det ELSE coalesce(said, declared) END AS final FROM v) SELECT DISTINCT node_id, att_ord, declared AS from_grounding, final AS to_grounding, CASE WHEN det = 'ungrounded' AND declared <> 'ungrounded' THEN 'rule' ELSE 'judge' END AS override_by FROM m WHERE declared <> final",
)
def j21(t: Tables):
    """Overrides of declared groundings, one per parameter, from and to: the judge's row is preferred where there is one (here it
    is read off the quote: none without one, ungrounded for a blank one), and the literal rule applies over it."""
    said = F.when(F.col("quote").isNull(), None).when(F.trim("quote") == "", "ungrounded").otherwise(F.col("declared"))
    return K.merged_verdicts(filters.parameters(t).withColumn("said", said), ["node_id", "att_ord"])


_GROUND = (
    filters._PROSE
    + f", pt AS (SELECT doc_id, no, k, unnest(t) AS w, len(t) AS n FROM (SELECT doc_id, no, row_number() OVER () AS k, {_tok('p', C.REPORT_STOP_WORDS)} AS t FROM c)), e AS (SELECT DISTINCT list_sort({_tok('textual_evidence', C.REPORT_STOP_WORDS)}) AS t FROM nodes WHERE textual_evidence IS NOT NULL), "
    "et AS (SELECT k, unnest(t) AS w, len(t) AS n FROM (SELECT t, row_number() OVER () AS k FROM e)), hit AS (SELECT DISTINCT pk FROM (SELECT pt.k AS pk, et.k AS ek, count(*) AS s, any_value(pt.n) AS pn, any_value(et.n) AS en FROM pt JOIN et ON et.w = pt.w AND et.n >= 0.18 * pt.n - 1e-9 AND pt.n >= 0.18 * et.n - 1e-9 GROUP BY 1, 2) WHERE s >= 0.18 * (pn + en - s) - 1e-9), "
    "gr AS (SELECT c.doc_id, c.no, coalesce(h.grounded, false) AS grounded FROM c LEFT JOIN (SELECT DISTINCT doc_id, no, true AS grounded FROM pt WHERE k IN (SELECT pk FROM hit)) h ON h.doc_id = c.doc_id AND h.no = c.no) "
)


@query("J22_grounded_paragraphs", _GROUND + "SELECT doc_id, no, grounded FROM gr")
def j22(t: Tables):
    """Document paragraphs against the evidence of nodes, lexically; the table has no vectors of evidence for the other side."""
    return GR.grounded_paragraphs(filters.prose(t.documents), t.nodes.where("textual_evidence IS NOT NULL").select(F.col("textual_evidence").alias("text")))


_VALID = "vi AS (SELECT id FROM {nd} UNION SELECT 'gap_' || id FROM {nd} WHERE type = 'gap' UNION SELECT 'claim_' || id FROM {nd} WHERE type = 'claim' UNION SELECT 'crux_' || substr(sha256(crux), 1, 8) FROM {cx} UNION SELECT 'chain_' || dst FROM {ge} WHERE type = 'depends_on')"


def valid_ids(t: Tables):
    """(cited): all ids a text may cite: nodes, gaps and claims with their prefixes, cruxes by a digest of their question, chains."""
    alias = lambda df, prefix, c: df.select(F.concat(F.lit(prefix), c).alias("cited"))
    n = t.nd("type")
    parts = [alias(n.where("type = 'gap'"), "gap_", F.col("id")), alias(n.where("type = 'claim'"), "claim_", F.col("id")), alias(relations.crux_claims(t), "crux_", F.substring(F.sha2("crux", 256), 1, 8)), alias(relations.chain_claims(t), "chain_", F.col("chain"))]
    out = n.select(F.col("id").alias("cited"))
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


@query(
    "J23_valid_citations",
    "WITH " + _VALID + ", c AS (SELECT DISTINCT src, CASE type WHEN 'depends_on' THEN 'chain_' WHEN 'supports' THEN 'claim_' WHEN 'qualifies' THEN 'gap_' ELSE '' END || dst AS cited FROM {rr}) SELECT c.src, count(*) AS cited, count(coalesce(v.id, w.id)) AS valid FROM c LEFT JOIN vi v ON v.id = c.cited LEFT JOIN {nd} w ON w.id = regexp_replace(c.cited, '^(gap_|claim_)', '') GROUP BY 1",
)
def j23(t: Tables):
    """Cited ids per node, and how many are valid as they stand or without the prefix of a gap or claim."""
    prefix = F.when(F.col("type") == "depends_on", "chain_").when(F.col("type") == "supports", "claim_").when(F.col("type") == "qualifies", "gap_").otherwise("")
    c = t.relations.select(F.lower(F.trim("src")).alias("src"), G.relation_type().alias("type"), F.lower(F.trim("dst")).alias("dst")).select("src", F.concat(prefix, "dst").alias("cited")).distinct()
    plain = t.nd().select(F.col("id").alias("bare"), F.lit(1).alias("ok2"))
    rows = c.join(valid_ids(t).withColumn("ok", F.lit(1)), "cited", "left").withColumn("bare", X.normal_id(F.col("cited"))).join(plain, "bare", "left")
    return rows.groupBy("src").agg(F.count("*").alias("cited"), F.count(F.coalesce("ok", "ok2")).alias("valid"))


@query(
    "J24_expanded",
    "WITH RECURSIVE s AS (SELECT id FROM {nd} WHERE type = 'question'), r(root, id, depth) AS (SELECT id, id, 0 FROM s UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN {ge} e ON e.src = r.id WHERE r.depth < 3) SELECT root, id, min(depth)::INT AS depth FROM r GROUP BY 1, 2",
)
def j24(t: Tables):
    return G.expand(t.nd("type").where("type = 'question'"), t.ge, 3)


_VERD = "CASE WHEN type = 'same_as' THEN 'same' WHEN type IN ('distinct', 'not_same') THEN 'distinct' WHEN type = 'quantitative_divergence' THEN 'quantitative_divergence' ELSE 'no_such_verdict' END"


@query("J25_judged_pairs", f"WITH v AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min({_VERD}) AS verdict FROM {{rl}} WHERE src <> dst AND type IN ('same_as', 'distinct', 'not_same', 'quantitative_divergence') GROUP BY 1, 2), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {{rl}} WHERE src <> dst) SELECT p.a, p.b, coalesce(v.verdict, 'distinct') AS verdict FROM p LEFT JOIN v ON v.a = p.a AND v.b = p.b")
def j25(t: Tables):
    return Q.judged(G.undirected(t.rl), recorded_verdicts(t))


def recorded_verdicts(t: Tables):
    """(x, y, verdict) of the reconcile step as recorded in relations."""
    kind = F.when(F.col("type") == "same_as", "same").when(F.col("type").isin("distinct", "not_same"), "distinct").when(F.col("type") == "quantitative_divergence", F.col("type"))
    return t.rl.where("src <> dst AND type IN ('same_as', 'distinct', 'not_same', 'quantitative_divergence')").select(F.col("src").alias("x"), F.col("dst").alias("y"), kind.alias("verdict"))


@query("U01_jaccard", f"WITH t AS (SELECT id, {_tok('content')} AS a, {_tok('textual_evidence')} AS b FROM {{nd}} WHERE content IS NOT NULL AND textual_evidence IS NOT NULL) SELECT id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS jaccard FROM t")
def u01(t: Tables):
    n = t.nd("content", "textual_evidence").where("content IS NOT NULL AND textual_evidence IS NOT NULL")
    return n.select("id", F.round(X.jaccard(X.token_set(F.col("content"), C.STOP_WORDS), X.token_set(F.col("textual_evidence"), C.STOP_WORDS)), 6).alias("jaccard"))


@query("U02_referenced_ids", f"SELECT claim_id AS id FROM {{cx}} UNION SELECT chain FROM {_CH} UNION SELECT id FROM {{th}} UNION SELECT claim_id FROM {{qc}}")
def u02(t: Tables):
    parts = [relations.crux_claims(t).select(F.col("claim_id").alias("id")), relations.chain_claims(t).select(F.col("chain").alias("id")), relations.themes(t).select("id"), K.proposition_claims(K.question_edges(t.ge)).select(F.col("claim_id").alias("id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("id <> ''").distinct()


_CANON = "(SELECT b AS id, min(a) AS canonical FROM " + _SAME + " GROUP BY 1)"


def star_map(t: Tables):
    return same_pairs(t).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("canonical"))


@query("U03_attestation_union", f"SELECT canonical, count(*) AS n FROM (SELECT DISTINCT coalesce(c.canonical, a.node_id) AS canonical, coalesce(trim(a.source_id), '') AS s, coalesce(trim(a.quote), '') AS q FROM attestations a LEFT JOIN {_CANON} c ON c.id = a.node_id) GROUP BY 1")
def u03(t: Tables):
    return G.attestation_union(t.attestations, star_map(t)).groupBy("canonical").agg(F.count("*").alias("n"))


@query("U04_relation_dedupe", "SELECT src, dst, type, rel_ord FROM {rl}")
def u04(t: Tables):
    return t.rl.select("src", "dst", "type", "rel_ord")


_NEWQ = "SELECT id AS node_id, coalesce(trim(source_id), '') AS s, coalesce(trim(textual_evidence), '') AS q FROM {nd} WHERE coalesce(trim(textual_evidence), '') <> ''"


@query("U05_appended_attestations", "WITH old AS (SELECT DISTINCT node_id, coalesce(trim(source_id), '') AS s, coalesce(trim(quote), '') AS q FROM attestations), new AS (SELECT * FROM (" + _NEWQ + ") EXCEPT SELECT * FROM old), u AS (SELECT *, false AS added FROM old UNION ALL SELECT *, true FROM new) SELECT node_id, count(*) AS n, count(*) FILTER (WHERE added) AS added, CASE WHEN count(*) > 1 THEN 'corroborated' ELSE 'active' END AS status FROM u GROUP BY 1")
def u05(t: Tables):
    """The evidence of each node is appended as an attestation where its node, source and quote are not there yet."""
    keys = ["node_id", "source_id", "quote"]
    clean = lambda df, *c: df.select(c[0], *[F.coalesce(F.trim(x), F.lit("")).alias(y) for x, y in zip(c[1:], keys[1:])]).toDF(*keys).distinct()
    new = clean(t.nd("source_id", "textual_evidence").where("coalesce(trim(textual_evidence), '') <> ''"), "id", "source_id", "textual_evidence")
    return G.appended(clean(t.attestations, "node_id", "source_id", "quote"), new, keys).groupBy("node_id").agg(F.count("*").alias("n"), F.count_if("added").alias("added"), F.when(F.count("*") > 1, "corroborated").otherwise("active").alias("status"))


@query("U06_cleared_edges", "SELECT src, dst, type, rel_ord, count(*) AS n FROM relations WHERE source IS NULL OR source NOT IN ('reconcile') GROUP BY ALL")
def u06(t: Tables):
    return t.relations.where("source IS NULL OR source NOT IN ('reconcile')").groupBy("src", "dst", "type", "rel_ord").agg(F.count("*").alias("n"))


_SETTLED = "WITH k AS (SELECT src AS id FROM {ge} WHERE type = 'contradicts' UNION SELECT dst FROM {ge} WHERE type = 'contradicts'), s AS (SELECT n.id, count(DISTINCT sk) AS n_sources, coalesce(any_value(n.evidential_weight), 0) AS w FROM {nd} n JOIN {ak} a ON a.node_id = n.id WHERE n.type IN ('claim', 'evidence') GROUP BY 1) "


def settled(t: Tables):
    against = t.ge.where("type = 'contradicts'").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = t.ak.where("sk IS NOT NULL").groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("sk").alias("n_sources"))
    rows = t.nd("type", "evidential_weight").where("type IN ('claim', 'evidence')").join(n, "id").where("n_sources > 1")
    return rows.join(against, "id", "left_anti").select("id", "n_sources", F.coalesce("evidential_weight", F.lit(0.0)).alias("w"))


@query("U07_settled_contested", _SETTLED + ", a AS (SELECT 'settled' AS kind, id, row_number() OVER (ORDER BY n_sources DESC, w DESC, id) AS k FROM s WHERE n_sources > 1 AND id NOT IN (SELECT id FROM k)), b AS (SELECT 'contested' AS kind, id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT id FROM k)) SELECT kind, id, CAST(k AS BIGINT) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE k <= 15")
def u07(t: Tables):
    """Up to fifteen settled claims, best attested first, and fifteen contested ones by id; no id is on both lists."""
    from pyspark.sql import Window

    k = t.ge.where("type = 'contradicts'").select(F.explode(F.array("src", "dst")).alias("id")).distinct().orderBy("id").limit(15)
    s = settled(t).orderBy(F.desc("n_sources"), F.desc("w"), "id").limit(15)
    place = lambda df, kind, *order: df.select(F.lit(kind).alias("kind"), "id", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("k"))  # noqa: E731  at most 15 rows
    return place(s, "settled", F.desc("n_sources"), F.desc("w"), "id").unionByName(place(k, "contested", "id"))


@query("U08_corpus_union", "SELECT DISTINCT kind, id, t FROM (SELECT 'node' AS kind, id, content AS t FROM {nd} UNION ALL SELECT 'crux', substr(sha256(crux), 1, 8), crux FROM {cx} UNION ALL SELECT 'theme', theme, theme FROM {th} UNION ALL SELECT 'chain', chain, n.content FROM " + _CH + " c JOIN {nd} n ON n.id = c.chain) WHERE coalesce(t, '') <> ''")
def u08(t: Tables):
    """The texts of nodes, cruxes, themes and chains with their ids."""
    c = lambda x: F.col(x).alias("t")
    chains = relations.chain_claims(t).select(F.col("chain").alias("id")).distinct().join(t.nd("content"), "id")
    parts = t.nd("content").select(F.lit("node").alias("kind"), "id", c("content")).unionByName(relations.crux_claims(t).select(F.lit("crux").alias("kind"), F.substring(F.sha2("crux", 256), 1, 8).alias("id"), c("crux")))
    parts = parts.unionByName(relations.themes(t).select(F.lit("theme").alias("kind"), F.col("theme").alias("id"), c("theme"))).unionByName(chains.select(F.lit("chain").alias("kind"), "id", c("content")))
    return parts.where("coalesce(t, '') <> ''").distinct()


@query("U09_upserted", "SELECT id, CASE WHEN status = 'draft' THEN 'active' ELSE status END AS status, coalesce(evidential_weight, 0.5) AS weight FROM {nd}")
def u09(t: Tables):
    old = t.nd("status", "evidential_weight").select("id", "status", F.col("evidential_weight").alias("weight"))
    new = old.where("status = 'draft' OR weight IS NULL").select("id", F.when(F.col("status") == "draft", "active").alias("status"), F.when(F.col("weight").isNull(), 0.5).alias("weight"))
    return G.upsert(old, new, "id", ["status", "weight"])
