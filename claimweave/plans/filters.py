"""F: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.functions import text as X
from claimweave.operators import graph as G
from claimweave.operators import stance as S
from claimweave.operators.reconcile import epistemic_fields
from claimweave.plans.registry import Tables, query
from claimweave.runtime import bounded
from claimweave.sources import readers as R

_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_WORDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SCORE_WORDS.items())


def normal_type(c):
    raw = F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("claim"))))
    return F.when(raw.isin(*C.NODE_TYPES), raw).otherwise("claim")


@query(
    "F01_normal_nodes",
    f"SELECT id, CASE WHEN lower(trim(type)) IN ({_LIST(C.NODE_TYPES)}) THEN lower(trim(type)) ELSE 'claim' END AS type, CASE WHEN lower(trim(type)) = 'rebuttal' AND coalesce(trim(claim_type), '') IN ('', 'unknown') THEN 'dismissal' ELSE claim_type END AS claim_type, CASE WHEN evidential_weight IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, evidential_weight)) END AS weight FROM {{nd}}",
)
def f01(t: Tables):
    n = t.nd("type", "claim_type", "evidential_weight")
    dismissed = (F.lower(F.trim("type")) == "rebuttal") & F.coalesce(F.trim("claim_type"), F.lit("")).isin("", "unknown")
    weight = F.when(F.col("evidential_weight").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "evidential_weight")))
    return n.select("id", normal_type(F.col("type")).alias("type"), F.when(dismissed, "dismissal").otherwise(F.col("claim_type")).alias("claim_type"), weight.alias("weight"))


@query(
    "F02_scores",
    f"WITH v AS (SELECT id, CASE ord % 5 WHEN 0 THEN 'very high' WHEN 1 THEN ' Medium ' WHEN 2 THEN CAST(round(evidential_weight * 2, 3) AS VARCHAR) WHEN 3 THEN 'foo' ELSE NULL END AS raw FROM {{nd}}) SELECT id, coalesce(CASE replace(lower(trim(raw)), ' ', '_') {_WORDS} END, CASE WHEN try_cast(trim(raw) AS DOUBLE) IS NOT NULL THEN least(1.0, greatest(0.0, try_cast(trim(raw) AS DOUBLE))) END, 0.5)::DOUBLE AS score FROM v",
)
def f02(t: Tables):
    raw = F.when(F.col("ord") % 5 == 0, "very high").when(F.col("ord") % 5 == 1, " Medium ").when(F.col("ord") % 5 == 2, F.round(F.col("evidential_weight") * 2, 3).cast("string")).when(F.col("ord") % 5 == 3, "foo")
    return t.nd("ord", "evidential_weight").select("id", X.score_of(raw).alias("score"))


def rhetorical():
    kind = F.lower(F.trim(F.coalesce("claim_type", F.lit(""))))
    return kind.isin(*C.RHETORICAL) | ((F.lower(F.trim("type")) == "rebuttal") & kind.isin("", "unknown", "interpretive"))


@query("F03_rhetorical", f"SELECT id, lower(trim(coalesce(claim_type, ''))) IN ({_LIST(C.RHETORICAL)}) OR (lower(trim(type)) = 'rebuttal' AND lower(trim(coalesce(claim_type, ''))) IN ('', 'unknown', 'interpretive')) AS rhetorical FROM {{nd}}")
def f03(t: Tables):
    return t.nd("type", "claim_type").select("id", rhetorical().alias("rhetorical"))


def gate(quote, body_found):
    short = F.length(F.trim(F.coalesce(quote, F.lit("")))) < C.DEFAULT.min_quote
    return F.when(~F.col("type").isin("claim", "evidence"), "quote not required for type").when(short, "missing quote (min 20 chars)").when(X.is_junk_quote(quote), "quote is TOC/index debris, not evidence").when(body_found, "grounded").otherwise("quote not found in chunk")


_JUNKSQL = r"(length(trim(q)) < 8 OR regexp_matches(trim(q), '\b[A-Za-z]{4,}\d{1,2}\b') OR regexp_matches(trim(q), '(\.\s*){3,}\s*\d+\s*$') OR len(regexp_extract_all(trim(q), '(\.\s*){3}')) >= 2 OR regexp_matches(trim(q), '(?i)^(ated|nal|ing|tion|ions|ment|ally)\s'))"
_NORM = lambda c: rf"regexp_replace(regexp_replace(trim(lower({c})), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"


_FIRSTQ = "fq AS (SELECT node_id, quote FROM (SELECT node_id, quote, row_number() OVER (PARTITION BY node_id ORDER BY att_ord, quote) AS k FROM attestations WHERE coalesce(trim(quote), '') <> '') WHERE k = 1)"


@query(
    "F05_quote_gate",
    rf"WITH {_FIRSTQ}, n AS (SELECT id, type, textual_evidence AS body, coalesce(nullif(trim(quote_exact), ''), fq.quote) AS q FROM {{nd}} LEFT JOIN fq ON fq.node_id = id) SELECT id, CASE WHEN type NOT IN ('claim', 'evidence') THEN 'quote not required for type' WHEN length(trim(coalesce(q, ''))) < 20 THEN 'missing quote (min 20 chars)' WHEN {_JUNKSQL} THEN 'quote is TOC/index debris, not evidence' WHEN length({_NORM('q')}) >= 20 AND contains({_NORM('body')}, {_NORM('q')}) THEN 'grounded' ELSE 'quote not found in chunk' END AS reason FROM n",
)
def f05(t: Tables):
    """The gate by literal containment: the exact quote, else the first attested one, in the evidence of the node."""
    return gated(t).select("id", "reason")


def gated(t: Tables):
    """(id, quote, chunk, reason): what the gate says of each node before the fuzzy search."""
    first = t.attestations.where("coalesce(trim(quote), '') <> ''").groupBy(F.col("node_id").alias("id")).agg(F.min(F.struct("att_ord", "quote"))["quote"].alias("first"))
    n = t.nd("type", "textual_evidence", "quote_exact").join(first, "id", "left").withColumn("quote", F.coalesce(F.nullif(F.trim("quote_exact"), F.lit("")), "first"))
    q, b = X.matching_form(F.col("quote")), X.matching_form(F.col("textual_evidence"))
    found = F.coalesce((F.length(q) >= C.DEFAULT.min_quote) & F.contains(b, q), F.lit(False))
    return n.select("id", "quote", F.col("textual_evidence").alias("chunk"), gate(F.col("quote"), found).alias("reason"))


@query("F05_fuzzy_gate")
def f05_fuzzy(t: Tables):
    """The gate with its fuzzy search, which runs on what is not found literally only."""
    g = gated(t)
    lost = F.col("reason") == "quote not found in chunk"
    near = X.fuzzy_grounding(C.DEFAULT.fuzzy_quote)(F.col("quote"), F.coalesce("chunk", F.lit("")))
    return g.where(~lost).select("id", "reason").unionByName(g.where(lost).select("id", F.when(near, "grounded").otherwise(F.col("reason")).alias("reason")))


@query("F06_literal_quotes", f"SELECT id, length({_NORM('quote_exact')}) >= 20 AND contains({_NORM('textual_evidence')}, {_NORM('quote_exact')}) AS literal FROM {{nd}} WHERE textual_evidence IS NOT NULL AND quote_exact IS NOT NULL")
def f06_literal(t: Tables):
    n = t.nd("textual_evidence", "quote_exact").where("textual_evidence IS NOT NULL AND quote_exact IS NOT NULL")
    q, b = X.matching_form(F.col("quote_exact")), X.matching_form(F.col("textual_evidence"))
    return n.select("id", ((F.length(q) >= C.DEFAULT.min_quote) & F.contains(b, q)).alias("literal"))


@query("F06_quote_in_body")
def f06(t: Tables):
    """Literal containment first; the fuzzy window runs in vectorised Python on the rest only."""
    n = t.nd("textual_evidence", "quote_exact").where("textual_evidence IS NOT NULL AND quote_exact IS NOT NULL")
    q, b = X.matching_form(F.col("quote_exact")), X.matching_form(F.col("textual_evidence"))
    n = n.withColumn("literal", (F.length(q) >= C.DEFAULT.min_quote) & F.contains(b, q))
    sure = n.where("literal").select("id", F.lit("literal").alias("how"), F.lit(True).alias("grounded"))
    rest = n.where("NOT literal").select("id", F.lit("fuzzy").alias("how"), X.fuzzy_grounding(C.DEFAULT.fuzzy_quote)(F.col("quote_exact"), F.col("textual_evidence")).alias("grounded"))
    return sure.unionByName(rest)


@query("F07_junk_quotes", rf"SELECT node_id, att_ord, count(*) AS n FROM (SELECT *, coalesce(quote, '') AS q FROM attestations) WHERE {_JUNKSQL} GROUP BY 1, 2")
def f07(t: Tables):
    return t.attestations.where(X.is_junk_quote(F.col("quote"))).groupBy("node_id", "att_ord").agg(F.count("*").alias("n"))


@query("F08_toc_lines", r"WITH l AS (SELECT capture_id, unnest(string_split(body, chr(10))) AS x FROM {bd}) SELECT capture_id, count(*) AS n_lines FROM l WHERE trim(x) = '' OR NOT (regexp_matches(trim(x), '(\.\s*){3,}\s*\d+\s*$') OR regexp_matches(trim(x), '^\s*\d+(\.\d+)+\s+[A-Za-z][^.]{5,100}\.\s*$')) GROUP BY 1")
def f08(t: Tables):
    return t.bd.select("capture_id", F.size(F.split(X.without_toc(F.col("body")), "\n")).cast("bigint").alias("n_lines"))


_ENT = "(SELECT {nd}.id, {nd}.content, unnest(p.key_entities) AS e FROM {nd} JOIN case_profiles p ON p.case_name = {nd}.case_name)"
_HIT = "CASE WHEN len(list_filter(regexp_split_to_array(lower(e), '\\s+'), lambda w: length(w) > 3)) = 0 THEN contains(lower(content), lower(e)) ELSE len(list_filter(regexp_split_to_array(lower(e), '\\s+'), lambda w: length(w) > 3 AND contains(lower(content), w))) >= greatest(1, len(list_filter(regexp_split_to_array(lower(e), '\\s+'), lambda w: length(w) > 3)) // 2) END"


def _with_entities(t: Tables, *columns: str):
    return t.nd("content", "case_name", *columns).join(bounded(t.case_profiles.select("case_name", "key_entities")), "case_name")


@query("F09_entity_overlap", f"SELECT id, round(avg(CASE WHEN {_HIT} THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM {_ENT} WHERE content IS NOT NULL GROUP BY id")
def f09(t: Tables):
    return _with_entities(t).where("content IS NOT NULL").select("id", F.round(X.entity_overlap(F.col("content"), F.col("key_entities")), 6).alias("overlap"))


_LEVEL = "CASE WHEN claim_type = 'methodological' THEN 'methodological' WHEN claim_type = 'predictive' THEN 'illustrative' ELSE 'direct' END"
_WORDS4 = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z]{{{{4,}}}}'))"
_GENERIC = "CASE WHEN coalesce(trim(subfield), '') <> '' THEN 'In ' || subfield || ', researchers often claim that ' || content ELSE 'In this field, it is generally believed that ' || content END"


@query(
    "F10_specificity",
    (
        f"WITH s AS (SELECT id, any_value(level) AS level, any_value(grounded) AS grounded, any_value(sim) AS sim, avg(CASE WHEN {_HIT} THEN 1.0 ELSE 0.0 END) AS e FROM (SELECT {{nd}}.id, {{nd}}.content, coalesce({{nd}}.quote_grounded, false) AS grounded, {_LEVEL} AS level, coalesce(sqrt(len({_WORDS4('content')})::DOUBLE / nullif(len({_WORDS4(_GENERIC)}), 0)), 0) AS sim, unnest(p.key_entities) AS e FROM {{nd}} JOIN case_profiles p ON p.case_name = {{nd}}.case_name) WHERE content IS NOT NULL GROUP BY id) "
        "SELECT id, CASE WHEN grounded AND level = 'direct' THEN 1.0::DOUBLE ELSE round(greatest(0, least(1, e * (1 - 0.5 * sim))), 6) END AS specificity, CASE WHEN grounded AND level = 'direct' THEN false WHEN level = 'methodological' THEN greatest(0, least(1, e * (1 - 0.5 * sim))) < 0.2 ELSE e < 0.15 AND sim >= 0.9 END AS rejected FROM s"
    ).replace("{{4,}}", "{4,}"),
)
def f10(t: Tables):
    """A direct claim with a verified quote passes at 1. The likeness to a generic paraphrase is the cosine of word sets, of which
    those of the content are a part."""
    n = _with_entities(t, "claim_type", "subfield", "quote_grounded").where("content IS NOT NULL").withColumn("e", X.entity_overlap(F.col("content"), F.col("key_entities")))
    words = lambda c: F.size(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), 1)))
    generic = F.when(F.coalesce(F.trim("subfield"), F.lit("")) != "", F.concat(F.lit("In "), "subfield", F.lit(", researchers often claim that "), "content")).otherwise(F.concat(F.lit("In this field, it is generally believed that "), "content"))
    n = n.withColumn("sim", F.sqrt(words(F.col("content")).cast("double") / words(generic)))
    level = F.when(F.col("claim_type") == "methodological", "methodological").when(F.col("claim_type") == "predictive", "illustrative").otherwise("direct")
    sure = F.coalesce("quote_grounded", F.lit(False)) & (level == "direct")
    spec = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("e") * (1 - 0.5 * F.col("sim"))))
    low = F.when(sure, False).when(level == "methodological", spec < C.DEFAULT.specificity_mismatch * 0.5).otherwise((F.col("e") < C.DEFAULT.entity_floor) & (F.col("sim") >= C.DEFAULT.generic_ceiling))
    return n.select("id", F.when(sure, 1.0).otherwise(F.round(spec, 6)).alias("specificity"), low.alias("rejected"))


_POL = "WITH v AS (SELECT id, coalesce(attributed_to, 'source_author') AS a, CASE WHEN attributed_to IN ('opposing_position', 'reported_speech') THEN 'argues_against' WHEN specificity_score < 0.2 THEN 'argues_against' WHEN specificity_score < 0.3 THEN 'reports_others' ELSE 'asserts' END AS verdict, CASE WHEN attributed_to IN ('opposing_position', 'reported_speech') THEN 0.9 ELSE coalesce(evidential_weight, 0.5) END AS conf, textual_evidence IS NULL AND coalesce(attributed_to, '') NOT IN ('opposing_position', 'reported_speech') AS skipped FROM {nd}) "


@query("F11_polarity_risk", _POL + "SELECT id, CASE WHEN skipped THEN 'none' WHEN a = 'opposing_position' AND verdict = 'argues_against' THEN 'high' WHEN a = 'source_author' AND verdict = 'argues_against' AND conf >= 0.7 THEN 'conflict' WHEN verdict = 'argues_against' AND conf < 0.7 THEN 'low' WHEN verdict = 'reports_others' THEN 'low' ELSE 'none' END AS risk FROM v")
def f11(t: Tables):
    """Verdicts are an input relation; here a stated function of two scores stands in for recorded ones."""
    quoted = F.coalesce("attributed_to", F.lit("")).isin("opposing_position", "reported_speech")
    a = F.coalesce("attributed_to", F.lit("source_author"))
    verdict = F.when(quoted | (F.col("specificity_score") < 0.2), "argues_against").when(F.col("specificity_score") < 0.3, "reports_others").otherwise("asserts")
    conf = F.when(quoted, 0.9).otherwise(F.coalesce("evidential_weight", F.lit(0.5)))
    n = t.nd("attributed_to", "specificity_score", "evidential_weight", "textual_evidence").select("id", a.alias("a"), verdict.alias("verdict"), conf.alias("conf"), (F.col("textual_evidence").isNull() & ~quoted).alias("skipped"))
    return n.select("id", polarity_risk().alias("risk"))


def polarity_risk():
    against = F.col("verdict") == "argues_against"
    return F.when(F.col("skipped"), "none").when((F.col("a") == "opposing_position") & against, "high").when((F.col("a") == "source_author") & against & (F.col("conf") >= 0.7), "conflict").when(against & (F.col("conf") < 0.7), "low").when(F.col("verdict") == "reports_others", "low").otherwise("none")


def needs_review():
    return F.coalesce(F.col("specificity_score") < 0.3, F.lit(False)) | ~F.coalesce("quote_grounded", F.lit(False)) | F.coalesce(F.col("polarity_risk").isin("high", "conflict"), F.lit(False))


@query("F12_needs_review", "SELECT id, coalesce(specificity_score < 0.3, false) OR NOT coalesce(quote_grounded, false) OR coalesce(polarity_risk IN ('high', 'conflict'), false) AS needs_review FROM {nd}")
def f12(t: Tables):
    return t.nd("specificity_score", "quote_grounded", "polarity_risk").select("id", needs_review().alias("needs_review"))


@query("F13_low_weight", "SELECT id FROM {nd} WHERE evidential_weight < 0.3")
def f13(t: Tables):
    return t.nodes.where("evidential_weight < 0.3").select("id").distinct()


def _sides(t: Tables) -> dict[str, list[S.Position]]:
    """The positions per case; case_profiles is of fixed size."""
    return {r["case_name"]: S.positions(r["debate_positions"] or []) for r in t.case_profiles.select("case_name", "debate_positions").collect()}


def by_case(t: Tables, make):
    out = None
    for case, sides in sorted(_sides(t).items()):
        value = make(sides)
        out = F.when(F.col("case_name") == case, value) if out is None else out.when(F.col("case_name") == case, value)
    return out if out is not None else F.lit(None).cast("string")


@query("F14_stance_model")
def f14(t: Tables):
    rows = [(case, p.id, p.phrase, p.words) for case, sides in sorted(_sides(t).items()) for p in sides]
    return t.spark.createDataFrame(rows, "case_name string, position string, phrase string, words string")


@query("F15_stances")
def f15(t: Tables):
    text = F.concat_ws(" ", "content", "textual_evidence")
    return t.nd("case_name", "content", "textual_evidence").select("id", by_case(t, lambda s: S.stance(text, s)).alias("stance"))


def judged_attestations(t: Tables):
    """Attestations with a quote and what their stance says against the claim: conflicts (both take a side, not the same), and
    lacks_support (the claim speaks of the case's topic, the quote does not, and there is no conflict)."""
    profiles = {r["case_name"]: S.topic_pattern(r.asDict()) for r in t.case_profiles.collect()}  # of fixed size

    def on_topic(text):
        out = F.lit(False)
        for case, pattern in sorted(profiles.items()):
            if pattern:
                out = F.when(F.col("case_name") == case, text.rlike("(?i)" + pattern)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    n = t.nd("case_name", "type", "content", "key_question").withColumn("own", by_case(t, lambda s: S.stance(F.concat_ws(" ", "content", "key_question"), s)))
    a = t.attestations.where("quote IS NOT NULL").withColumnRenamed("node_id", "id").join(n.select("id", "case_name", "type", "content", "own"), "id")
    conflict = S.conflicting(F.col("own"), by_case(t, lambda s: S.stance(F.col("quote"), s)))
    return a.withColumn("conflicts", conflict).withColumn("lacks_support", on_topic(F.col("content")) & ~on_topic(F.col("quote")) & ~F.col("conflicts"))


@query("F16_attestation_stances")
def f16(t: Tables):
    a = judged_attestations(t)
    return a.select("id", "att_ord", "conflicts", "lacks_support", F.col("own").alias("stance"), F.sha2("quote", 256).alias("quote_digest")).distinct()


@query("F17_pair_stances")
def f17(t: Tables):
    n = t.nd("case_name", "content", "textual_evidence").select("id", by_case(t, lambda s: S.stance(F.col("content"), s)).alias("s"), by_case(t, lambda s: S.stance(F.col("textual_evidence"), s)).alias("q"))
    pairs = G.undirected(t.rl.where("type = 'same_as'"))
    both = pairs.join(n.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")), "a").join(n.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb")), "b")
    return both.select("a", "b", (S.conflicting(F.col("sa"), F.col("sb")) | S.conflicting(F.col("qa"), F.col("sb")) | S.conflicting(F.col("qb"), F.col("sa"))).alias("conflict"))


@query(
    "F18_pruned_status",
    rf"WITH p AS (SELECT *, coalesce(quote, '') AS q FROM {{ak}}), kept AS (SELECT DISTINCT node_id, sk FROM p WHERE sk IS NOT NULL AND trim(q) <> '' AND NOT {_JUNKSQL}), su AS (SELECT node_id AS id, count(*) AS n FROM kept GROUP BY 1), "
    "ag AS (SELECT e.dst AS id, count(DISTINCT sk) FILTER (WHERE e.type = 'contradicts' AND coalesce(strength, 0) >= 0.55) AS s, count(DISTINCT sk) FILTER (WHERE NOT (e.type = 'contradicts' AND coalesce(strength, 0) >= 0.55)) AS w FROM {ge} e JOIN kept ON kept.node_id = e.src WHERE e.type IN ('contradicts', 'weak_contradicts') GROUP BY 1) "
    "SELECT n.id, coalesce(su.n, 0) AS support_count, CASE WHEN coalesce(ag.s, 0) > 0 THEN 'contested' WHEN coalesce(ag.w, 0) > 0 THEN 'contested_weak' WHEN coalesce(su.n, 0) >= 3 THEN 'well_established' WHEN coalesce(su.n, 0) = 2 THEN 'supported' ELSE 'single_source' END AS epistemic_status FROM {nd} n LEFT JOIN su ON su.id = n.id LEFT JOIN ag ON ag.id = n.id",
)
def f18(t: Tables):
    """Status after attestations without a quote or with debris for one are dropped."""
    kept = t.attestations.where(~X.is_junk_quote(F.col("quote")))
    return epistemic_fields(t.nodes.select("id"), kept, t.ge).select("id", "support_count", "epistemic_status")


def pruned_attestations(t: Tables):
    """The attestations that stay: with a quote that is no debris, and for claims and evidence none that conflicts or lacks support."""
    against = F.col("type").isin("claim", "evidence") & (F.col("conflicts") | F.col("lacks_support"))
    kept = judged_attestations(t).where(~X.is_junk_quote(F.col("quote")) & ~against)
    return kept.select(F.col("id").alias("node_id"), "source_id", "author", "quote")


@query("F18_stance_pruned_status")
def f18_stance(t: Tables):
    """F18 with the stance drops, whose patterns come from the profiles."""
    return epistemic_fields(t.nodes.select("id"), pruned_attestations(t), t.ge).select("id", "support_count", "epistemic_status")


@query(
    "F19_source_roles",
    "SELECT source_id, CASE WHEN coalesce(role, '') <> '' THEN CASE WHEN replace(lower(trim(role)), ' ', '_') IN (" + _LIST(C.ROLES) + ") THEN replace(lower(trim(role)), ' ', '_') ELSE 'unknown' END WHEN regexp_matches(lower(coalesce(url, '')), 'youtube\\.com|youtu\\.be') THEN 'debate_transcript' WHEN contains(lower(coalesce(author, '')), 'judge') OR contains(lower(coalesce(title, '')), 'judge') THEN 'judge_decision' WHEN regexp_matches(lower(coalesce(nullif(title, ''), nullif(local_path, ''), url, '')), 'response to|response-to|response_to|rebuttal|reply') THEN 'rebuttal' WHEN regexp_matches(lower(coalesce(url, '')), 'doi\\.org|pubmed|arxiv\\.org|biorxiv|ncbi\\.nlm\\.nih\\.gov') THEN 'primary_research' WHEN regexp_matches(lower(coalesce(url, '')), 'academic\\.oup\\.com|sciencedirect\\.com|springer\\.com|nature\\.com|wiley\\.com|cell\\.com|thelancet\\.com') AND coalesce(publication_status, '') <> 'unpublished' THEN 'primary_research' WHEN regexp_matches(lower(coalesce(title, '')), 'meta-analysis|systematic review|meta analysis') THEN 'review' WHEN regexp_matches(lower(coalesce(url, '')), 'substack\\.com|medium\\.com|blogspot|wordpress\\.com') THEN 'commentary' WHEN coalesce(content_type, '') IN ('video', 'audio') THEN 'debate_transcript' ELSE 'unknown' END AS role FROM {so}",
)
def f19(t: Tables):
    return t.so.select("source_id", R.source_role().alias("role"))


_SEC = r"(?i)^\s*(abstract|introduction|background|methods?|materials?\s*(?:and\s+methods?)?|results?|findings?|discussion|conclusions?|limitations?|supplementary|acknowledgements?|references?|bibliography|\d+[\.\s]+(?:introduction|methods?|results?|discussion|conclusion))\s*$"
_HINT = "CASE " + " ".join(f"WHEN contains(lower(s), '{k}') THEN '{v}'" for k, v in C.SECTION_HINTS.items()) + f" ELSE '{C.NO_HINT}' END"


@query("F20_sections", rf"WITH p AS (SELECT capture_id, trim(unnest(string_split(body, chr(10))), ' ' || chr(9)) AS s FROM {{bd}}) SELECT capture_id, s AS section, {_HINT} AS hint, count(*) AS n FROM p WHERE regexp_matches(s, '{_SEC}') GROUP BY ALL")
def f20(t: Tables):
    lines = t.bd.select("capture_id", F.explode(F.split("body", "\n")).alias("s")).select("capture_id", F.btrim("s", F.lit(" \t")).alias("section")).where(X.is_section(F.col("section")))
    return lines.groupBy("capture_id", "section", X.section_hint(F.col("section")).alias("hint")).agg(F.count("*").alias("n"))


_PROB = C.PROBABILITY_TERMS
_MARK = C.DEBATE_TERMS
_METH = C.METHOD_TERMS
_sum = lambda xs, c: " + ".join(f"contains({c}, '{x}')::INT" for x in xs)


@query(
    "F21_inquiry_type",
    f"WITH q AS (SELECT case_name, len(debate_positions) AS np, lower(array_to_string(central_questions, ' ')) AS qs, lower(array_to_string(subfields, ' ')) AS sf FROM case_profiles), cs AS (SELECT n.case_name, count(*) AS n, count(*) FILTER (WHERE lower(coalesce(s.publication_status, '')) IN ('peer_reviewed', 'published') OR regexp_matches(lower(coalesce(s.content_type, '')), 'paper|preprint|research|journal|dataset')) AS pub, coalesce(bool_or(contains(lower(s.content_type), 'debate')), false) AS deb FROM (SELECT DISTINCT case_name, source_id FROM nodes) n JOIN {{so}} s ON s.source_id = n.source_id GROUP BY 1), sc AS (SELECT q.case_name, CASE WHEN deb THEN 3 ELSE 0 END + CASE WHEN ({_sum(_PROB, 'qs')}) > 0 THEN 3 ELSE 0 END + CASE WHEN np >= 2 AND ({_sum(_MARK, 'qs')}) > 0 THEN 1 ELSE 0 END AS d, CASE WHEN n > 0 AND pub >= greatest(1, n // 2) THEN 2 ELSE 0 END + CASE WHEN ({_sum(_METH, chr(113) + 's || chr(32) || sf')}) >= 2 THEN 2 ELSE 0 END AS s FROM q LEFT JOIN cs ON cs.case_name = q.case_name) SELECT case_name, CASE WHEN d >= 3 AND d >= s THEN 'probabilistic_debate' WHEN s >= 3 AND s > d THEN 'empirical_bench_science' ELSE 'mixed' END AS inquiry_type FROM sc",
)
def f21(t: Tables):
    hits = lambda c, xs: sum((F.contains(c, F.lit(x)).cast("int") for x in xs), F.lit(0))
    used = t.nodes.select("case_name", "source_id").distinct().join(bounded(t.so.select("source_id", "publication_status", "content_type")), "source_id")
    cs = used.groupBy("case_name").agg(F.count("*").alias("n"), F.count_if(F.lower(F.coalesce("publication_status", F.lit(""))).isin("peer_reviewed", "published") | F.lower(F.coalesce("content_type", F.lit(""))).rlike("|".join(C.PAPER_KINDS))).alias("pub"), F.coalesce(F.bool_or(F.contains(F.lower("content_type"), F.lit("debate"))), F.lit(False)).alias("deb"))
    q = t.case_profiles.select("case_name", F.size("debate_positions").alias("np"), F.lower(F.array_join("central_questions", " ")).alias("qs"), F.lower(F.array_join("subfields", " ")).alias("sf")).join(cs, "case_name", "left")
    d = F.when(F.col("deb"), 3).otherwise(0) + F.when(hits(F.col("qs"), _PROB) > 0, 3).otherwise(0) + F.when((F.col("np") >= 2) & (hits(F.col("qs"), _MARK) > 0), 1).otherwise(0)
    s = F.when((F.col("n") > 0) & (F.col("pub") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))), 2).otherwise(0) + F.when(hits(F.concat_ws(" ", "qs", "sf"), _METH) >= 2, 2).otherwise(0)
    return q.select("case_name", F.when((d >= 3) & (d >= s), "probabilistic_debate").when((s >= 3) & (s > d), "empirical_bench_science").otherwise("mixed").alias("inquiry_type"))


@query("F22_papers", f"SELECT capture_id, ({_sum(C.PAPER_MARKERS, 'lower(left(body, 12000))')}) >= 2 AS paper FROM {{bd}}")
def f22(t: Tables):
    return t.bd.select("capture_id", X.looks_like_paper(F.col("body")).alias("paper"))


_REF = "(SELECT source_id, coalesce(title, '') || CASE WHEN publication_status = 'published' THEN ', ' || coalesce(left(source_date, 4), '') ELSE ', common practice' END AS r FROM {so})"


@query("F23_specific_references", rf"SELECT source_id, length(trim(r)) >= 20 AND NOT (regexp_matches(lower(r), 'standard practice|field convention|textbook|generally accepted|widely used|common practice') AND NOT regexp_matches(lower(r), '\d{{4}}|2nd|3rd|edition|ed\.')) AND regexp_matches(lower(r), '\d{{4}}|edition|ed\.|vol\.|chapter|section|iso |who |cohen') AS specific FROM {_REF}")
def f23(t: Tables):
    ref = F.concat(F.coalesce("title", F.lit("")), F.when(F.col("publication_status") == "published", F.concat(F.lit(", "), F.coalesce(F.substring("source_date", 1, 4), F.lit("")))).otherwise(F.lit(", common practice")))
    return t.so.select("source_id", X.specific_reference(ref).alias("specific"))


_FLAT = lambda c: rf"regexp_replace(lower(trim({c})), '\s+', ' ', 'g')"


@query("F24_quote_in_corpus", f"SELECT id, contains({_FLAT('textual_evidence')}, {_FLAT('quote_exact')}) AS found FROM {{nd}} WHERE coalesce(quote_exact, '') <> '' AND coalesce(textual_evidence, '') <> ''")
def f24(t: Tables):
    n = t.nd("textual_evidence", "quote_exact").where("coalesce(quote_exact, '') <> '' AND coalesce(textual_evidence, '') <> ''")
    return n.select("id", F.contains(X.collapsed_lower(F.col("textual_evidence")), X.collapsed_lower(F.col("quote_exact"))).alias("found"))


_PARAM = "WITH p AS (SELECT node_id, att_ord, CASE source_type WHEN 'peer_reviewed' THEN 'from_evidence' WHEN 'journalism' THEN 'external_standard' ELSE 'expert_guess' END AS g, quote, coalesce(source_url, '') || ' ' || coalesce(a.source_date, '') AS ref, textual_evidence AS body FROM (SELECT DISTINCT node_id, att_ord, source_type, quote, source_url, source_date FROM attestations) a JOIN {nd} ON {nd}.id = a.node_id), r AS (SELECT *, CASE WHEN g = 'from_evidence' THEN CASE WHEN coalesce(quote, '') <> '' AND coalesce(body, '') <> '' AND contains(" + _FLAT("body") + ", " + _FLAT("quote") + r") THEN g ELSE 'ungrounded' END WHEN g = 'external_standard' THEN CASE WHEN length(trim(ref)) >= 20 AND regexp_matches(lower(ref), '\d{4}|edition|ed\.|vol\.|chapter|section|iso |who |cohen') THEN g ELSE 'ungrounded' END ELSE 'ungrounded' END AS new FROM p) "


def parameters(t: Tables):
    """Study parameters read off attestations, with their declared and their checked grounding."""
    g = F.when(F.col("source_type") == "peer_reviewed", "from_evidence").when(F.col("source_type") == "journalism", "external_standard").otherwise("expert_guess")
    a = t.attestations.select(F.col("node_id").alias("id"), "att_ord", "source_type", "quote", "source_url", "source_date").distinct().join(t.nd("textual_evidence"), "id")
    ref = F.concat(F.coalesce("source_url", F.lit("")), F.lit(" "), F.coalesce("source_date", F.lit("")))
    found = (F.coalesce("quote", F.lit("")) != "") & (F.coalesce("textual_evidence", F.lit("")) != "") & F.contains(X.collapsed_lower(F.col("textual_evidence")), X.collapsed_lower(F.col("quote")))
    new = F.when(g == "from_evidence", F.when(found, g).otherwise("ungrounded")).when(g == "external_standard", F.when(X.specific_reference(ref), g).otherwise("ungrounded")).otherwise("ungrounded")
    return a.select(F.col("id").alias("node_id"), "att_ord", g.alias("declared"), new.alias("grounding"), "quote")


@query("F25_grounding_overrides", _PARAM + "SELECT node_id, att_ord, g AS declared, new AS grounding, count(*) AS n FROM r WHERE g <> new GROUP BY ALL")
def f25(t: Tables):
    return parameters(t).where("declared <> grounding").groupBy("node_id", "att_ord", "declared", "grounding").agg(F.count("*").alias("n"))




@query(
    "F26_top_presuppositions",
    "WITH p AS (SELECT id, ord, case_name, subfield, CASE WHEN polarity_risk IN ('high', 'conflict') THEN 'FATAL' WHEN ord % 3 = 0 THEN 'MINOR' ELSE 'MAJOR' END AS severity FROM {nd} WHERE type = 'presupposition') SELECT id, severity, CAST(k AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY case_name, coalesce(subfield, '') ORDER BY CASE severity WHEN 'FATAL' THEN 0 ELSE 1 END, ord, id) AS k FROM p WHERE severity <> 'MINOR') WHERE k <= 3",
)
def f26(t: Tables):
    from pyspark.sql import Window

    sev = F.when(F.col("polarity_risk").isin("high", "conflict"), "FATAL").when(F.col("ord") % 3 == 0, "MINOR").otherwise("MAJOR")
    p = t.nd("type", "ord", "case_name", "subfield", "polarity_risk").where("type = 'presupposition'").select("id", "ord", "case_name", F.coalesce("subfield", F.lit("")).alias("sf"), sev.alias("severity")).where("severity <> 'MINOR'")
    w = Window.partitionBy("case_name", "sf").orderBy(F.when(F.col("severity") == "FATAL", 0).otherwise(1), "ord", "id")
    return p.withColumn("k", F.row_number().over(w)).where(F.col("k") <= C.DEFAULT.max_presuppositions).select("id", "severity", F.col("k").cast("bigint").alias("k"))


_KEPT = "kept AS (SELECT id FROM {nd} WHERE type <> 'presupposition' UNION SELECT dst FROM {ge} WHERE type = 'presupposes')"


@query("F27_pruned_presuppositions", "WITH " + _KEPT + " SELECT e.src, e.dst, e.type FROM {ge} e WHERE e.src IN (SELECT id FROM kept) AND e.dst IN (SELECT id FROM kept)")
def f27(t: Tables):
    edges = t.ge
    kept = t.nd("type").where("type <> 'presupposition'").select("id").union(edges.where("type = 'presupposes'").select("dst")).distinct()
    return edges.select("src", "dst", "type").join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")


_PROSE = r"WITH p AS (SELECT doc_id, trim(unnest(x)) AS p, generate_subscripts(x, 1) AS no FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS x FROM documents)), c AS (SELECT * FROM p WHERE p <> '' AND NOT regexp_matches(p, '^(#|\||```|- |\* |1\.|2\.|3\.)') AND len(list_filter(string_split(p, chr(10)), lambda x: regexp_matches(x, '^\s*[-*|]'))) * 2 <= len(string_split(p, chr(10))) AND len(regexp_extract_all(p, '\S+')) >= 25) "


def prose(docs):
    """(doc_id, no, p): prose paragraphs of at least 25 words; headings, tables, code and lists are left out."""
    p = docs.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("no", "p")).select("doc_id", (F.col("no") + 1).cast("bigint").alias("no"), F.trim("p").alias("p"))
    lines = F.split("p", "\n")
    listed = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*|]"))) * 2 <= F.size(lines)
    return p.where((F.col("p") != "") & ~F.col("p").rlike(r"^(#|\||```|- |\* |1\.|2\.|3\.)") & listed & (F.regexp_count("p", F.lit(r"\S+")) >= C.DEFAULT.paragraph_words))


@query("F28_prose_paragraphs", _PROSE + "SELECT doc_id, count(*) AS n, sum(length(p))::BIGINT AS n_chars FROM c GROUP BY 1")
def f28(t: Tables):
    return prose(t.documents).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("n_chars"))


@query("F29_complete_sections", r"SELECT doc_id, length(rtrim(text, ' ' || chr(9) || chr(10) || chr(13))) < 100 OR regexp_matches(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)), '[.!?:)\]\x22*]$') AS complete FROM documents")
def f29(t: Tables):
    end = F.rtrim("text", F.lit(" \t\n\r"))
    return t.documents.select("doc_id", ((F.length(end) < 100) | end.rlike(r'[.!?:)\]"*]$')).alias("complete"))


@query("F30_valid_relations", f"SELECT src, dst, type, least(0.95, greatest(0.3, coalesce(strength, 0.6)))::DOUBLE AS strength FROM {{rl}} WHERE type IN ({_LIST(C.RELATE_TYPES)}) AND src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def f30(t: Tables):
    ids = t.nodes.select("id").distinct()
    ok = t.rl.where(F.col("type").isin(*C.RELATE_TYPES) & (F.col("src") != F.col("dst"))).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ok.select("src", "dst", "type", F.least(F.lit(0.95), F.greatest(F.lit(0.3), F.coalesce("strength", F.lit(0.6)))).alias("strength"))


@query("F31_guarded_relations", "SELECT src, dst, type, strength FROM {ge}")
def f31(t: Tables):
    return t.ge.select("src", "dst", "type", "strength")


_TIER = lambda kind, c: "CASE " + f"coalesce({c}, '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.BADGES[kind].items() if k) + f" ELSE '{C.BADGES[kind][None]}' END"
_LEVELS = "CASE WHEN evidential_weight >= 0.7 THEN 'high' WHEN evidential_weight >= 0.4 THEN 'medium' WHEN evidential_weight IS NOT NULL THEN 'low' ELSE '' END"


def badge(kind: str, value):
    """The tier of a badge; values that are not known take the kind's own default."""
    known = F.create_map(*[F.lit(x) for k, v in C.BADGES[kind].items() if k for x in (k, v)])
    return F.coalesce(known[F.coalesce(value, F.lit(""))], F.lit(C.BADGES[kind][None]))


@query(
    "F32_badges",
    f"SELECT n.id, {_TIER('epistemic', 'trim(epistemic_status)')} AS epistemic, {_TIER('vulnerability', _LEVELS)} AS vulnerability, {_TIER('leverage', _LEVELS)} AS leverage, {_TIER('grounding', chr(39) + chr(39) + ' || CASE WHEN quote_grounded THEN ' + chr(39) + 'grounded' + chr(39) + ' ELSE ' + chr(39) + 'ungrounded' + chr(39) + ' END')} AS grounding, {_TIER('audit', 'status')} AS audit, {_TIER('importance', 'CASE WHEN status = ' + chr(39) + 'active' + chr(39) + ' THEN ' + chr(39) + 'central' + chr(39) + ' ELSE status END')} AS importance FROM {{nd}} n",
)
def f32(t: Tables):
    """All six look-ups per node, each on a value the node has; statuses outside a kind's set take its default."""
    w = F.col("evidential_weight")
    level = F.when(w >= 0.7, "high").when(w >= 0.4, "medium").when(w.isNotNull(), "low").otherwise("")
    n = t.nd("epistemic_status", "evidential_weight", "quote_grounded", "status")
    return n.select(
        "id", badge("epistemic", F.trim("epistemic_status")).alias("epistemic"), badge("vulnerability", level).alias("vulnerability"), badge("leverage", level).alias("leverage"),
        badge("grounding", F.when(F.col("quote_grounded"), "grounded").otherwise("ungrounded")).alias("grounding"), badge("audit", F.col("status")).alias("audit"), badge("importance", F.when(F.col("status") == "active", "central").otherwise(F.col("status"))).alias("importance"),
    )


@query(
    "F33_rubric_integrity",
    "WITH c AS (SELECT case_name, row_number() OVER (ORDER BY case_name) AS k FROM case_profiles), pr AS (SELECT case_name, k = 2 AS failed, unnest(CASE WHEN k <= 2 THEN [NULL] WHEN k = 3 THEN ['peer_reviewed'] ELSE ['peer_reviewed', 'journalism', 'essay_reflection', 'debate_transcript'] END) AS criterion_id FROM c), "
    "au AS (SELECT DISTINCT n.case_name, a.source_type AS criterion_id FROM attestations a JOIN {nd} n ON n.id = a.node_id WHERE a.source_type IS NOT NULL), x AS (SELECT c.case_name, (SELECT bool_or(failed) FROM pr WHERE pr.case_name = c.case_name) AS failed, (SELECT count(criterion_id) FROM pr WHERE pr.case_name = c.case_name) AS own, (SELECT count(*) FROM au WHERE au.case_name = c.case_name) AS used, (SELECT count(*) FROM au WHERE au.case_name = c.case_name AND au.criterion_id NOT IN (SELECT criterion_id FROM pr WHERE pr.case_name = c.case_name AND criterion_id IS NOT NULL)) AS foreign_criteria FROM c) "
    "SELECT case_name, foreign_criteria, CASE WHEN failed THEN 'profile failed' WHEN own = 0 AND used > 0 THEN 'no shared rubric' WHEN own > 0 AND foreign_criteria > 0 THEN 'overrides' ELSE 'shared rubric' END AS state FROM x",
)
def f33(t: Tables):
    """Audits by source type against rubrics: the first case has none, the second's profile failed, the third's is short."""
    names = sorted(r["case_name"] for r in t.case_profiles.select("case_name").collect())  # of fixed size
    full = ("peer_reviewed", "journalism", "essay_reflection", "debate_transcript")
    rubric = [(case, c) for k, case in enumerate(names) for c in (() if k < 2 else full[:1] if k == 2 else full)]
    profiles = t.spark.createDataFrame([(case, k == 1) for k, case in enumerate(names)], "case_name string, failed boolean")
    audits = t.attestations.where("source_type IS NOT NULL").select(F.col("node_id").alias("id"), F.col("source_type").alias("criterion_id")).join(t.nd("case_name"), "id").select("case_name", "criterion_id").distinct()
    return rubric_states(profiles, t.spark.createDataFrame(rubric, "case_name string, criterion_id string"), audits)


def rubric_states(profiles, rubric, audits):
    """(case_name, foreign_criteria, state) per profile (case_name, failed): whether audits (case_name, criterion_id) keep to the
    rubric (case_name, criterion_id)."""
    own = rubric.groupBy("case_name").agg(F.count("*").alias("own"))
    used = audits.join(rubric.withColumn("known", F.lit(True)), ["case_name", "criterion_id"], "left").groupBy("case_name").agg(F.count("*").alias("used"), F.count_if(F.col("known").isNull()).alias("foreign_criteria"))
    x = profiles.join(own, "case_name", "left").join(used, "case_name", "left").na.fill(0)
    state = F.when(F.col("failed"), "profile failed").when((F.col("own") == 0) & (F.col("used") > 0), "no shared rubric").when((F.col("own") > 0) & (F.col("foreign_criteria") > 0), "overrides").otherwise("shared rubric")
    return x.select("case_name", "foreign_criteria", state.alias("state"))


@query("F34_backfilled", "SELECT n.id AS node_id, count(*) AS n, bool_or(a.node_id IS NULL) AS made FROM {nd} n LEFT JOIN attestations a ON a.node_id = n.id WHERE a.node_id IS NOT NULL OR coalesce(n.source_id, '') <> '' OR coalesce(nullif(textual_evidence, ''), nullif(quote_exact, '')) IS NOT NULL GROUP BY 1")
def f34(t: Tables):
    return G.backfilled(t.attestations, t.nodes).groupBy("node_id").agg(F.count("*").alias("n"), F.bool_or("made").alias("made"))


@query("F35_constructed", "SELECT id, coalesce(status, 'active') AS status, coalesce(attributed_to, 'source_author') AS attributed_to, coalesce(nullif(source_id, ''), nullif(source_author, ''), 'unknown') AS source_key, coalesce(support_count, 0)::BIGINT AS support_count FROM {nd}")
def f35(t: Tables):
    return t.nd("status", "attributed_to", "source_id", "source_author", "support_count").select("id", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("attributed_to", F.lit("source_author")).alias("attributed_to"), F.coalesce(F.nullif("source_id", F.lit("")), F.nullif("source_author", F.lit("")), F.lit("unknown")).alias("source_key"), F.coalesce("support_count", F.lit(0)).cast("bigint").alias("support_count"))
