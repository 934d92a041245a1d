"""Propositions, cruxes and their alignment, importance of sources, themes and debate state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.functions import text as X
from claimweave.runtime import stash


def question_edges(edges: DataFrame) -> DataFrame:
    """Contradiction-like edges with their shared question q."""
    rows = edges.where(F.col("type").isin(*C.PROPOSITION_TYPES)).withColumn("q", X.shared_question(F.col("shared_question"), F.col("rationale")))
    return rows.where("q <> ''")


def proposition_status() -> Column:
    """Contested needs two sources; a tension within one author, or a weak one, needs that nothing else is there."""
    n = F.col
    return (
        F.when((n("n_contra") > 0) & (n("n_sources") >= 2), "contested")
        .when(n("n_div") > 0, "divergent")
        .when((n("n_self") > 0) & (n("n_self") == n("edge_count")), "single_author_tension")
        .when((n("n_weak") > 0) & (n("n_weak") == n("edge_count")), "weak_tension")
        .otherwise("open")
    )


def propositions(edges: DataFrame, keyed: DataFrame) -> DataFrame:
    """(q, edge_count, n_contra, n_weak, n_div, n_self, n_sources, status): one row per question; both directions count."""
    e = question_edges(edges)
    n = lambda kind: F.count_if(F.col("type") == kind)
    out = e.groupBy("q").agg(F.count("*").alias("edge_count"), n("contradicts").alias("n_contra"), n("weak_contradicts").alias("n_weak"), n("quantitative_divergence").alias("n_div"), n("self_inconsistency").alias("n_self"))
    src = proposition_claims(e).join(keyed.where("sk IS NOT NULL").select(F.col("node_id").alias("claim_id"), "sk").distinct(), "claim_id").groupBy("q").agg(F.count_distinct("sk").alias("n_sources"))
    return out.join(src, "q", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0))).withColumn("status", proposition_status())


def proposition_records(edges: DataFrame, keyed: DataFrame, label: str = "props") -> DataFrame:
    """propositions() with prop_id (prop_0000 the one with most edges, then the least question), the histogram of its edge types
    and its claim ids in order. A proposition lists its claims, as many as it has."""
    e = question_edges(edges)
    kinds = e.groupBy("q", "type").agg(F.count("*").alias("n")).groupBy("q").agg(F.array_join(F.array_sort(F.collect_list(F.concat("type", F.lit("="), F.col("n").cast("string")))), ",").alias("edge_types"))
    claims = proposition_claims(e).groupBy("q").agg(listed(F.col("claim_id")).alias("claim_ids"))
    rows = propositions(edges, keyed).join(kinds, "q").join(claims, "q")
    placed = positions(rows, [F.desc("edge_count"), F.col("q")], label)
    return placed.select(F.format_string("prop_%04d", F.col("pos") - 1).alias("prop_id"), "q", "edge_count", "edge_types", "claim_ids", "n_sources", "status")


def proposition_claims(e: DataFrame) -> DataFrame:
    return e.select("q", F.explode(F.array("src", "dst")).alias("claim_id")).distinct()


def best_matches(crux_claims: DataFrame, prop_claims: DataFrame) -> DataFrame:
    """(crux, q, jaccard, shared): for every crux the proposition of the greatest Jaccard likeness of claim ids (4 digits), then
    most shared, then least q; null where none is shared. Equi-joins on the claim and counts only."""
    cs, ps = crux_claims.groupBy("crux").agg(F.count("*").alias("nc")), prop_claims.groupBy("q").agg(F.count("*").alias("np"))
    met = crux_claims.join(prop_claims, "claim_id").groupBy("crux", "q").agg(F.count("*").alias("shared")).join(cs, "crux").join(ps, "q")
    met = met.withColumn("jaccard", F.round(F.col("shared") / (F.col("nc") + F.col("np") - F.col("shared")), 4))
    best = met.groupBy("crux").agg(F.min(F.struct(-F.col("jaccard"), -F.col("shared"), F.col("q"))).alias("m"))
    return cs.select("crux").join(best, "crux", "left").select("crux", F.col("m.q").alias("q"), F.coalesce(-F.col("m.col1"), F.lit(0.0)).alias("jaccard"), F.coalesce(-F.col("m.col2"), F.lit(0)).alias("shared"))


def disputes(props: DataFrame, matches: DataFrame, floor: float) -> DataFrame:
    """Contested propositions of two or more sources, and whether some crux matches one at the floor."""
    covered = matches.where((F.col("jaccard") >= floor) & F.col("q").isNotNull()).select("q").distinct().withColumn("covered", F.lit(True))
    return props.where("status = 'contested' AND n_sources >= 2").join(covered, "q", "left").select("q", "edge_count", "n_sources", F.coalesce("covered", F.lit(False)).alias("covered"))


def source_importance(nodes: DataFrame, keyed: DataFrame, crux_claims: DataFrame) -> DataFrame:
    """One row per source: counts of its claims and evidence, of those it alone attests, of crux claims, mean weight, risk, tier."""
    n = nodes.where("type IN ('claim', 'evidence')").select("id", "type", F.coalesce("evidential_weight", F.lit(0.0)).alias("w"))
    att = keyed.where("sk IS NOT NULL").select(F.col("node_id").alias("id"), "sk").distinct()
    sole = att.groupBy("id").agg((F.count("*") == 1).alias("sole"))
    crux = crux_claims.select(F.col("claim_id").alias("id")).distinct().withColumn("crux", F.lit(True))
    rows = n.join(att, "id").join(sole, "id").join(crux, "id", "left").withColumn("crux", F.coalesce("crux", F.lit(False)))
    out = rows.groupBy(F.col("sk").alias("source_id")).agg(
        F.count_if(F.col("type") == "claim").alias("claims_count"),
        F.count_if(F.col("type") == "evidence").alias("evidence_count"),
        F.count_if("sole").alias("unique_claims_count"),
        F.count_if(F.col("sole") & (F.col("w") >= C.DEFAULT.high_weight)).alias("high_value_unique"),
        F.count_if("crux").alias("crux_claims_count"),
        F.count_if(F.col("crux") & F.col("sole")).alias("crux_exclusive_count"),
        # three digits, half up, in integers: no sum of binary fractions decides a digit
        (F.floor((2 * F.sum(F.round(F.col("w") * 10_000).cast("bigint")) + 10 * F.count("*")) / (20 * F.count("*"))) / 1000).alias("mean_evidential_weight"),
    )
    out = out.withColumn("epistemic_risk", F.round(2.0 * F.col("high_value_unique") + 3.0 * F.col("crux_exclusive_count") + 0.5 * F.col("unique_claims_count") + 0.25 * F.col("crux_claims_count"), 2))
    return out.withColumn("importance_tier", importance_tier())


def importance_tier() -> Column:
    """Tier of a source by its crux claims and by what only it attests."""
    # The limits of the tiers.
    n = F.col
    total = n("claims_count") + n("evidence_count")
    return (
        F.when((n("crux_exclusive_count") >= 1) | (n("crux_claims_count") >= 3), "central")
        .when((n("high_value_unique") >= 2) & (total > 0) & (n("unique_claims_count") >= total * 0.6), "latent_gem")
        .when((n("crux_claims_count") >= 1) | (n("unique_claims_count") >= 2), "contributory")
        .otherwise("peripheral")
    )


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ord, centrality, relation_count) of claims: edges, twice the presuppositions, three times the weight, two for a review."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("type") == "presupposes").alias("p"))
    rows = nodes.where("type = 'claim'").join(out, "id", "left")
    n, p = F.coalesce("n", F.lit(0)), F.coalesce("p", F.lit(0))
    score = n + 2.0 * p + 3.0 * F.coalesce("evidential_weight", F.lit(0.0)) + F.when(F.col("needs_review"), 2.0).otherwise(0.0)
    return rows.select("id", "ord", score.alias("centrality"), n.alias("relation_count"))


def listed(c: Column) -> Column:
    """The distinct values of a group in order, as one comma-separated text."""
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def debate_state(nodes: DataFrame, edges: DataFrame, attestations: DataFrame) -> DataFrame:
    """Of claims, evidence and questions with any edge of the six roles, or more than one attestation: the ids in each role.

    Ids are distinct and in order; a node has few edges of its own, and the nodes that fall with one are listed too.
    """
    kinds = {"contradicts": "contradicted_by", "supports": "supported_by", "undermines": "undermined_by", "requires": "requires_true", "explains": "explained_by"}
    out = edges.groupBy(F.col("src").alias("id")).agg(*[listed(F.when(F.col("type") == k, F.col("dst"))).alias(v) for k, v in kinds.items()])
    falls = edges.where("type = 'requires'").groupBy(F.col("dst").alias("id")).agg(listed(F.col("src")).alias("if_false_then_falls"))
    att = attestations.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n_attestations"))
    roles = [*kinds.values(), "if_false_then_falls"]
    rows = nodes.where("type IN ('claim', 'evidence', 'question')").select("id").join(out, "id", "left").join(falls, "id", "left").join(att, "id", "left")
    rows = rows.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in roles], F.coalesce("n_attestations", F.lit(0)).alias("n_attestations"))
    return rows.where("concat(" + ", ".join(roles) + ") <> '' OR n_attestations > 1")


def ranges(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, ranges): runs of consecutive numbers as §a or §a–§b, joined by commas."""
    w = Window.partitionBy(group).orderBy(number)
    runs = df.select(group, number).distinct().withColumn("island", F.col(number) - F.row_number().over(w)).groupBy(group, "island").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    part = F.when(F.col("lo") == F.col("hi"), F.concat(F.lit("§"), F.col("lo").cast("string"))).otherwise(F.concat(F.lit("§"), F.col("lo").cast("string"), F.lit("–§"), F.col("hi").cast("string")))
    rows = runs.withColumn("part", part).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("lo", "part"))).alias("p"))
    return rows.select(group, F.array_join(F.transform("p", lambda x: x["part"]), ", ").alias("ranges"))


def running_budget(df: DataFrame, group: str, order: list, size: str, cap: int, gap: int = 2) -> DataFrame:
    """df with `kept`: how much of each row fits when rows are concatenated in order under the cap; the row that crosses it is
    cut, later ones get nothing."""
    before = F.coalesce(F.sum(F.col(size) + gap).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("kept", F.greatest(F.lit(0), F.least(F.col(size), F.lit(cap) - before)))


def positions(df: DataFrame, order: list[Column], label: str, name: str = "pos") -> DataFrame:
    """df with the position of each row in a total order. Rows are range-partitioned, numbered within partitions and moved on by
    the rows before, so that no task sorts the whole table."""
    part = stash(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), label)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    moved = part.groupBy("__p").agg(F.count("*").alias("n")).withColumn("__b", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row per partition
    k = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return part.join(F.broadcast(moved.select("__p", "__b")), "__p").withColumn(name, F.col("__b") + k).drop("__p", "__b")


def provenance_notes(paragraphs: DataFrame, group: str) -> DataFrame:
    """(group, note) from paragraphs (group, no, cited, valid): which sections cite existing ids in half of their paragraphs or
    more, which combine paraphrase, and how many cited ids exist. Sections of fewer than three paragraphs are passed over."""
    # Least paragraphs of a section, share of citing ones, validity that counts as full.
    least, share, full = 3, 50.0, 99.95
    s = paragraphs.groupBy(group, "no").agg(F.count("*").alias("n"), F.count_if(F.col("valid") > 0).alias("e")).where(F.col("n") >= least)
    kinds = s.select(group, "no", F.when(100.0 * F.col("e") / F.col("n") >= share, "graph").otherwise("synthesis").alias("kind"))
    part = lambda kind, text: ranges(kinds.where(F.col("kind") == kind), group, "no").select(group, F.concat("ranges", F.lit(text)).alias(kind))
    pct = F.coalesce(F.try_divide(100.0 * F.sum("valid"), F.sum("cited")), F.lit(100.0))
    out = paragraphs.groupBy(group).agg(pct.alias("pct")).join(part("graph", " are graph-derived"), group, "left").join(part("synthesis", " combine paraphrase with synthesis"), group, "left")
    lost = F.concat(F.round((100 - F.col("pct")) * 10).cast("bigint").cast("string"), F.lit(" of 1000 cited ids do not resolve"))
    return out.select(group, F.concat_ws("; ", "graph", "synthesis", F.when(F.col("pct") >= full, "no hallucinated references").otherwise(lost)).alias("note"))


def cost_ledger(calls: DataFrame, label: str, tier: Column) -> DataFrame:
    """(label, cost, calls) from (label, i, o) input and output tokens at the prices of each call's tier, and a total."""
    price = lambda k: F.create_map(*[F.lit(x) for name, p in C.TOKEN_PRICES.items() for x in (name, p[k])])[tier]
    spent = F.col("i") * price(0) + F.col("o") * price(1)
    return calls.withColumn("__c", spent).rollup(label).agg(F.round(F.sum("__c") / 1e6, 6).alias("cost"), F.count("*").alias("calls")).select(F.coalesce(label, F.lit("total")).alias("label"), "cost", "calls")


def nearest(left: DataFrame, keys: list[str], right: DataFrame, floor: float) -> DataFrame:
    """(keys, id, sim): for each row of left (keys, tokens) the row of right (id, tokens) of the greatest Jaccard likeness, at
    least floor, then the least id. Tokens meet by equi-join and are counted; pairs without a shared one are never made."""
    x = left.select(*keys, F.explode("tokens").alias("__w"), F.size("tokens").alias("__m"))
    y = right.select("id", F.explode("tokens").alias("__w"), F.size("tokens").alias("__n"))
    met = x.join(y, "__w").groupBy(*keys, "id").agg(F.count("*").alias("__k"), F.first("__m").alias("__m"), F.first("__n").alias("__n"))
    sims = met.select(*keys, "id", F.round(F.col("__k") / (F.col("__m") + F.col("__n") - F.col("__k")), 9).alias("sim")).where(F.col("sim") >= floor)
    best = sims.groupBy(*keys).agg(F.min(F.struct((-F.col("sim")).alias("s"), "id")).alias("x"))
    return best.select(*keys, "x.id", (-F.col("x.s")).alias("sim"))


def merged_verdicts(parameters: DataFrame, key: list[str]) -> DataFrame:
    """(key, from_grounding, to_grounding, override_by) of parameters (key, declared, grounding by rule, said by the judge or null)
    whose grounding changes; repeated rows count once."""
    v = parameters.groupBy(*key, "declared").agg(F.max("grounding").alias("det"), F.max("said").alias("said"))
    hard = F.col("det") == "ungrounded"
    final = F.when(hard, F.col("det")).otherwise(F.coalesce("said", "declared"))
    by = F.when(hard & (F.col("declared") != "ungrounded"), "rule").otherwise("judge")
    return v.where(F.col("declared") != final).select(*key, F.col("declared").alias("from_grounding"), final.alias("to_grounding"), by.alias("override_by")).distinct()
