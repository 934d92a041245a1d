"""Status of claims, contradictions and their routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.operators.graph import keyed_attestations, without_conflicts


def status_of(support: str, strong: str, weak: str) -> Column:
    return F.when(F.col(strong) > 0, "contested").when(F.col(weak) > 0, "contested_weak").when(F.col(support) >= 3, "well_established").when(F.col(support) == 2, "supported").otherwise("single_source")


def epistemic_fields(ids: DataFrame, attestations: DataFrame, edges: DataFrame, floor: float = C.DEFAULT.strong_contradiction) -> DataFrame:
    """(id, support_count, contradict_count, weak_contradict_count, epistemic_status) for each id.

    Distinct source keys of the node itself, and of the nodes with an incoming contradiction at or above the floor, or below
    it or weak. A null strength counts as 0. One shuffle of the edges by their source and one by their target.
    """
    att = keyed_attestations(attestations).where("sk IS NOT NULL").select("node_id", "sk").distinct()
    support = att.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("support_count"))
    incoming = edges.where(F.col("type").isin("contradicts", "weak_contradicts"))
    strong = (F.col("type") == "contradicts") & (F.coalesce("strength", F.lit(0.0)) >= floor)
    against = incoming.select(F.col("src").alias("node_id"), F.col("dst").alias("id"), strong.alias("strong")).join(att, "node_id")
    against = against.select("id", "sk", "strong").distinct().groupBy("id").agg(F.count_if("strong").alias("contradict_count"), F.count_if(~F.col("strong")).alias("weak_contradict_count"))
    counts = ["support_count", "contradict_count", "weak_contradict_count"]
    out = ids.select("id").distinct().join(support, "id", "left").join(against, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return out.withColumn("epistemic_status", status_of(*counts))


def cross_source_pairs(pairs: DataFrame, attestations: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b, …) with cross_paper (both source sets non-empty and disjoint), same_document (they share a source) and
    same_author (author sets equal and non-empty). Sets are never built: shared and own sizes are counted."""
    att = keyed_attestations(attestations)
    src = att.where("sk IS NOT NULL").select(F.col("node_id").alias("id"), "sk").distinct()
    named = att.select(F.col("node_id").alias("id"), F.nullif(F.lower(F.trim("author")), F.lit("")).alias("au")).where("au IS NOT NULL").distinct()
    own = nodes.select("id", F.nullif(F.lower(F.trim("source_author")), F.lit("")).alias("au")).where("au IS NOT NULL").distinct()
    aut = named.unionByName(own.join(named.select("id").distinct(), "id", "left_anti"))
    keys = pairs.select("a", "b").distinct()

    def overlap(rows: DataFrame, value: str, name: str) -> DataFrame:
        n = rows.groupBy("id").agg(F.count("*").alias("n"))
        shared = keys.join(rows.withColumnRenamed("id", "a"), "a").join(rows.withColumnRenamed("id", "b"), ["b", value]).groupBy("a", "b").agg(F.count("*").alias(f"{name}_shared"))
        return keys.join(n.select(F.col("id").alias("a"), F.col("n").alias(f"{name}_a")), "a", "left").join(n.select(F.col("id").alias("b"), F.col("n").alias(f"{name}_b")), "b", "left").join(shared, ["a", "b"], "left").na.fill(0)

    both = overlap(src, "sk", "s").join(overlap(aut, "au", "u"), ["a", "b"])
    flags = both.select(
        "a", "b",
        ((F.col("s_a") > 0) & (F.col("s_b") > 0) & (F.col("s_shared") == 0)).alias("cross_paper"),
        (F.col("s_shared") > 0).alias("same_document"),
        ((F.col("u_a") > 0) & (F.col("u_a") == F.col("u_b")) & (F.col("u_shared") == F.col("u_a"))).alias("same_author"),
    )
    return pairs.join(flags, ["a", "b"])


def route_contradictions(flagged: DataFrame, question_similarity: str | None = None, floor: float = C.DEFAULT.shared_question) -> DataFrame:
    """Directed edges both ways for judged contradictions (a, b, sim, same_document, same_author)."""
    kind = F.when(F.col("same_document") | F.col("same_author"), "self_inconsistency")
    if question_similarity:
        kind = kind.when(F.col(question_similarity) < floor, "weak_contradicts")
    rows = flagged.withColumn("type", kind.otherwise("contradicts"))
    return rows.select(F.col("a").alias("src"), F.col("b").alias("dst"), "type", F.col("sim").alias("strength")).unionByName(rows.select(F.col("b").alias("src"), F.col("a").alias("dst"), "type", F.col("sim").alias("strength")))


def judged(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """pairs with the recorded verdict of their sorted ids; distinct where none is recorded or it is unknown."""
    known = ("same", "distinct", "contradicts", "quantitative_divergence")
    v = verdicts.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lower(F.trim("verdict")).alias("verdict")).groupBy("a", "b").agg(F.min("verdict").alias("verdict"))
    return pairs.join(v, ["a", "b"], "left").withColumn("verdict", F.when(F.col("verdict").isin(*known), F.col("verdict")).otherwise("distinct"))


def merge_candidates(pairs: DataFrame, attestations: DataFrame, nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    return without_conflicts(cross_source_pairs(pairs, attestations, nodes).where("cross_paper"), conflicts)


def strength_bucket(strength: Column) -> Column:
    """Lower edge of the 0.05-wide bucket from 0.40; values outside are clamped into the first and last."""
    s = F.least(F.greatest(strength, F.lit(0.4)), F.lit(0.9999999990))
    return F.least(F.floor((s - F.lit(0.4)) / F.lit(0.05)), F.lit(11)).cast("int")
