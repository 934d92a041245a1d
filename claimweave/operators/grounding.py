"""Grounding of report paragraphs in the texts of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.functions import text as X
from claimweave.operators.similarity import covered, token_rows, vector_pairs
from claimweave.runtime import bounded, stash


def vector_hits(left: DataFrame, right: DataFrame, threshold: float, recall: float | None = None) -> DataFrame:
    """(a): rows of left (id, v) whose dot product with some row of right (id, v) reaches the threshold."""
    # ids of the right side are turned negative, so that both sides go through one join
    both = left.select("id", "v").unionByName(right.select((-F.col("id") - 1).alias("id"), "v"))
    return vector_pairs(both, "id", "v", threshold, recall=recall).where("a < 0 AND b >= 0").select(F.col("b").alias("a")).distinct()


def grounded_paragraphs(paragraphs: DataFrame, evidence: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None, lexical: float = C.DEFAULT.lexical_grounding, semantic: float = 0.55, label: str = "ground") -> DataFrame:
    """(doc_id, no, grounded) for paragraphs (doc_id, no, p) and evidence (text): a paragraph is grounded where some evidence
    text reaches the lexical likeness of token sets, or, with vectors ((doc_id, no, v), (id, v)), the semantic one.

    Equal token sets are compared once. Texts without tokens ground nothing.
    """
    stop = C.REPORT_STOP_WORDS
    p = stash(paragraphs.select("doc_id", "no", F.sort_array(X.token_set(F.col("p"), stop)).alias("tokens")).withColumn("k", F.xxhash64("tokens")), label + "-p")
    e = evidence.select(F.sort_array(X.token_set(F.col("text"), stop)).alias("tokens")).distinct().withColumn("k", F.xxhash64("tokens"))
    sides = [token_rows(x, "k", F.col("tokens")) for x in (p.select("k", "tokens").distinct(), e)]
    hit = covered(*sides, lexical, label=label).select(F.col("a").alias("k")).withColumn("hit", F.lit(True))
    out = p.join(bounded(hit), "k", "left").select("doc_id", "no", F.coalesce("hit", F.lit(False)).alias("grounded"))
    if vectors is None:
        return out
    mine = stash(vectors[0].where("v IS NOT NULL").withColumn("id", F.monotonically_increasing_id()), label + "-v")
    close = mine.join(vector_hits(mine, vectors[1], semantic).withColumnRenamed("a", "id"), "id").select("doc_id", "no").distinct().withColumn("near", F.lit(True))
    return out.join(close, ["doc_id", "no"], "left").select("doc_id", "no", (F.col("grounded") | F.coalesce("near", F.lit(False))).alias("grounded"))
