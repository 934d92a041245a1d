"""Relations compiled from the graph tables that several queries share: cruxes, themes, chains and parameters.

A crux is a key question with its claims, a theme the presuppositions of a case and subfield, a chain the claims that depend
on one node; each is a stated stand-in for what a model would name, so that every operator below has whole tables to run on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.plans.filters import needs_review
from claimweave.plans.registry import Tables


def crux_claims(t: Tables) -> DataFrame:
    return t.nd("type", "key_question").where("type = 'claim' AND coalesce(trim(key_question), '') <> ''").select(F.col("key_question").alias("crux"), F.col("id").alias("claim_id"))


def theme_name():
    return F.concat("case_name", F.lit("/"), F.coalesce(F.nullif(F.trim("subfield"), F.lit("")), F.lit("Uncategorized")))


def themes(t: Tables) -> DataFrame:
    """(theme, id, needs): presuppositions with their theme."""
    n = t.nd("type", "case_name", "subfield", "specificity_score", "quote_grounded", "polarity_risk").where("type = 'presupposition'")
    return n.select(theme_name().alias("theme"), "id", needs_review().alias("needs"))


def crux_themes(t: Tables) -> DataFrame:
    return crux_claims(t).join(t.nd("case_name", "subfield").withColumnRenamed("id", "claim_id"), "claim_id").select("crux", theme_name().alias("theme")).distinct()


def chain_claims(t: Tables) -> DataFrame:
    return t.ge.where("type = 'depends_on'").select(F.col("dst").alias("chain"), F.col("src").alias("claim_id")).distinct()


def reviewed_nodes(t: Tables, *columns: str) -> DataFrame:
    n = t.nd(*dict.fromkeys(["type", "ord", "evidential_weight", "specificity_score", "quote_grounded", "polarity_risk", *columns]))
    return n.withColumn("needs_review", needs_review())
