"""Scores of audits against weighted criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave import config as C


def methodology_scores(evaluations: DataFrame, criteria: DataFrame, hits: DataFrame, ceiling: float) -> DataFrame:
    """(source_id, score, n_applicable, n_declared, n_missing, earned, possible).

    evaluations: (source_id, criterion_id, status); criteria: (criterion_id, severity), a rubric of bounded size; hits:
    (source_id, n). Weights FATAL 3, MAJOR 2, MINOR or unknown 1; each hit costs 0.01, at most 0.05; never below 0 nor above
    the ceiling. A source whose criteria all don't apply has score 0.
    """
    weights = F.create_map(*[F.lit(x) for item in C.SEVERITY_WEIGHT.items() for x in item])
    rubric = F.broadcast(criteria.select("criterion_id", weights[F.col("severity")].alias("w")))
    rows = evaluations.join(rubric, "criterion_id", "left").withColumn("w", F.coalesce("w", F.lit(1)))
    applies, declared = F.col("status") != "not_applicable", F.col("status") == "declared"
    total = lambda test: F.sum(F.when(test, F.col("w")).otherwise(0))
    out = rows.groupBy("source_id").agg(F.count_if(applies).alias("n_applicable"), F.count_if(declared).alias("n_declared"), F.count_if(F.col("status").isin("not_declared", "red_flag")).alias("n_missing"), total(declared).alias("earned"), total(applies).alias("possible"))
    out = out.join(hits, "source_id", "left")
    base = F.coalesce(F.try_divide(F.col("earned"), F.col("possible")), F.lit(0.0))
    raw = F.greatest(F.lit(0.0), base - F.least(F.lit(0.01) * F.coalesce("n", F.lit(0)), F.lit(0.05)))
    score = F.when(F.col("n_applicable") == 0, 0.0).otherwise(F.round(F.least(raw, F.lit(ceiling)), 3))
    return out.select("source_id", score.alias("score"), "n_applicable", "n_declared", "n_missing", F.col("earned").cast("bigint").alias("earned"), F.col("possible").cast("bigint").alias("possible"))
