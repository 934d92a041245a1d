"""The boundary to language models: recorded responses as keyed input relations.

Every step that asks a model is a left join of its requests with a table (kind, key, response). What is missing or
unreadable takes the step's own default; nothing here calls a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.sources.writers import memo_key

# The contract of each step as a schema, and what a missing or unreadable response stands for.
CONTRACTS: dict[str, tuple[str, str]] = {
    "chunk_offsets": ("offsets array<int>", '{"offsets": []}'),
    "document_summary": ("text string", '{"text": ""}'),
    "case_profile": ("central_questions array<string>, subfields array<string>, key_entities array<string>, debate_positions array<string>", "{}"),
    "source_thesis": ("main_thesis string, sub_theses array<string>, methodological_stance string", "{}"),
    "node_extraction": ("nodes array<struct<type string, content string, textual_evidence string, argument_level string>>", '{"nodes": []}'),
    "source_role": ("role string", '{"role": "unknown"}'),
    "polarity": ("verdict string, confidence double", '{"verdict": "asserts", "confidence": 0.5}'),
    "genericity": ("generic boolean", '{"generic": false}'),
    "pair_verdict": ("verdict string, reason string, shared_question string", '{"verdict": "distinct"}'),
    "presuppositions": ("items array<struct<content string, vulnerability string>>", '{"items": []}'),
    "disambiguation": ("type string, narrative string", "{}"),
    "cruxes": ("cruxes array<struct<id string, question string>>", '{"cruxes": []}'),
    "relations": ("relations array<struct<from_id string, to_id string, type string, strength double>>", '{"relations": []}'),
    "gaps": ("gaps array<string>", '{"gaps": []}'),
    "methodology": ("criteria array<struct<id string, severity string>>", '{"criteria": []}'),
    "hypothesis": ("study_parameters array<struct<parameter string, grounding string>>", '{"study_parameters": []}'),
    "reasoning": ("narrative string, items array<string>", "{}"),
}


def unfenced(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", "")


def answered(requests: DataFrame, responses: DataFrame, kind: str, key: Column) -> DataFrame:
    """requests with `answer` (the contract's struct) and `how`: recorded, unreadable or missing.

    responses is (kind, key, response), at most one row per kind and key; of several the least is taken.
    """
    schema, default = CONTRACTS[kind]
    r = responses.where(F.col("kind") == kind).groupBy("key").agg(F.min("response").alias("response"))
    rows = requests.withColumn("key", memo_key(key)).join(r, "key", "left")
    parsed = F.from_json(unfenced(F.col("response")), schema)
    fine = F.col("response").isNotNull() & F.coalesce(F.trim("response") != "", F.lit(False)) & F.get_json_object(unfenced(F.col("response")), "$").isNotNull()
    how = F.when(F.col("response").isNull(), "missing").when(fine, "recorded").otherwise("unreadable")
    return rows.withColumn("how", how).withColumn("answer", F.when(F.col("how") == "recorded", parsed).otherwise(F.from_json(F.lit(default), schema))).drop("response")


# Tries of a call, its first token limit and the greatest.
TRIES, TOKENS, MOST_TOKENS = 3, 1000, 8000


def folded_calls(tries: DataFrame, call: list[str]) -> DataFrame:
    """(call, tries_before, outcome, tokens) from tries (call, try, good): how many failed before the first good one (null for a
    refused call), and the token limit reached by doubling after each failure."""
    first = F.min(F.when(F.col("good"), F.col("try")))
    out = tries.groupBy(*call).agg(first.cast("int").alias("tries_before"))
    limit = F.least(F.lit(MOST_TOKENS), TOKENS * F.pow(F.lit(2), F.coalesce("tries_before", F.lit(TRIES - 1))))
    return out.select(*call, "tries_before", F.when(F.col("tries_before").isNull(), "refused").otherwise("answered").alias("outcome"), limit.cast("int").alias("tokens"))
