"""L and T: recorded model responses, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.operators import graph as G
from claimweave.operators import judges as J
from claimweave.plans.registry import Tables, query
from claimweave.runtime import work_dir
from claimweave.sources.writers import invalidated, memo_key, remember
from claimweave.streaming import incremental as I


def _folder(t: Tables, name: str) -> str:
    return f"{work_dir(t.spark)}/streams/{name}-{uuid.uuid4().hex}"


# Recorded responses are written to the work folder as text lines (kind, key, response) and read back as a relation. What a step
# was answered follows from the tables by the rule given with it; by ord, one request in five has no record, one an unreadable
# one, and one a fenced one.
MISSING, BROKEN, FENCED = 0, 2, 3
_OK = f"ord % 5 NOT IN ({MISSING}, {BROKEN})"


def recorded(t: Tables, kind: str, rows):
    """The responses to rows (id, ord, response struct) as a relation that was written and read."""
    text = F.to_json("response")
    said = F.when(F.col("ord") % 5 == BROKEN, F.concat(F.substring(text, 1, 1), F.lit(" …"))).when(F.col("ord") % 5 == FENCED, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    lines = rows.where(F.col("ord") % 5 != MISSING).select(F.lit(kind).alias("kind"), memo_key(F.concat(F.lit(kind + ":"), "id")).alias("key"), said.alias("response"))
    at = _folder(t, "responses-" + kind)
    lines.write.json(at)
    return t.spark.read.schema("kind string, key string, response string").json(at)


def answers(t: Tables, kind: str, rows):
    """rows (id, ord, response) joined with what was recorded for them: id, ord, how and the parsed answer or the default."""
    return J.answered(rows.select("id", "ord"), recorded(t, kind, rows), kind, F.concat(F.lit(kind + ":"), F.col("id")))


def _of(t: Tables, kind: str, *columns: str):
    return t.nd(*dict.fromkeys(["type", "ord", *columns])).where(F.col("type") == kind)


def _how(sql: str) -> str:
    return f"CASE WHEN ord % 5 = {MISSING} THEN 'missing' WHEN ord % 5 = {BROKEN} THEN 'unreadable' ELSE 'recorded' END AS how, {sql}"


def _if(value: str, default: str) -> str:
    return f"CASE WHEN {_OK} THEN {value} ELSE {default} END"


_BODY = "(SELECT CAST(capture_id AS VARCHAR) AS id, capture_id AS ord, source_id, body FROM {bd})"


def _bodies(t: Tables):
    return t.bd.select(F.col("capture_id").cast("string").alias("id"), F.col("capture_id").alias("ord"), "source_id", "body")


def _texts(c):
    return F.array(F.coalesce(c, F.lit("")))


@query("L01_chunk_offsets", "SELECT id, " + _how(_if("least(length(body), 10) || ',' || length(body) // 2", "''") + " AS offsets") + f" FROM {_BODY}")
def l01(t: Tables):
    n = F.length("body")
    rows = _bodies(t).select("id", "ord", F.struct(F.array(F.least(n, F.lit(10)), F.floor(n / 2).cast("int")).alias("offsets")).alias("response"))
    return answers(t, "chunk_offsets", rows).select("id", "how", F.array_join(F.transform("answer.offsets", lambda x: x.cast("string")), ",").alias("offsets"))


@query("L02_summaries", "SELECT id, " + _how(_if("left(body, 60)", "''") + " AS summary") + f" FROM {_BODY}")
def l02(t: Tables):
    rows = _bodies(t).select("id", "ord", F.struct(F.substring("body", 1, 60).alias("text")).alias("response"))
    return answers(t, "document_summary", rows).select("id", "how", F.col("answer.text").alias("summary"))


@query("L03_case_profiles", "SELECT case_name AS id, " + _how(_if("len(subfields)", "0") + "::INT AS n_subfields, " + _if("len(debate_positions)", "0") + "::INT AS n_positions") + " FROM (SELECT *, length(case_name) AS ord FROM case_profiles)")
def l03(t: Tables):
    fields = ("central_questions", "subfields", "key_entities", "debate_positions")
    rows = t.case_profiles.select(F.col("case_name").alias("id"), F.length("case_name").alias("ord"), F.struct(*fields).alias("response"))
    n = lambda c: F.coalesce(F.size(F.coalesce(f"answer.{c}", F.array().cast("array<string>"))), F.lit(0))
    return answers(t, "case_profile", rows).select("id", "how", n("subfields").alias("n_subfields"), n("debate_positions").alias("n_positions"))


@query("L04_source_theses", "SELECT id, " + _how(_if("title", "NULL") + " AS main_thesis, " + _if("role", "NULL") + " AS stance") + " FROM (SELECT source_id AS id, length(source_id) AS ord, title, role FROM {so})")
def l04(t: Tables):
    rows = t.so.select(F.col("source_id").alias("id"), F.length("source_id").alias("ord"), F.struct(F.col("title").alias("main_thesis"), F.col("role").alias("methodological_stance")).alias("response"))
    return answers(t, "source_thesis", rows).select("id", "how", "answer.main_thesis", F.col("answer.methodological_stance").alias("stance"))


def extracted(t: Tables):
    """Nodes as the extractor returned them: each record under the record it is the answer for, with its argument level."""
    level = F.when(F.col("claim_type") == "predictive", "illustrative").when(F.col("claim_type") == "methodological", "methodological").otherwise("direct")
    rows = t.nd("ord", "type", "content", "claim_type", "textual_evidence").select("id", "ord", F.struct(F.array(F.struct("type", "content", "textual_evidence", level.alias("argument_level"))).alias("nodes")).alias("response"))
    return answers(t, "node_extraction", rows).select("id", "how", F.explode("answer.nodes").alias("n")).select("id", "n.*")


_LEVEL = "CASE WHEN claim_type = 'predictive' THEN 'illustrative' WHEN claim_type = 'methodological' THEN 'methodological' ELSE 'direct' END"


@query("L05_extractions", f"SELECT id, type, content, textual_evidence, {_LEVEL} AS argument_level FROM {{nd}} WHERE {_OK}")
def l05(t: Tables):
    """One request to many nodes: what is missing or unreadable gives none."""
    return extracted(t)


@query("F04_without_illustrations", f"SELECT id, {_LEVEL} AS argument_level FROM {{nd}} WHERE {_OK} AND {_LEVEL} <> 'illustrative'")
def f04(t: Tables):
    """Extracted nodes of the illustrative level are dropped."""
    return extracted(t).where("argument_level IS NULL OR argument_level <> 'illustrative'").select("id", "argument_level")


@query("L06_source_roles", "SELECT id, " + _how(_if("coalesce(role, 'unknown')", "'unknown'") + " AS role") + " FROM (SELECT source_id AS id, length(source_id) + 1 AS ord, role FROM {so})")
def l06(t: Tables):
    rows = t.so.select(F.col("source_id").alias("id"), (F.length("source_id") + 1).alias("ord"), F.struct("role").alias("response"))
    return answers(t, "source_role", rows).select("id", "how", F.coalesce("answer.role", F.lit("unknown")).alias("role"))


@query("L07_polarity", "SELECT id, " + _how(_if("CASE WHEN attributed_to = 'opposing_position' THEN 'argues_against' ELSE 'asserts' END", "'asserts'") + " AS verdict, round(" + _if("coalesce(evidential_weight, 0.5)", "0.5") + ", 6)::DOUBLE AS confidence") + " FROM {nd} WHERE type = 'claim'")
def l07(t: Tables):
    verdict = F.when(F.col("attributed_to") == "opposing_position", "argues_against").otherwise("asserts")
    rows = _of(t, "claim", "attributed_to", "evidential_weight").select("id", "ord", F.struct(verdict.alias("verdict"), F.coalesce("evidential_weight", F.lit(0.5)).alias("confidence")).alias("response"))
    return answers(t, "polarity", rows).select("id", "how", "answer.verdict", F.round("answer.confidence", 6).alias("confidence"))


@query("L08_genericity", "SELECT id, " + _how(_if("coalesce(specificity_score < 0.3, false)", "false") + " AS generic") + " FROM {nd} WHERE type = 'claim'")
def l08(t: Tables):
    rows = _of(t, "claim", "specificity_score").select("id", "ord", F.struct(F.coalesce(F.col("specificity_score") < 0.3, F.lit(False)).alias("generic")).alias("response"))
    return answers(t, "genericity", rows).select("id", "how", "answer.generic")


@query("L09_pair_verdicts", "SELECT id, " + _how(_if("CASE WHEN kind IN ('same', 'distinct') THEN kind ELSE 'distinct' END", "'distinct'") + " AS verdict, " + _if("q", "NULL") + " AS shared_question") + " FROM (SELECT src || '|' || dst || '|' || type AS id, length(coalesce(rationale, '')) AS ord, CASE type WHEN 'same_as' THEN 'same' WHEN 'distinct' THEN 'distinct' ELSE 'unclear' END AS kind, nullif(trim(shared_question), '') AS q FROM {rl} WHERE source = 'reconcile')")
def l09(t: Tables):
    """Verdicts outside the known ones count as distinct."""
    kind = F.when(F.col("type") == "same_as", "same").when(F.col("type") == "distinct", "distinct").otherwise("unclear")
    rows = t.rl.where("source = 'reconcile'").select(F.concat_ws("|", "src", "dst", "type").alias("id"), F.length(F.coalesce("rationale", F.lit(""))).alias("ord"), F.struct(kind.alias("verdict"), F.nullif(F.trim("shared_question"), F.lit("")).alias("shared_question")).alias("response"))
    known = F.when(F.col("answer.verdict").isin("same", "distinct"), F.col("answer.verdict")).otherwise("distinct")
    return answers(t, "pair_verdict", rows).select("id", "how", known.alias("verdict"), "answer.shared_question")


@query("L10_presuppositions", f"SELECT id, content, CASE WHEN polarity_risk IN ('high', 'conflict') THEN 'FATAL' ELSE 'MAJOR' END AS vulnerability FROM {{nd}} WHERE type = 'presupposition' AND {_OK}")
def l10(t: Tables):
    item = F.struct("content", F.when(F.col("polarity_risk").isin("high", "conflict"), "FATAL").otherwise("MAJOR").alias("vulnerability"))
    rows = _of(t, "presupposition", "content", "polarity_risk").select("id", "ord", F.struct(F.array(item).alias("items")).alias("response"))
    return answers(t, "presuppositions", rows).select("id", F.explode("answer.items").alias("x")).select("id", "x.content", "x.vulnerability")


@query("L11_disambiguations", "SELECT id, " + _how(_if("'scope'", "NULL") + " AS type, " + _if("key_question", "NULL") + " AS narrative") + " FROM {nd} WHERE type = 'question'")
def l11(t: Tables):
    rows = _of(t, "question", "key_question").select("id", "ord", F.struct(F.lit("scope").alias("type"), F.col("key_question").alias("narrative")).alias("response"))
    return answers(t, "disambiguation", rows).select("id", "how", "answer.type", "answer.narrative")


@query("L12_cruxes", f"SELECT id, 'crux_' || id AS crux_id, coalesce(key_question, '') AS question FROM {{nd}} WHERE type = 'question' AND {_OK}")
def l12(t: Tables):
    one = F.struct(F.concat(F.lit("crux_"), "id").alias("id"), F.coalesce("key_question", F.lit("")).alias("question"))
    rows = _of(t, "question", "key_question").select("id", "ord", F.struct(F.array(one).alias("cruxes")).alias("response"))
    return answers(t, "cruxes", rows).select("id", F.explode("answer.cruxes").alias("c")).select("id", F.col("c.id").alias("crux_id"), "c.question")


@query("L13_relations", f"SELECT n.id, e.dst AS to_id, e.type, round(least(0.95, greatest(0.3, coalesce(e.strength, 0.6))), 6)::DOUBLE AS strength FROM {{nd}} n JOIN {{ge}} e ON e.src = n.id WHERE n.type = 'claim' AND {_OK.replace('ord', 'n.ord')}")
def l13(t: Tables):
    """Relations of a batch come back as a list; strengths are clamped, a missing one is 0.6."""
    out = t.ge.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "type", "strength")).alias("relations"))  # a node's own edges
    rows = _of(t, "claim").join(out, "id", "left").select("id", "ord", F.struct(F.coalesce("relations", F.array().cast("array<struct<from_id:string,to_id:string,type:string,strength:double>>")).alias("relations")).alias("response"))
    r = answers(t, "relations", rows).select("id", F.explode("answer.relations").alias("r"))
    return r.select("id", "r.to_id", "r.type", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.3), F.coalesce("r.strength", F.lit(0.6)))), 6).alias("strength"))


@query("L14_gaps", f"SELECT id, coalesce(content, '') AS gap FROM {{nd}} WHERE type = 'gap' AND {_OK}")
def l14(t: Tables):
    rows = _of(t, "gap", "content").select("id", "ord", F.struct(_texts(F.col("content")).alias("gaps")).alias("response"))
    return answers(t, "gaps", rows).select("id", F.explode("answer.gaps").alias("gap"))


@query("L15_methodology", f"SELECT id, coalesce(claim_type, '') AS criterion, CASE WHEN quote_grounded THEN 'FATAL' ELSE 'MINOR' END AS severity FROM {{nd}} WHERE type = 'evidence' AND {_OK}")
def l15(t: Tables):
    one = F.struct(F.coalesce("claim_type", F.lit("")).alias("id"), F.when(F.col("quote_grounded"), "FATAL").otherwise("MINOR").alias("severity"))
    rows = _of(t, "evidence", "claim_type", "quote_grounded").select("id", "ord", F.struct(F.array(one).alias("criteria")).alias("response"))
    return answers(t, "methodology", rows).select("id", F.explode("answer.criteria").alias("c")).select("id", F.col("c.id").alias("criterion"), "c.severity")


@query("L16_hypotheses", f"SELECT id, 'sample size' AS parameter, CASE WHEN quote_grounded THEN 'from_evidence' ELSE 'expert_guess' END AS grounding FROM {{nd}} WHERE type = 'question' AND {_OK}")
def l16(t: Tables):
    one = F.struct(F.lit("sample size").alias("parameter"), F.when(F.col("quote_grounded"), "from_evidence").otherwise("expert_guess").alias("grounding"))
    rows = _of(t, "question", "quote_grounded").select("id", "ord", F.struct(F.array(one).alias("study_parameters")).alias("response"))
    return answers(t, "hypothesis", rows).select("id", F.explode("answer.study_parameters").alias("p")).select("id", "p.*")


@query("L17_reasoning", "SELECT id, " + _how(_if("left(coalesce(content, ''), 100)", "NULL") + " AS narrative, " + _if("2", "0") + "::INT AS n_items") + " FROM {nd} WHERE type = 'presupposition'")
def l17(t: Tables):
    rows = _of(t, "presupposition", "content").select("id", "ord", F.struct(F.substring(F.coalesce("content", F.lit("")), 1, 100).alias("narrative"), F.array(F.lit("a"), F.lit("b")).alias("items")).alias("response"))
    return answers(t, "reasoning", rows).select("id", "how", "answer.narrative", F.size(F.coalesce("answer.items", F.array().cast("array<string>"))).alias("n_items"))


@query("L18_call_outcomes", "WITH a AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), c AS (SELECT *, (k - 1) // 3 AS call, (k - 1) % 3 AS try FROM a) SELECT user_id, call, min(CASE WHEN value > 20 THEN try END)::INT AS tries_before, CASE WHEN min(CASE WHEN value > 20 THEN try END) IS NULL THEN 'refused' ELSE 'answered' END AS outcome, least(8000, 1000 * power(2, coalesce(min(CASE WHEN value > 20 THEN try END), 2)))::INT AS tokens FROM c GROUP BY 1, 2")
def l18(t: Tables):
    """A log of tries folded into calls of up to three: the first good one answers, each failed one doubles the token limit (to
    8,000 at most), and a call without a good one is refused. Events stand for tries, three in time order for a call."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.row_number().over(w) - 1
    tries = t.events.select("user_id", F.floor(k / 3).alias("call"), (k % 3).alias("try"), (F.col("value") > 20).alias("good"))
    return J.folded_calls(tries, ["user_id", "call"])


@query("T01_incremental_ingest", "SELECT node_id, count(*) AS n FROM (SELECT DISTINCT node_id, coalesce(trim(source_id), '') AS s, coalesce(trim(quote), '') AS q FROM attestations) GROUP BY 1")
def t01(t: Tables):
    """The attestations arrive twice as a stream; the second arrival adds nothing."""
    at = _folder(t, "t01")
    a = t.attestations.select("node_id", "source_id", "quote")
    a.write.mode("append").parquet(at + "/in")
    for _ in range(2):
        stream = t.spark.readStream.schema(a.schema).parquet(at + "/in")
        I.append_unseen(t.spark, stream, at + "/out", at + "/checkpoint").awaitTermination()
        a.write.mode("append").parquet(at + "/in")
    return t.spark.read.parquet(at + "/out").groupBy("node_id").agg(F.count("*").alias("n"))


@query("T02_first_wins", "SELECT count(DISTINCT event_id) AS n FROM events")
def t02(t: Tables):
    at = _folder(t, "t02")
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e).repartition(4).write.parquet(at + "/in")
    out = I.first_wins(t.spark.readStream.schema(e.schema).parquet(at + "/in"), "ts", ["event_id"], "400 days")
    out.writeStream.format("parquet").option("path", at + "/out").option("checkpointLocation", at + "/c").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(e.schema).parquet(at + "/out").agg(F.count("*").alias("n"))


@query("T03_windowed_counts", "SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2")
def t03(t: Tables):
    """The same aggregation a stream runs, over the whole table; complete mode, so that late rows count."""
    at = _folder(t, "t03")
    name = "t03_" + uuid.uuid4().hex
    t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(at + "/in")
    stream = t.spark.readStream.schema("ts timestamp, event_type string, value double").parquet(at + "/in")
    counts = stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))

    def keep(batch, number):
        batch.select("event_type", F.to_date("w.start").alias("day"), "n").write.mode("overwrite").parquet(at + "/out")

    counts.writeStream.queryName(name).outputMode("complete").foreachBatch(keep).option("checkpointLocation", at + "/c").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(at + "/out")


def memo(t: Tables):
    """A memo of three levels: what was recorded for claims, gaps and questions, with a blank and a refused entry among each."""
    n = t.nd("ord", "type").where("type IN ('claim', 'gap', 'question')")
    said = F.when(F.col("ord") % 7 == 0, "").when(F.col("ord") % 7 == 1, '{"refused": true}').otherwise('{"text": "x"}')
    return n.select(F.col("type").alias("level"), memo_key(F.col("id")).alias("key"), said.alias("response"), "ord")


@query("K03_memo", "SELECT type AS level, substr(sha256(id || '::v2'), 1, 16) AS key, CASE WHEN ord % 14 = 0 THEN '{\"text\": \"again\"}' ELSE '{\"text\": \"x\"}' END AS response FROM {nd} WHERE type IN ('claim', 'gap', 'question') AND (ord % 7 > 1 OR ord % 14 = 0)")
def k03_memo(t: Tables):
    """Blank and refused entries are evicted; half of the blank ones are asked again and answered."""
    m = memo(t)
    fresh = m.where("ord % 14 = 0").select("level", "key", F.lit('{"text": "again"}').alias("response"))
    return remember(m.select("level", "key", "response"), fresh)


@query("K08_memo_levels", "SELECT type AS level, count(*) AS n FROM {nd} WHERE type IN ('claim', 'question') AND ord % 7 > 1 GROUP BY 1")
def k08(t: Tables):
    """Entries per level after one level was invalidated."""
    kept = remember(memo(t).select("level", "key", "response"), memo(t).select("level", "key", "response").limit(0))
    return invalidated(kept, "gap").groupBy("level").agg(F.count("*").alias("n"))


@query("T03_replay", "WITH a AS (SELECT src, dst, type, source FROM {rl} WHERE source IS NULL OR source <> 'reconcile' UNION SELECT least(src, dst), greatest(src, dst), 'same_as', 'reconcile' FROM {rl} WHERE type = 'same_as' AND src <> dst) SELECT type, coalesce(source, '') AS source, count(*) AS n FROM a GROUP BY 1, 2")
def t03_replay(t: Tables):
    """A step that clears its own edges before it writes them, run twice: the second run changes nothing."""
    at = _folder(t, "t03r")
    edges = t.rl.select("src", "dst", "type", "source")
    mine = t.rl.where("type = 'same_as' AND src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit("same_as").alias("type"), F.lit("reconcile").alias("source")).distinct()
    for k in range(2):
        G.replaced(edges, mine, "source", "reconcile").write.parquet(f"{at}/{k}")
        edges = t.spark.read.parquet(f"{at}/{k}")
    return edges.groupBy("type", F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
