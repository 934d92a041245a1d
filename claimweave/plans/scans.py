"""S and K: sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave import config as C
from claimweave.functions import patterns as P
from claimweave.functions import text as X
from claimweave.operators import compile as K
from claimweave.plans import relations
from claimweave.plans.registry import ORACLE, QUERIES, Tables, query
from claimweave.runtime import bounded, work_dir
from claimweave.sources import readers as R
from claimweave.sources import writers as W


def _written(t: Tables, name: str) -> str:
    return f"{work_dir(t.spark)}/sinks-{hash(t.dir) & 0xFFFFFF}/{name}"


@query("S01_manifest", "SELECT coalesce(nullif(local_path, ''), nullif(url, ''), '') AS source_id, local_path, url, author, source_date AS date, content_type, title, bibliography, publication_status, role FROM sources")
def s01(t: Tables):
    """The manifest written as one JSON array, as it is kept, and read through the manifest reader. It is of fixed size."""
    entry = F.struct("local_path", "url", "author", F.col("source_date").alias("date"), "content_type", "title", "bibliography", "publication_status", "role")
    array = t.sources.agg(F.to_json(F.collect_list(entry)).alias("a")).first()["a"]
    W.put_files(t.spark, _written(t, "manifest"), {"sources.json": array})
    return R.manifest(t.spark, _written(t, "manifest") + "/sources.json").select("source_id", *R.MANIFEST.names)


@query("S02_source_id", "SELECT coalesce(nullif(local_path, ''), nullif(url, ''), '') AS source_id, count(*) AS n FROM sources GROUP BY 1")
def s02(t: Tables):
    return t.sources.groupBy(R.source_id().alias("source_id")).agg(F.count("*").alias("n"))


_RESOLVED = """WITH c AS (SELECT source_id, capture_id, fetched_at, coalesce(fetch_error, CASE WHEN body IS NULL THEN 'no body' WHEN starts_with(body, 'FETCH_ERROR') THEN body END) AS fetch_error, body FROM raw_docs),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN fetch_error IS NULL THEN 0 ELSE 1 END, fetched_at DESC NULLS LAST, capture_id DESC) AS k FROM c)"""


@query("S03_resolved_bodies", _RESOLVED + " SELECT source_id, capture_id, fetch_error, CASE WHEN fetch_error IS NULL THEN length(left(body, 50000)) END AS n_chars FROM k WHERE k = 1")
def s03(t: Tables):
    return R.resolved_bodies(t.raw_docs).select("source_id", "capture_id", "fetch_error", F.length("body").cast("bigint").alias("n_chars"))


_TOC = r"array_to_string(list_filter(string_split(left(b, 50000), chr(10)), lambda x: trim(x) = '' OR NOT (regexp_matches(trim(x), '(\.\s*){3,}\s*\d+\s*$') OR regexp_matches(trim(x), '^\s*\d+(\.\d+)+\s+[A-Za-z][^.]{5,100}\.\s*$') OR regexp_matches(trim(x), '^\s*\d+\s*\d+(\.\d+)+\s+[A-Za-z].{5,90}\.\s*$'))), chr(10))"
#: Names of the text files whose tables of contents are stripped; each case sets its own.
TOC_FILES = "judge_*"


@query(
    "S04_body_text",
    f"SELECT name, CASE WHEN starts_with(name, 'judge_') THEN {_TOC} ELSE left(b, 50000) END AS body FROM (SELECT CASE WHEN lower(trim(coalesce(s.content_type, ''))) = 'video' THEN 'judge_' ELSE 'text_' END || d.capture_id || '.txt' AS name, d.body || chr(10) AS b FROM {{bd}} d LEFT JOIN {{so}} s ON s.source_id = d.source_id)",
)
def s04(t: Tables):
    """Bodies written as text files under names of their own and read through the file reader: cut to the limit, and without
    tables of contents in the files of some names. Transcripts take such a name here."""
    kind = F.when(F.lower(F.trim(F.coalesce("content_type", F.lit("")))) == "video", "judge_").otherwise("text_")
    rows = t.bd.join(bounded(t.so.select("source_id", "content_type")), "source_id", "left").select(F.concat(kind, F.col("capture_id").cast("string"), F.lit(".txt")).alias("name"), "body")
    rows.write.mode("overwrite").partitionBy("name").text(_written(t, "files"))
    return R.text_files(t.spark, _written(t, "files"), TOC_FILES).select("name", "body")


def _page_sql() -> str:
    x = "'<html><nav>menu</nav><article><h1>' || coalesce(title, '') || '</h1><p>' || replace(text, '&', '&amp;') || '</p></article><script>x</script></html>'"
    for tag in P.DROPPED_TAGS:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '')"
    blocked = " OR ".join(["length(t) < 800", *[f"contains(lower(left(t, 2000)), '{p}')" for p in C.BLOCK_PHRASES]])
    return f"SELECT doc_id, {blocked} AS blocked, length(t)::INT AS n_chars, sha256(t) AS digest FROM (SELECT doc_id, left(array_to_string({lines}, chr(10)), 50000) AS t FROM documents)"


@query("S05_page_text", _page_sql())
def s05(t: Tables):
    html = F.concat(F.lit("<html><nav>menu</nav><article><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("</p></article><script>x</script></html>"))
    return R.page_text(t.documents.select("doc_id", html.alias("html")), "html").select("doc_id", "blocked", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


@query("S06_trust_type", "SELECT source_id, CASE coalesce(content_type, 'text') WHEN 'pdf' THEN 'peer_reviewed' WHEN 'video' THEN 'debate_transcript' WHEN 'audio' THEN 'debate_transcript' WHEN 'web' THEN 'journalism' ELSE 'essay_reflection' END AS source_type FROM {so}")
def s06(t: Tables):
    return t.so.select("source_id", R.trust_type().alias("source_type"))


_YT = r"(?:v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})"


@query(
    "S07_transcript_sources",
    rf"SELECT source_id, nullif(regexp_extract(url, '{_YT}', 1), '') AS video_id, lower(coalesce(content_type, '')) = 'video' AND coalesce(local_path, '') = '' AND regexp_matches(coalesce(url, ''), '{_YT}') AS is_transcript FROM {{so}}",
)
def s07(t: Tables):
    return t.so.select("source_id", R.video_id().alias("video_id"), R.is_transcript_source().alias("is_transcript"))


@query(
    "S07_transcript_texts",
    _RESOLVED + ", v AS (SELECT source_id, lower(trim(coalesce(content_type, ''))) AS kind, coalesce(nullif(title, ''), 'untitled') AS title, coalesce(url, '') AS url FROM {so}) SELECT k.source_id, 'Title: ' || v.title || chr(10) || 'URL: ' || v.url || chr(10) || chr(10) || left(k.body, 50000) AS text FROM k JOIN v ON v.source_id = k.source_id WHERE k.k = 1 AND k.fetch_error IS NULL AND v.kind IN ('video', 'audio')",
)
def s07_texts(t: Tables):
    """Transcripts fetched before, of video and audio sources, under their header lines; nothing is downloaded."""
    v = t.so.where(F.lower(F.trim(F.coalesce("content_type", F.lit("")))).isin("video", "audio"))
    return R.transcripts(bounded(v), R.resolved_bodies(t.raw_docs)).select("source_id", "text")


@query(
    "S08_bibliography",
    "SELECT s.source_id, s.bibliography, max(length(b.body)) AS n_chars, max(length(b.body) - length(replace(b.body, chr(10), '')) + 1) AS n_lines FROM {so} s JOIN {bd} b ON b.source_id = s.source_id WHERE s.bibliography IS NOT NULL GROUP BY ALL",
)
def s08(t: Tables):
    side = t.so.where("bibliography IS NOT NULL").select("source_id", "bibliography")
    return t.bd.join(bounded(side), "source_id").groupBy("source_id", "bibliography").agg(F.max(F.length("body")).cast("bigint").alias("n_chars"), F.max(F.size(F.split("body", "\n"))).cast("bigint").alias("n_lines"))


@query("S09_claims_of_case", "SELECT id, ord, case_name, status FROM {nd} WHERE type = 'claim' AND status = 'active'")
def s09(t: Tables):
    return t.nodes.where("type = 'claim' AND status = 'active'").select("id", "ord", "case_name", "status").distinct()


_ARTIFACT = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("claim_id", T.StringType()), T.StructField("n", T.LongType())])


@query("S10_artifact_directory", "SELECT source_id, count(*) AS n, row_number() OVER (ORDER BY sha256(source_id)) AS pos FROM attestations WHERE coalesce(source_id, '') <> '' AND source_id IN (SELECT source_id FROM sources) GROUP BY 1")
def s10(t: Tables):
    """An audit per source of the manifest as a JSON file, and one that can't be read; scanned in the order of file names."""
    rows = t.attestations.where("coalesce(source_id, '') <> ''").join(bounded(t.so.select("source_id")), "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("n"))
    files = {r["name"]: r["text"] for r in rows.select(F.concat(F.sha2("source_id", 256), F.lit(".json")).alias("name"), F.to_json(F.struct("source_id", "n")).alias("text")).collect()}  # a row per source of the manifest
    W.put_files(t.spark, _written(t, "audits"), {**files, "broken.json": "{not json"})
    found = R.artifacts(t.spark, _written(t, "audits"), _ARTIFACT)
    return found.withColumn("pos", F.row_number().over(Window.orderBy("file")).cast("bigint")).select("source_id", "n", "pos")  # of fixed size


_CENTRAL = "WITH o AS (SELECT src, count(*) AS n, count(*) FILTER (WHERE type = 'presupposes') AS p FROM {ge} GROUP BY 1), ce AS (SELECT n.id, n.ord, coalesce(o.n, 0) + 2.0::DOUBLE * coalesce(o.p, 0) + 3.0::DOUBLE * coalesce(n.evidential_weight, 0) + CASE WHEN coalesce(specificity_score < 0.3, false) OR NOT coalesce(quote_grounded, false) OR coalesce(polarity_risk IN ('high', 'conflict'), false) THEN 2.0 ELSE 0.0 END AS c FROM {nd} n LEFT JOIN o ON o.src = n.id WHERE n.type = 'claim') "


@query("S11_reasoning_artifacts", _CENTRAL + "SELECT id AS claim_id, row_number() OVER (ORDER BY c DESC, ord, id) AS n FROM ce ORDER BY c DESC, ord, id LIMIT 20")
def s11(t: Tables):
    """Artifacts of the twenty ranked claims; every other one leaves its claim_id to the stem of its file."""
    top = K.centrality(relations.reviewed_nodes(t), t.ge).orderBy(F.desc("centrality"), "ord", "id").limit(C.DEFAULT.max_ranked).collect()
    files = {f"{r['id']}.json": json.dumps({"n": k, **({"claim_id": r["id"]} if k % 2 else {})}) for k, r in enumerate(top, 1)}
    W.put_files(t.spark, _written(t, "reasoning"), files)
    return R.artifacts(t.spark, _written(t, "reasoning"), _ARTIFACT, key="claim_id").select("claim_id", "n")


@query("S12_demo_sources", "SELECT source_id, title FROM {so} ORDER BY source_id LIMIT 3")
def s12(t: Tables):
    return t.so.orderBy("source_id").limit(3).select("source_id", "title")


@query("S13_optional_artifact", "SELECT source_id, n FROM (SELECT '' AS source_id, CAST(0 AS BIGINT) AS n) WHERE false")
def s13(t: Tables):
    return R.optional_table(t.spark, t.dir + "/no_such_artifact.parquet", _ARTIFACT).select("source_id", "n")


@query("K01_graph_sink", "SELECT type, count(*) AS n FROM {nd} GROUP BY 1")
def k01(t: Tables):
    W.write_table(t.nd("type", "content", "case_name", "subfield"), _written(t, "graph"), "type")
    return t.spark.read.parquet(_written(t, "graph")).groupBy(F.col("type").cast("string").alias("type")).agg(F.count("*").alias("n"))


def _sink(name: str, artifact: str, of: str):
    """One compiled artifact written as JSON and read back: the rows of the query it is compiled by."""

    def run(t: Tables):
        df = QUERIES[of](t.spark, t.dir)
        W.export_json(df, _written(t, artifact))
        return t.spark.read.schema(df.schema).json(_written(t, artifact))

    SINKS[name] = (run, of)


SINKS: dict = {}
_sink("K02_propositions_sink", "propositions", "A08_propositions")
_sink("K02_alignment_sink", "alignment", "A11_alignment_summary")
_sink("K02_importance_sink", "importance", "A12_source_importance")
_sink("K02_debate_sink", "debate_state", "J08_debate_state")
_sink("K02_cross_links_sink", "cross_links", "A15_links_by_subfield")
_sink("K02_roles_sink", "source_roles", "F19_source_roles")


def register_sinks() -> None:
    """Called when the compiling queries are there; a sink has their SQL."""
    for name, (run, of) in SINKS.items():
        if name not in QUERIES:
            query(name)(run)
            ORACLE[name] = ORACLE[of]


@query("K03_memo_key", "SELECT id, substr(sha256(id || '::v2'), 1, 16) AS memo_key FROM {nd}")
def k03(t: Tables):
    return t.nd().select("id", W.memo_key(F.col("id")).alias("memo_key"))


@query("K04_content_hash", "SELECT id, substr(sha256('{\"content\":' || to_json(coalesce(content, '')) || ',\"type\":' || to_json(type) || '}'), 1, 12) AS hash FROM {nd}")
def k04(t: Tables):
    return t.nd("type", "content").withColumn("content", F.coalesce("content", F.lit(""))).select("id", W.content_hash("type", "content").alias("hash"))


@query("K05_contradiction_export", "SELECT src, dst, round(strength, 3) AS sim FROM {ge} WHERE type = 'contradicts'")
def k05(t: Tables):
    W.export_csv(t.ge.where("type = 'contradicts'").select("src", "dst", F.round("strength", 3).alias("sim")), _written(t, "pairs"))
    return t.spark.read.option("header", True).schema("src string, dst string, sim double").csv(_written(t, "pairs"))


# The sections of a report in order.
SECTIONS = ("Question Map", "Central Conditional Structure", "Non-thematized Presuppositions", "Semantic Map", "Real Cruxes", "Evidence Independence", "Critical Gaps", "Rhetoric Flags", "New Knowledge Generated", "System's Own Presuppositions")
_COUNTS = (
    "count(*) FILTER (WHERE type = 'question')", "count(*) FILTER (WHERE type = 'claim')", "count(*) FILTER (WHERE type = 'presupposition')", "count(DISTINCT nullif(trim(subfield), ''))", "count(DISTINCT CASE WHEN type = 'claim' THEN nullif(trim(key_question), '') END)",
    "count(DISTINCT nullif(source_id, ''))", "count(*) FILTER (WHERE type = 'gap')", "count(*) FILTER (WHERE claim_type = 'dismissal')", "count(*) FILTER (WHERE status = 'corroborated')", "count(*) FILTER (WHERE status = 'archived')",
)
_BODYSQL = " || chr(10) || chr(10) || ".join(f"'## {k}. {title.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || 'Counted: ' || {c}" for k, (title, c) in enumerate(zip(SECTIONS, _COUNTS), 1))


@query("K06_report_markdown", f"SELECT case_name AS report_id, {_BODYSQL} || chr(10) || chr(10) || '---' || chr(10) || chr(10) || count(*) FILTER (WHERE quote_grounded) || ' of ' || count(*) || ' nodes are grounded.' AS markdown FROM {{nd}} GROUP BY 1")
def k06(t: Tables):
    """The ten sections of a report per case, each with what the graph counts for it, and the note on provenance."""
    n = t.nd("case_name", "type", "subfield", "key_question", "source_id", "claim_type", "status", "quote_grounded")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    distinct = lambda c: F.count_distinct(F.nullif(F.trim(c), F.lit("")))
    counts = [is_("type", "question"), is_("type", "claim"), is_("type", "presupposition"), distinct("subfield"), F.count_distinct(F.when(F.col("type") == "claim", F.nullif(F.trim("key_question"), F.lit("")))), F.count_distinct(F.nullif("source_id", F.lit(""))), is_("type", "gap"), is_("claim_type", "dismissal"), is_("status", "corroborated"), is_("status", "archived")]
    row = n.groupBy("case_name").agg(*[c.alias(f"c{k}") for k, c in enumerate(counts)], F.count("*").alias("n"), F.count_if("quote_grounded").alias("grounded"))
    parts = F.array(*[F.struct(F.lit(k + 1).alias("no"), F.lit(title).alias("title"), F.concat(F.lit("Counted: "), F.col(f"c{k}").cast("string")).alias("body")) for k, title in enumerate(SECTIONS)])
    sections = row.select(F.col("case_name").alias("report_id"), F.explode(parts).alias("s")).select("report_id", "s.*")
    note = row.select(F.col("case_name").alias("report_id"), F.concat(F.col("grounded").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" nodes are grounded.")).alias("note"))
    return W.report(sections, note)
