"""X: text, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave import config as C
from claimweave.functions import text as X
from claimweave.operators import chunks as H
from claimweave.plans import filters, joins
from claimweave.plans.registry import Tables, query
from claimweave.runtime import bounded
from claimweave.sources import readers as R


@query("X01_matching_form", f"SELECT id, {filters._NORM('quote_exact')} AS form FROM {{nd}} WHERE quote_exact IS NOT NULL")
def x01(t: Tables):
    return t.nd("quote_exact").where("quote_exact IS NOT NULL").select("id", X.matching_form(F.col("quote_exact")).alias("form"))


@query("X02_collapsed", f"SELECT id, {filters._FLAT('content')} AS form FROM {{nd}} WHERE content IS NOT NULL")
def x02(t: Tables):
    return t.nd("content").where("content IS NOT NULL").select("id", X.collapsed_lower(F.col("content")).alias("form"))


@query("X03_token_sets", f"SELECT id, array_to_string(list_sort({joins._tok('content')}), ' ') AS tokens FROM {{nd}} WHERE content IS NOT NULL")
def x03(t: Tables):
    return t.nd("content").where("content IS NOT NULL").select("id", F.array_join(F.array_sort(X.token_set(F.col("content"), C.STOP_WORDS)), " ").alias("tokens"))


@query("X04_stance_tokens", rf"SELECT id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(content), '\b[a-z][a-z0-9-]*\b')), lambda w: length(w) >= 3 AND NOT list_contains({joins._stops(C.STANCE_STOP_WORDS)}, w))), ' ') AS tokens FROM {{nd}} WHERE content IS NOT NULL")
def x04(t: Tables):
    return t.nd("content").where("content IS NOT NULL").select("id", F.array_join(F.array_sort(X.stance_tokens(F.col("content"))), " ").alias("tokens"))


@query("X05_slugs", r"SELECT source_id, left(regexp_replace(regexp_replace(lower(source_id), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48) AS slug, 'cross-' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(coalesce(nullif(title, ''), 'uncategorized')), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 56), ''), 'other') AS anchor, left(translate(source_id, '/\:', '___'), 80) AS file FROM {so}")
def x05(t: Tables):
    return t.so.select("source_id", X.slug(F.col("source_id")).alias("slug"), X.anchor_slug(F.col("title")).alias("anchor"), X.file_safe(F.col("source_id")).alias("file"))


@query("X06_shared_questions", r"SELECT src, dst, type, coalesce(nullif(trim(shared_question), ''), trim(regexp_extract(rationale, '\(shared question:\s*(.*)\)\s*$', 1)), '') AS q FROM {rl}")
def x06(t: Tables):
    return t.rl.select("src", "dst", "type", X.shared_question(F.col("shared_question"), F.col("rationale")).alias("q"))


_IDS = r"list_distinct(list_concat(regexp_extract_all(lower(x), '\b(gap_[a-f0-9]{8})\b', 1), regexp_extract_all(lower(x), '\b(claim_[a-f0-9]{8})\b', 1), regexp_extract_all(lower(x), '\b(theme_\d{2})\b', 1), list_filter(regexp_extract_all(lower(x), '(?:^|[^a-z])([a-f0-9]{8})(?:$|[^a-z0-9])', 1), lambda i: regexp_matches(i, '[a-f]'))))"


@query("X07_cited_ids", f"SELECT src, rel_ord, count(DISTINCT i) AS n FROM (SELECT src, rel_ord, unnest({_IDS}) AS i FROM (SELECT src, rel_ord, '[' || src || '] and gap_' || dst || ', theme_07; 12345678' AS x FROM {{rl}})) GROUP BY 1, 2")
def x07(t: Tables):
    text = F.concat(F.lit("["), "src", F.lit("] and gap_"), "dst", F.lit(", theme_07; 12345678"))
    return t.rl.select("src", "rel_ord", F.explode(X.cited_ids(text)).alias("i")).groupBy("src", "rel_ord").agg(F.count_distinct("i").alias("n"))


@query("X08_repaired_quotes")
def x08(t: Tables):
    n = t.nd("quote_exact", "textual_evidence").where("quote_exact IS NOT NULL AND textual_evidence IS NOT NULL")
    return n.select("id", X.repaired(F.col("quote_exact"), F.col("textual_evidence")).alias("quote"))


@query("X09_summaries", r"SELECT id, CASE WHEN length(f) <= 120 THEN f ELSE regexp_replace(left(f, 119), '\s+\S*$', '') || '…' END AS line FROM (SELECT id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS f FROM {nd} WHERE content IS NOT NULL)")
def x09(t: Tables):
    return t.nd("content").where("content IS NOT NULL").select("id", X.summary_line(F.col("content")).alias("line"))


@query("X10_escaped", "SELECT id, replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS html FROM {nd} WHERE content IS NOT NULL")
def x10(t: Tables):
    return t.nd("content").where("content IS NOT NULL").select("id", X.escaped(F.col("content")).alias("html"))


_ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
_WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"
_BLOCK = (
    f"CASE WHEN starts_with(p, '## ') THEN '<h3 class=\"briefing-h3\">' || {_ESC(f'trim(substr(p, 4), {_WHITE})')} || '</h3>' WHEN starts_with(p, '# ') THEN '<h2 class=\"briefing-h2\">' || {_ESC(f'trim(substr(p, 3), {_WHITE})')} || '</h2>' "
    f"ELSE '<p class=\"briefing-p\">' || array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: {_ESC(f'trim(x, {_WHITE})')}), lambda x: x <> ''), ' ') || '</p>' END"
)


@query("X10_briefing_html", f"SELECT doc_id, CASE WHEN h = '' THEN '<p class=\"briefing-p\">' || {_ESC('t')} || '</p>' ELSE h END AS html FROM (SELECT doc_id, t, array_to_string(list_transform(list_filter(list_transform(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda p: trim(p, {_WHITE})), lambda p: p <> ''), lambda p: {_BLOCK}), '') AS h FROM (SELECT doc_id, '# ' || coalesce(title, '') || chr(10) || chr(10) || text AS t FROM documents))")
def x10_briefing(t: Tables):
    """Documents under their titles as briefing pages."""
    return t.documents.select("doc_id", X.briefing_html(F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), "text")).alias("html"))


@query("X10_badges", f"SELECT id, '<span class=\"badge b-ok\">' || {_ESC('status')} || '</span>' AS html FROM {{nd}} WHERE status IS NOT NULL")
def x10_badges(t: Tables):
    return t.nd("status").where("status IS NOT NULL").select("id", X.badge_html(F.col("status"), F.lit("b-ok")).alias("html"))


@query("X11_short_names", "SELECT source_id, list_last(string_split(source_id, '/')) AS name FROM {so}")
def x11(t: Tables):
    return t.so.select("source_id", F.substring_index("source_id", "/", -1).alias("name"))


@query("X12_section_numbers", r"SELECT capture_id, try_cast(nullif(regexp_extract(s, '^\s*(\d+)\.', 1), '') AS INT) AS no, count(*) AS n FROM (SELECT capture_id, unnest(string_split(body, chr(10))) AS s FROM {bd}) GROUP BY 1, 2")
def x12(t: Tables):
    lines = t.bd.select("capture_id", F.explode(F.split("body", "\n")).alias("s"))
    return lines.groupBy("capture_id", X.section_number(F.col("s")).alias("no")).agg(F.count("*").alias("n"))


@query("X13_audit_texts")
def x13(t: Tables):
    s = bounded(t.so.select("source_id", "publication_status"))
    text = X.audit_text(F.col("body"), F.coalesce("publication_status", F.lit("")))
    return t.bd.join(s, "source_id", "left").select("capture_id", text.alias("x")).select("capture_id", F.length("x").alias("n_chars"), F.sha2("x", 256).alias("digest"))


@query("X14_clips", "SELECT id, left(coalesce(content, ''), 300) AS content, left(coalesce(textual_evidence, ''), 200) AS evidence FROM {nd}")
def x14(t: Tables):
    return t.nd("content", "textual_evidence").select("id", F.substring(F.coalesce("content", F.lit("")), 1, 300).alias("content"), F.substring(F.coalesce("textual_evidence", F.lit("")), 1, 200).alias("evidence"))


@query("X16_source_labels", "SELECT source_id, coalesce(nullif(title, ''), nullif(author, ''), nullif(local_path, ''), nullif(url, ''), 'untitled') AS label FROM {so}")
def x16(t: Tables):
    return t.so.select("source_id", R.source_label().alias("label"))


@query("X17_inquiry_context", "SELECT case_name, 'Case: ' || case_name || chr(10) || 'Central questions: ' || array_to_string(central_questions[1:4], '; ') || chr(10) || 'Subfields: ' || array_to_string(subfields[1:8], ', ') || chr(10) || 'Debate positions: ' || array_to_string(debate_positions[1:3], '; ') AS context FROM case_profiles")
def x17(t: Tables):
    part = lambda name, c, n, sep: F.concat(F.lit(name), F.array_join(F.slice(c, 1, n), sep))
    return t.case_profiles.select("case_name", F.concat_ws("\n", F.concat(F.lit("Case: "), "case_name"), part("Central questions: ", "central_questions", 4, "; "), part("Subfields: ", "subfields", 8, ", "), part("Debate positions: ", "debate_positions", 3, "; ")).alias("context"))


@query("X18_sample_texts", "SELECT source_id, left(string_agg('--- ' || capture_id || ' ---' || chr(10) || left(body, 4000), chr(10) || chr(10) ORDER BY capture_id), 12000) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY capture_id) AS k FROM {bd}) WHERE k <= 4 GROUP BY 1")
def x18(t: Tables):
    from pyspark.sql import Window

    b = t.bd.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("capture_id"))).where("k <= 4")
    part = F.concat(F.lit("--- "), F.col("capture_id").cast("string"), F.lit(" ---\n"), F.substring("body", 1, 4000))
    rows = b.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("capture_id", part.alias("p")))).alias("a"))  # at most 4 per source
    return rows.select("source_id", F.substring(F.array_join(F.transform("a", lambda x: x["p"]), "\n\n"), 1, 12_000).alias("sample"))


@query("X20_norms", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm FROM embeddings")
def x20(t: Tables):
    return t.embeddings.select("vec_id", F.round(X.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query("X21_hashed_vectors")
def x21(t: Tables):
    """Vectors without a model: hashed, idf-weighted and normalised word counts; one row per document with its norm."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    d = t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1).alias("words"))
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 10).transform(d)
    v = Normalizer(inputCol="w", outputCol="v").transform(IDF(inputCol="tf", outputCol="w").fit(tf).transform(tf))
    a = vector_to_array("v")
    return v.select("doc_id", F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.size(F.filter(a, lambda x: x != 0)).alias("n_features"))


@query("X22_sequence_ratio")
def x22(t: Tables):
    n = t.nd("textual_evidence", "quote_exact").where("textual_evidence <> quote_exact")
    return n.select("id", X.sequence_ratio(F.col("quote_exact"), F.col("textual_evidence")).alias("ratio"))


@query("X23_rounding", "SELECT id, CASE WHEN evidential_weight IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, evidential_weight)) END AS clamped, floor((round(specificity_score * 1000) + 5) / 10) / 100 AS two FROM {nd}")
def x23(t: Tables):
    w = F.col("evidential_weight")
    return t.nd("evidential_weight", "specificity_score").select("id", F.when(w.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), w))).alias("clamped"), (F.floor((F.round(F.col("specificity_score") * 1000) + 5) / 10) / 100).alias("two"))


@query("X24_array_functions", "SELECT case_name, len(list_distinct(list_concat(key_entities, subfields))) AS n_union, len(list_intersect(key_entities, subfields)) AS n_both, array_to_string(subfields[1:2], '|') AS head FROM case_profiles")
def x24(t: Tables):
    return t.case_profiles.select("case_name", F.size(F.array_union("key_entities", "subfields")).cast("bigint").alias("n_union"), F.size(F.array_intersect("key_entities", "subfields")).cast("bigint").alias("n_both"), F.array_join(F.slice("subfields", 1, 2), "|").alias("head"))


@query("X25_edge_type_maps", "SELECT src, string_agg(type || '=' || n, ',' ORDER BY type) AS kinds FROM (SELECT src, type, count(*) AS n FROM {ge} GROUP BY 1, 2) GROUP BY 1")
def x25(t: Tables):
    n = t.ge.groupBy("src", "type").agg(F.count("*").alias("n"))
    m = n.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("m"))  # at most ten types
    part = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("src", F.array_join(part, ",").alias("kinds"))


@query("X26_json_responses", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'object' WHEN 2 THEN 'list' ELSE 'parse_error' END AS kind, CASE WHEN event_id % 4 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def x26(t: Tables):
    """Answers fenced, bare, as a list and cut off, read alike."""
    e = F.col("event_id") % 4
    said = F.when(e == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(e == 1, F.col("props")).when(e == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit("```\n"), F.substring("props", 1, 4)))
    kind, bare = X.parsed_json(said)
    return t.events.select("event_id", kind.alias("kind"), F.when(kind == "object", F.from_json(bare, "k bigint")["k"]).alias("k"))


_OFF = "CASE att_ord % 3 WHEN 0 THEN '[5, 40.0, 12]' WHEN 1 THEN '[5.5]' ELSE '[true]' END"


@query("X27_offsets", f"SELECT node_id, att_ord, regexp_matches(o, '^\\s*\\[\\s*(-?\\d+(\\.0+)?\\s*(,\\s*-?\\d+(\\.0+)?\\s*)*)?\\]\\s*$') AS valid, count(*) AS n FROM (SELECT *, {_OFF} AS o FROM attestations) GROUP BY ALL")
def x27(t: Tables):
    o = F.when(F.col("att_ord") % 3 == 0, "[5, 40.0, 12]").when(F.col("att_ord") % 3 == 1, "[5.5]").otherwise("[true]")
    return t.attestations.groupBy("node_id", "att_ord", H.valid_offsets(o).isNotNull().alias("valid")).agg(F.count("*").alias("n"))


@query("X28_pieces", "WITH e AS (SELECT capture_id, body, list_sort(list_distinct(list_filter([0, 100, 350, 1000, length(body)], lambda x: x <= length(body)))) AS e FROM {bd} WHERE length(body) > 0) SELECT capture_id, len(list_filter(list_transform(generate_series(1, len(e) - 1), lambda i: trim(substr(body, e[i] + 1, e[i + 1] - e[i]))), lambda p: p <> ''))::BIGINT AS n FROM e")
def x28(t: Tables):
    o = F.array(*[F.lit(x).cast("bigint") for x in (350, 100, 1000, 100)])
    return t.bd.where("length(body) > 0").select("capture_id", F.size(H.pieces(F.col("body"), o)).cast("bigint").alias("n"))


@query("X29_blocks")
def x29(t: Tables):
    b = H.blocks(t.bd, C.DEFAULT.chunk_chars)
    return b.select("capture_id", F.col("idx").cast("bigint").alias("idx"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


_P = "list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(12) || chr(13))), lambda p: p <> '')"


@query("X30_halves", f"SELECT capture_id, length(CASE WHEN len(p) >= 2 THEN array_to_string(p[1:len(p) // 2], chr(10) || chr(10)) ELSE left(body, length(body) // 2) END) AS n_left FROM (SELECT capture_id, body, {_P} AS p FROM {{bd}})")
def x30(t: Tables):
    return t.bd.select("capture_id", F.length(H.halves(F.col("body"))[0]).cast("bigint").alias("n_left"))


@query("X32_n_needed", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN 'TBD' WHEN 2 THEN json_extract_string(props, '$.k') ELSE '' END AS n FROM events")
def x32(t: Tables):
    """The sample size a study asks for, given as an object with or without a value, as a number, or not at all."""
    e, k = F.col("event_id") % 4, F.get_json_object("props", "$.k")
    study = F.when(e == 0, F.concat(F.lit('{"n_needed": {"value": '), k, F.lit("}}"))).when(e == 1, F.lit('{"n_needed": {"why": "open"}}')).when(e == 2, F.concat(F.lit('{"n_needed": '), k, F.lit("}"))).otherwise(F.lit("{}"))
    return t.events.select("event_id", X.n_needed(study).alias("n"))


@query("X32_grounding_list", filters._PARAM + "SELECT node_id, string_agg(DISTINCT att_ord || ': ' || new, '; ' ORDER BY att_ord || ': ' || new) AS needs FROM r WHERE new = 'ungrounded' GROUP BY 1")
def x32_list(t: Tables):
    """Per node the parameters that need justification."""
    p = filters.parameters(t).where("grounding = 'ungrounded'").select("node_id", F.concat(F.col("att_ord").cast("string"), F.lit(": "), "grounding").alias("x"))
    return p.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("x")), "; ").alias("needs"))


@query("X33_first_quotes", "WITH a AS (SELECT node_id, quote FROM (SELECT node_id, quote, row_number() OVER (PARTITION BY node_id ORDER BY att_ord, quote) AS k FROM attestations WHERE coalesce(trim(quote), '') <> '') WHERE k = 1) SELECT n.id, coalesce(nullif(textual_evidence, ''), nullif(quote_exact, ''), a.quote) AS quote FROM {nd} n LEFT JOIN a ON a.node_id = n.id")
def x33(t: Tables):
    a = t.attestations.where("coalesce(trim(quote), '') <> ''").groupBy(F.col("node_id").alias("id")).agg(F.min(F.struct("att_ord", "quote")).alias("a")).select("id", F.col("a.quote").alias("q"))
    return t.nd("textual_evidence", "quote_exact").join(a, "id", "left").select("id", F.coalesce(F.nullif("textual_evidence", F.lit("")), F.nullif("quote_exact", F.lit("")), "q").alias("quote"))
