"""The queries of this subpackage, by problem, over the whole tables with production parameters; and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import clusters, components, looks, mixing, neardup, packing, splitting, survivors, truncation
from claimweave.runtime import stash, table


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, sf_dir, "nodes"), "id", "content")


def _members(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """Members of p2_found's groups, which take only links of classes, not of ids."""
    groups = survivors.groups_of(*_near(spark, sf_dir))
    return survivors.group_members(groups, table(spark, sf_dir, "nodes") if nodes is None else nodes, table(spark, sf_dir, "attestations"))


def p1_found(spark, sf_dir):
    return survivors.survivors(_members(spark, sf_dir)).select("group_id", "content_id", "weight_id")


def p1_survivors(spark, sf_dir):
    return survivors.merged_records(_members(spark, sf_dir), table(spark, sf_dir, "nodes"), table(spark, sf_dir, "attestations"))


def p1_attestations(spark, sf_dir):
    return survivors.kept_attestations(_members(spark, sf_dir), table(spark, sf_dir, "attestations"))


def p1_transitions(spark, sf_dir):
    """What the currency reasoning learns from: transitions of values within groups, with the number of groups."""
    rows = stash(_members(spark, sf_dir), "moves")
    of = lambda a: survivors.transitions(rows, "group_id", "created_at", a).select(F.lit(a).alias("attribute"), "old", "new", "n")
    return of("status").unionByName(of("epistemic_status"))


def p1_undated(spark, sf_dir):
    """The current record of each group where only grounded records keep their timestamps: the others are placed by reasoning."""
    nodes = table(spark, sf_dir, "nodes").withColumn("created_at", F.when(F.col("quote_grounded"), F.col("created_at")))
    return survivors.survivors(_members(spark, sf_dir, nodes)).select("group_id", "size", "value_id")


def p2_found(spark, sf_dir):
    return neardup.id_pairs(*_near(spark, sf_dir))


def p2_documents(spark, sf_dir):
    return neardup.documents_with_links(*_near(spark, sf_dir))


def p3_found(spark, sf_dir):
    return clusters.similarity_clusters(table(spark, sf_dir, "nodes"), "id", "content").where("size >= 3").select("id", "cluster_id")


def p3_typical(spark, sf_dir):
    nodes = table(spark, sf_dir, "nodes")
    labels = nodes.select("id", F.nullif(F.lower(F.trim("subfield")), F.lit("")).alias("label"))
    return clusters.described(stash(clusters.similarity_clusters(nodes, "id", "content"), "typical"), labels)


def p4_found(spark, sf_dir):
    return splitting.run(spark, sf_dir).where("node <> 'piece'").select("capture_id", F.col("no").alias("para_no"))


def p4_pieces(spark, sf_dir):
    return splitting.run(spark, sf_dir).where("node = 'piece'").select("capture_id", F.col("no").alias("piece_no"), "n_chars", "repeated", "piece")


def p4_rejoined(spark, sf_dir):
    return splitting.rejoined(splitting.run(spark, sf_dir))


def p5_found(spark, sf_dir):
    return looks.alike_but_different(table(spark, sf_dir, "nodes"), "id", "textual_evidence", "quote_exact")


def p5_forms(spark, sf_dir):
    forms = looks.normalised(table(spark, sf_dir, "nodes"), ["textual_evidence", "quote_exact"], ["id"])
    return forms.select("id", F.col("textual_evidence_form").alias("textual_evidence"), F.col("quote_exact_form").alias("quote_exact"), "textual_evidence_key", "quote_exact_key")


def p6_found(spark, sf_dir):
    return components.same_as_groups(table(spark, sf_dir, "relations"), table(spark, sf_dir, "nodes"))


def _packed(spark, sf_dir):
    return packing.packed(packing.items_of(table(spark, sf_dir, "documents")))


def p7_found(spark, sf_dir):
    return _packed(spark, sf_dir).where("n_pieces > 1").select("doc_id").distinct()


def p7_containers(spark, sf_dir):
    return _packed(spark, sf_dir).select("doc_id", "piece", "n_tokens", "container_id")


def p7_waste(spark, sf_dir):
    one = _packed(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_items"))
    return one.agg(F.count("*").alias("containers"), F.sum("n_items").alias("items"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("fullest"), F.round(1 - F.sum("n_tokens") / (F.count("*") * packing.CAPACITY), 6).alias("wasted"))


def p7_checked(spark, sf_dir):
    return packing.checked(_packed(spark, sf_dir))


def p7_room(spark, sf_dir):
    """Whether less than 2 % of the room of all containers is unused."""
    return p7_waste(spark, sf_dir).select((F.col("wasted") < 0.02).alias("little_wasted"))


def _mixed(spark, sf_dir):
    counted = mixing.counted_documents(table(spark, sf_dir, "documents"))
    plan = mixing.source_plan(counted, table(spark, sf_dir, "mix_targets"))
    return mixing.mix(counted, plan), plan


def p8_found(spark, sf_dir):
    return mixing.shares(*_mixed(spark, sf_dir)).where("short").select("source")


def p8_uses(spark, sf_dir):
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark, sf_dir):
    return mixing.shares(*_mixed(spark, sf_dir)).withColumn("actual_share", F.round("actual_share", 6))


def p8_checked(spark, sf_dir):
    return mixing.checked(*_mixed(spark, sf_dir))


def p9_found(spark, sf_dir):
    return truncation.judged(table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p9_rates(spark, sf_dir):
    return truncation.rates(truncation.judged(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_WORDS = """
words AS (
    SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '[a-z]{{4,}}')) AS w
    FROM (SELECT DISTINCT id, content FROM nodes WHERE id IS NOT NULL)
), sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id),
shared AS (
    SELECT a.id AS x, b.id AS y, count(*) AS k FROM words a JOIN words b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id
), pairs AS (
    SELECT x, y FROM shared JOIN sizes s ON s.id = x JOIN sizes t ON t.id = y WHERE k >= {t} * (s.n + t.n - k) - 1e-9
)"""

_REACH = """
links AS (SELECT x AS a, y AS b FROM pairs UNION SELECT y, x FROM pairs),
reach(a, g) AS (SELECT a, a FROM links UNION SELECT l.b, r.g FROM reach r JOIN links l ON l.a = r.a AND r.g < l.b),
comps AS (SELECT a AS id, min(g) AS group_id FROM reach GROUP BY a)"""

ORACLE = {
    "p2_found": "WITH" + _WORDS.format(t=0.7) + " SELECT x AS id_a, y AS id_b FROM pairs",
    "p1_found": "WITH RECURSIVE" + _WORDS.format(t=0.7) + "," + _REACH + """,
one AS (SELECT DISTINCT id, content, evidential_weight AS w, created_at FROM nodes),
src AS (
    SELECT node_id AS id, count(DISTINCT regexp_replace(source_id, '^\\s+|\\s+$', '', 'g')) AS n FROM attestations
    WHERE regexp_replace(source_id, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY node_id
), rows AS (
    SELECT c.group_id, c.id, length(trim(regexp_replace(o.content, '\\s+', ' ', 'g'))) AS len, o.created_at,
           coalesce(s.n, 0) AS n, coalesce(o.w BETWEEN 0 AND 1, false) AS ok
    FROM comps c JOIN one o ON o.id = c.id LEFT JOIN src s ON s.id = c.id
), best AS (
    SELECT group_id, id AS content_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY len DESC, created_at DESC, id) AS k FROM rows) WHERE k = 1
), heavy AS (
    SELECT group_id, id AS weight_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, created_at DESC, id) AS k FROM rows WHERE ok) WHERE k = 1
) SELECT b.group_id, content_id, weight_id FROM best b LEFT JOIN heavy h ON h.group_id = b.group_id""",
    "p1_survivors": "WITH RECURSIVE" + _WORDS.format(t=0.7) + "," + _REACH + """,
one AS (SELECT DISTINCT id, content, evidential_weight AS w, created_at, nullif(trim(status), '') AS status, nullif(trim(epistemic_status), '') AS epistemic_status FROM nodes),
att AS (SELECT c.group_id, a.node_id, regexp_replace(a.source_id, '^\\s+|\\s+$', '', 'g') AS s, regexp_replace(a.quote, '^\\s+|\\s+$', '', 'g') AS q FROM attestations a JOIN comps c ON c.id = a.node_id),
src AS (SELECT node_id AS id, count(DISTINCT s) AS n FROM att WHERE s <> '' GROUP BY 1),
rows AS (
    SELECT c.group_id, o.*, length(trim(regexp_replace(o.content, '\\s+', ' ', 'g'))) AS len, coalesce(s.n, 0) AS n, coalesce(o.w BETWEEN 0 AND 1, false) AS ok
    FROM comps c JOIN one o ON o.id = c.id LEFT JOIN src s ON s.id = c.id
), best AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY len DESC, created_at DESC, id) AS k FROM rows),
heavy AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, created_at DESC, id) AS k FROM rows WHERE ok),
late AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY created_at DESC, id) AS k, count(*) OVER (PARTITION BY group_id) AS size FROM rows),
kept AS (SELECT group_id, count(*) AS n_attestations, count(DISTINCT nullif(s, '')) AS n_sources FROM (SELECT DISTINCT group_id, s, q FROM att) GROUP BY 1)
SELECT b.group_id, l.size, b.content, h.w AS evidential_weight, l.status, l.epistemic_status, l.created_at AS current_at, coalesce(k.n_attestations, 0) AS n_attestations, coalesce(k.n_sources, 0) AS n_sources
FROM best b JOIN late l ON l.group_id = b.group_id AND l.k = 1 LEFT JOIN heavy h ON h.group_id = b.group_id AND h.k = 1 LEFT JOIN kept k ON k.group_id = b.group_id WHERE b.k = 1""",
    "p1_attestations": "WITH RECURSIVE" + _WORDS.format(t=0.7) + "," + _REACH + """
SELECT DISTINCT c.group_id, regexp_replace(a.source_id, '^\\s+|\\s+$', '', 'g') AS source_id, a.author, a.source_date, a.quote, a.source_type FROM attestations a JOIN comps c ON c.id = a.node_id""",
    "p1_transitions": "WITH RECURSIVE" + _WORDS.format(t=0.7) + "," + _REACH + """,
v AS (
    SELECT c.group_id AS g, 'status' AS attribute, nullif(trim(n.status), '') AS v, n.created_at AS t FROM comps c JOIN nodes n ON n.id = c.id
    UNION ALL SELECT c.group_id, 'epistemic_status', nullif(trim(n.epistemic_status), ''), n.created_at FROM comps c JOIN nodes n ON n.id = c.id
), span AS (SELECT g, attribute, v, min(t) AS lo, max(t) AS hi FROM v WHERE v IS NOT NULL AND t IS NOT NULL GROUP BY ALL)
SELECT a.attribute, a.v AS old, b.v AS new, count(*) AS n FROM span a JOIN span b ON a.g = b.g AND a.attribute = b.attribute AND a.hi < b.lo GROUP BY ALL""",
    "p2_documents": "WITH" + _WORDS.format(t=0.7) + """,
sets AS (SELECT id, list_sort(list(w)) AS s FROM words GROUP BY id),
classes AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM sets),
linked AS (SELECT a.class_id AS a, b.class_id AS b FROM pairs JOIN classes a ON a.id = x JOIN classes b ON b.id = y WHERE a.class_id <> b.class_id),
degree AS (SELECT a AS class_id, count(DISTINCT b) AS n FROM (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked) GROUP BY 1)
SELECT c.id, c.class_id, c.copies, coalesce(d.n, 0) AS n_links FROM classes c LEFT JOIN degree d ON d.class_id = c.class_id""",
    "p3_found": "WITH RECURSIVE" + _WORDS.format(t=0.3) + "," + _REACH + """
SELECT id, group_id AS cluster_id FROM comps WHERE group_id IN (SELECT group_id FROM comps GROUP BY group_id HAVING count(*) >= 3)""",
    "p4_found": """
WITH body AS (
    SELECT capture_id, trim(replace(body, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS t FROM raw_docs
), big AS (SELECT * FROM body WHERE length(t) > 4000),
paras AS (
    SELECT capture_id, unnest(string_split_regex(t, '\\n[ \\t\\r\\f]*(\\n[ \\t\\r\\f]*)+')) AS p, generate_subscripts(string_split_regex(t, '\\n[ \\t\\r\\f]*(\\n[ \\t\\r\\f]*)+'), 1) AS no FROM big
)
SELECT capture_id, CAST(0 AS INTEGER) AS para_no FROM big
UNION ALL
SELECT capture_id, CAST(no AS INTEGER) FROM paras WHERE length(trim(p, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) > 4000""",
    "p4_rejoined": """
SELECT capture_id, length(t) AS n_chars, md5(t) AS digest, true AS fits, true AS repeats FROM (
    SELECT capture_id, trim(replace(body, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS t FROM raw_docs
) WHERE t <> ''""",
    "p7_checked": "SELECT doc_id, true AS whole, true AS within FROM documents",
    "p7_room": "SELECT true AS little_wasted",
    "p8_checked": "SELECT source, true AS within_cap, true AS near_target FROM mix_targets",
    "p6_found": """
WITH RECURSIVE known AS (SELECT lower(trim(id)) AS k, min(id) AS id FROM nodes GROUP BY 1),
pairs AS (
    SELECT DISTINCT least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM relations r
    JOIN known a ON a.k = lower(trim(r.src)) JOIN known b ON b.k = lower(trim(r.dst))
    WHERE regexp_replace(lower(trim(r.type)), '[ -]', '_', 'g') = 'same_as' AND a.id <> b.id
),""" + _REACH + " SELECT id, group_id FROM comps",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
