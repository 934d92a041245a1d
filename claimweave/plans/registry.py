"""Queries by name with their SQL, and the relations both sides start from."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from claimweave import config as C
from claimweave.operators import graph as G
from claimweave.runtime import table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_IN = ", ".join(f"'{t}'" for t in C.RELATION_TYPES)
#: Common table expressions of the SQL, by name, each with those it needs.
CTES: dict[str, tuple[str, ...]] = {
    "nd": ("SELECT DISTINCT * EXCLUDE (loaded_at) FROM nodes",),
    "ak": ("SELECT *, coalesce(nullif(trim(source_id), ''), nullif(trim(author), '')) AS sk FROM attestations",),
    "rr": ("SELECT lower(trim(src)) AS src, lower(trim(dst)) AS dst, translate(lower(trim(type)), ' -', '__') AS type, strength, rationale, source, shared_question, rel_ord, created_at FROM relations",),
    "rl": ("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY rel_ord, created_at, coalesce(strength, -1), coalesce(rationale, ''), coalesce(shared_question, ''), coalesce(source, '')) AS k FROM rr) WHERE k = 1", "rr"),
    "ge": (f"SELECT * FROM rl WHERE type IN ({_IN}) AND src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)", "rl"),
    "so": ("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(author, ''), coalesce(title, ''), coalesce(content_type, ''), coalesce(url, ''), coalesce(role, ''), coalesce(source_date, '')) AS k FROM sources) WHERE k = 1",),
    "bd": ("SELECT capture_id, source_id, replace(body, chr(13) || chr(10), chr(10)) AS body FROM raw_docs WHERE body IS NOT NULL AND NOT starts_with(body, 'FETCH_ERROR')",),
    "pr": ("SELECT *, coalesce(nullif(trim(shared_question), ''), trim(regexp_extract(rationale, '\\(shared question:\\s*(.*)\\)\\s*$', 1)), '') AS q FROM ge WHERE type IN ('contradicts', 'weak_contradicts', 'quantitative_divergence', 'self_inconsistency')", "ge"),
    "qe": ("SELECT q, src, dst, type FROM pr WHERE q <> ''", "pr"),
    "qc": ("SELECT DISTINCT q, src AS claim_id FROM qe UNION SELECT DISTINCT q, dst FROM qe", "qe"),
    "qs": ("SELECT qc.q, count(DISTINCT ak.sk) AS n_sources FROM qc JOIN ak ON ak.node_id = qc.claim_id WHERE sk IS NOT NULL GROUP BY qc.q", "qc", "ak"),
    "pc": ("SELECT q, count(*) AS edge_count, count(*) FILTER (WHERE type = 'contradicts') AS n_contra, count(*) FILTER (WHERE type = 'weak_contradicts') AS n_weak, count(*) FILTER (WHERE type = 'quantitative_divergence') AS n_div, count(*) FILTER (WHERE type = 'self_inconsistency') AS n_self FROM qe GROUP BY q", "qe"),
    "pp": (
        "SELECT c.*, coalesce(s.n_sources, 0) AS n_sources, CASE WHEN n_contra > 0 AND coalesce(s.n_sources, 0) >= 2 THEN 'contested' WHEN n_div > 0 THEN 'divergent' WHEN n_self > 0 AND n_self = edge_count THEN 'single_author_tension' "
        "WHEN n_weak > 0 AND n_weak = edge_count THEN 'weak_tension' ELSE 'open' END AS status FROM pc c LEFT JOIN qs s ON s.q = c.q",
        "pc", "qs",
    ),
    "bm": (
        "SELECT crux, q, j, shared FROM (SELECT *, row_number() OVER (PARTITION BY crux ORDER BY j DESC NULLS LAST, shared DESC NULLS LAST, q) AS k FROM (SELECT c.crux, m.q, m.shared, round(m.shared::DOUBLE / (c.nc + p.np - m.shared), 4) AS j "
        "FROM (SELECT crux, count(*) AS nc FROM (SELECT DISTINCT crux, claim_id FROM cx) GROUP BY 1) c LEFT JOIN (SELECT x.crux, y.q, count(*) AS shared FROM (SELECT DISTINCT crux, claim_id FROM cx) x JOIN qc y ON y.claim_id = x.claim_id GROUP BY 1, 2) m ON m.crux = c.crux "
        "LEFT JOIN (SELECT q, count(*) AS np FROM qc GROUP BY 1) p ON p.q = m.q)) WHERE k = 1",
        "cx", "qc",
    ),
    "cx": ("SELECT DISTINCT key_question AS crux, id AS claim_id, case_name, evidential_weight AS w FROM nd WHERE type = 'claim' AND coalesce(trim(key_question), '') <> ''", "nd"),
    "ct": ("SELECT DISTINCT c.crux, n.case_name || '/' || coalesce(nullif(trim(n.subfield), ''), 'Uncategorized') AS theme FROM cx c JOIN nd n ON n.id = c.claim_id", "cx", "nd"),
    "th": ("SELECT DISTINCT case_name || '/' || coalesce(nullif(trim(subfield), ''), 'Uncategorized') AS theme, id, content, needs FROM (SELECT *, coalesce(specificity_score < 0.3, false) OR NOT coalesce(quote_grounded, false) OR coalesce(polarity_risk IN ('high', 'conflict'), false) AS needs FROM nd) WHERE type = 'presupposition'", "nd"),
}


def with_ctes(sql: str) -> str:
    """sql with the expressions it names in {braces} at its head, in order of need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][1:]:
            need(other)
        if name not in order:
            order.append(name)

    for name in CTES:
        if "{" + name + "}" in sql:
            need(name)
            sql = sql.replace("{" + name + "}", name)
    if not order:
        return sql
    head = ", ".join(f"{n} AS ({CTES[n][0]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def query(name: str, sql: str | None = None):
    def add(func: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        takes = len(inspect.signature(func).parameters)
        QUERIES[name] = func if takes == 2 else (lambda spark, sf_dir: func(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return func

    return add


class Tables:
    """The test tables of one scale as DataFrames, and the relations queries start from."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def nd(self, *columns: str) -> DataFrame:
        return G.one_per_id(self.nodes, *columns)

    @property
    def ak(self) -> DataFrame:
        return G.keyed_attestations(self.attestations)

    @property
    def rl(self) -> DataFrame:
        return G.clean_relations(self.relations)

    @property
    def ge(self) -> DataFrame:
        return G.guarded_relations(self.relations, self.nodes)

    @property
    def so(self) -> DataFrame:
        from pyspark.sql import functions as F

        order = [F.coalesce(c, F.lit("")) for c in ("author", "title", "content_type", "url", "role", "source_date")]
        return G.first_of(self.sources, ["source_id"], order)

    @property
    def bd(self) -> DataFrame:
        from pyspark.sql import functions as F

        raw = self.raw_docs.where("body IS NOT NULL AND NOT startswith(body, 'FETCH_ERROR')")
        return raw.select("capture_id", "source_id", F.replace("body", F.lit("\r\n"), F.lit("\n")).alias("body"))
