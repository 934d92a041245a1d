"""Hand-computed fixtures of routing, grounding, repair, verdicts, rubrics and notes."""

from pyspark.sql import functions as F

from claimweave.operators import compile as K
from claimweave.operators import graph as G
from claimweave.operators import grounding as GR
from claimweave.operators import reconcile as Q
from claimweave.plans.filters import badge, rubric_states

from .conftest import rows


def test_contradictions_are_routed_by_source_author_and_question(spark):
    df = spark.createDataFrame([("a", "b", 0.6, True, False, 0.9), ("c", "d", 0.6, False, True, 0.9), ("e", "f", 0.6, False, False, 0.4), ("g", "h", 0.6, False, False, 0.5), ("i", "j", 0.6, False, False, None)], "a string, b string, sim double, same_document boolean, same_author boolean, qsim double")
    got = {(r["src"], r["dst"]): r["type"] for r in Q.route_contradictions(df, "qsim", 0.5).collect()}
    assert got[("a", "b")] == got[("b", "a")] == got[("c", "d")] == "self_inconsistency"
    assert got[("f", "e")] == "weak_contradicts" and got[("g", "h")] == got[("i", "j")] == "contradicts" and len(got) == 10


def test_grounding_by_words_or_by_vectors(spark):
    p = spark.createDataFrame([(1, 1, "harbour pollen register meadow"), (1, 2, "nothing shared whatsoever here"), (2, 1, "harbour pollen register meadow"), (3, 1, "")], "doc_id bigint, no bigint, p string")
    e = spark.createDataFrame([("harbour pollen register",), (None,), ("",)], "text string")
    assert rows(GR.grounded_paragraphs(p, e)) == [(1, 1, True), (1, 2, False), (2, 1, True), (3, 1, False)]
    vectors = (spark.createDataFrame([(1, 2, [1.0, 0.0]), (3, 1, [0.0, 1.0])], "doc_id bigint, no bigint, v array<double>"), spark.createDataFrame([(7, [0.8, 0.6]), (8, None)], "id bigint, v array<double>"))
    assert rows(GR.grounded_paragraphs(p, e, vectors, semantic=0.7)) == [(1, 1, True), (1, 2, True), (2, 1, True), (3, 1, False)]
    assert GR.grounded_paragraphs(p.limit(0), e).count() == 0


def test_nearest_takes_the_best_then_the_least(spark):
    left = spark.createDataFrame([("x", ["aa", "bb"]), ("y", ["zz"]), ("z", [])], "k string, tokens array<string>")
    right = spark.createDataFrame([("2", ["aa", "bb", "cc"]), ("1", ["aa", "bb", "dd"]), ("3", ["aa"])], "id string, tokens array<string>")
    assert rows(K.nearest(left, ["k"], right, 0.06).select("k", "id", F.round("sim", 3))) == [("x", "1", 0.667)]
    assert K.nearest(left, ["k"], right, 0.7).count() == 0


def test_verdicts_prefer_the_judge_under_the_rule(spark):
    p = spark.createDataFrame([("a", "from_evidence", "from_evidence", None), ("b", "from_evidence", "ungrounded", "from_evidence"), ("c", "from_evidence", "from_evidence", "ungrounded"), ("c", "from_evidence", "from_evidence", "ungrounded"), ("d", "ungrounded", "ungrounded", None)], "k string, declared string, grounding string, said string")
    assert rows(K.merged_verdicts(p, ["k"])) == [("b", "from_evidence", "ungrounded", "rule"), ("c", "from_evidence", "ungrounded", "judge")]


def test_rubric_states(spark):
    profiles = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("d", False), ("e", False)], "case_name string, failed boolean")
    rubric = spark.createDataFrame([("c", "x"), ("d", "x"), ("d", "y")], "case_name string, criterion_id string")
    audits = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", "x")], "case_name string, criterion_id string")
    assert [(r["case_name"], r["state"]) for r in rubric_states(profiles, rubric, audits).orderBy("case_name").collect()] == [("a", "no shared rubric"), ("b", "profile failed"), ("c", "overrides"), ("d", "shared rubric"), ("e", "shared rubric")]


def test_provenance_notes(spark):
    data = [("c", n, 1, 1) for n in (1, 2, 3, 5) for _ in range(3)] + [("c", 4, 1, 0)] * 3 + [("c", 9, 1, 1)]
    note = K.provenance_notes(spark.createDataFrame(data, "g string, no int, cited int, valid int"), "g").first()["note"]
    assert note == "§1–§3, §5 are graph-derived; §4 combine paraphrase with synthesis; 188 of 1000 cited ids do not resolve"


def test_badges_and_appended(spark):
    df = spark.createDataFrame([("contested",), ("unknown",), (None,)], "s string")
    assert [r[0] for r in df.select(badge("epistemic", F.col("s"))).collect()] == ["warn", "muted", "muted"]
    old = spark.createDataFrame([("n", "s", "q")], "node_id string, source_id string, quote string")
    new = spark.createDataFrame([("n", "s", "q"), ("n", "s", "r"), ("n", "s", "r")], old.schema)
    assert rows(G.appended(old, new, old.columns)) == [("n", "s", "q", False), ("n", "s", "r", True)]


def test_debate_state_lists_ids(spark):
    nodes = spark.createDataFrame([("a", "claim"), ("b", "claim"), ("c", "gap"), ("d", "evidence")], "id string, type string")
    edges = spark.createDataFrame([("a", "b", "contradicts"), ("a", "d", "contradicts"), ("a", "b", "requires"), ("c", "a", "supports")], "src string, dst string, type string")
    att = spark.createDataFrame([("d",), ("d",)], "node_id string")
    got = {r["id"]: r for r in K.debate_state(nodes, edges, att).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["contradicted_by"] == "b,d" and got["b"]["if_false_then_falls"] == "a" and got["d"]["n_attestations"] == 2
