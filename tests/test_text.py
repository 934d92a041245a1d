"""Text functions, sources and the response boundary."""

from pyspark.sql import functions as F

from claimweave.functions import text as X
from claimweave.operators import chunks as H
from claimweave.operators import judges as J
from claimweave.operators import stance as S
from claimweave.plans.filters import polarity_risk
from claimweave.sources import readers as R
from claimweave.sources import writers as W

from .conftest import rows


def one(spark, func, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(func(*[F.col(f"c{k}") for k in range(len(values))])).first()[0]


def test_scores(spark):
    for raw, want in (("very high", 0.9), ("1.7", 1.0), (None, 0.5), ("foo", 0.5), (" Medium ", 0.65), ("-2", 0.0)):
        assert one(spark, X.score_of, raw) == want


def test_shared_question(spark):
    assert one(spark, X.shared_question, "", "r (shared question: Q?)") == "Q?"
    assert one(spark, X.shared_question, " F ", "r (shared question: Q?)") == "F"
    assert one(spark, X.shared_question, None, None) == ""


def test_junk(spark):
    for q in ("", None, "short", "7.3 Market cluster . . . . . . 64", "tion of the thing is here", "Huanan7 Seafood market was", "a . . . b . . . c . . . d"):
        assert one(spark, X.is_junk_quote, q), q
    for q in ("An ordinary sentence with sense.", "In 2019 it rose by 12.5 percent."):
        assert not one(spark, X.is_junk_quote, q), q


def test_toc(spark):
    assert one(spark, X.without_toc, "Text\n\n1.2 Title ..... 7\nMore") == "Text\n\nMore"


def test_cited_ids(spark):
    got = set(one(spark, X.cited_ids, "See [0ab1cd2e], gap_12345678, crux_x_1, THEME_07 and 12345678."))
    assert got == {"0ab1cd2e", "gap_12345678", "crux_x_1", "theme_07"}


def test_sections(spark):
    assert one(spark, X.is_section, " Methods ") and not one(spark, X.is_section, "Methods of work")
    assert one(spark, X.section_hint, "Results").startswith("empirical") and one(spark, X.section_hint, "Body").startswith("general")
    assert one(spark, X.section_number, " 12. Title") == 12 and one(spark, X.section_number, "Title") is None


def test_summary(spark):
    assert one(spark, X.summary_line, "a  b\nc") == "a b c"
    long = one(spark, X.summary_line, "word " * 60)
    assert len(long) <= 120 and long.endswith("word…")


def test_html(spark):
    page = "<html><head><style>x{}</style></head><nav>menu</nav><p>A &amp; B</p><!-- no --><script>1<2</script><div>C</div></html>"
    assert one(spark, X.html_text, page) == "A & B\nC"
    assert one(spark, X.blocked_page, "short")


def test_entities(spark):
    df = spark.createDataFrame([("The Tidal Mill of Zofin", ["Zofin", "tidal mill", "absent thing", "of"])], "c string, e array<string>")
    assert df.select(X.entity_overlap(F.col("c"), F.col("e"))).first()[0] == 0.75
    assert spark.createDataFrame([("x", [])], "c string, e array<string>").select(X.entity_overlap(F.col("c"), F.col("e"))).first()[0] == 1.0


def test_references(spark):
    assert one(spark, X.specific_reference, "Handbook of statistics, 2nd edition")
    for r in ("standard practice in the field of work", "Short 2001", None, "A long title without any mark here"):
        assert not one(spark, X.specific_reference, r)


def test_fuzzy_and_repair(spark):
    assert X.fuzzy_grounded("the quick brown fox jumps", "Yes, the quikc brown fox jumped over", 0.45)
    assert not X.fuzzy_grounded("alpha beta gamma delta", "zzz yyy xxx www vvv", 0.45)
    body = "First sentence here. The second one is about frogs and more. Third."
    assert X.repair_quote("second one is about frogs", body) == "The second one is about frogs and more."
    assert X.repair_quote("not in there at all", body) == "not in there at all"
    assert X.repair_quote(None, body) is None


def test_polarity_trap(spark):
    df = spark.createDataFrame([("reported_speech", "argues_against", 0.9, False), ("opposing_position", "argues_against", 0.9, False), ("source_author", "argues_against", 0.7, False), ("source_author", "argues_against", 0.6, False), ("source_author", "asserts", 0.6, True)], "a string, verdict string, conf double, skipped boolean")
    assert [r[0] for r in df.select(polarity_risk()).collect()] == ["none", "high", "conflict", "low", "none"]


def test_stance(spark):
    sides = S.positions(["Lab leak (escape/accident): research related", "Zoonosis: natural spillover from animals", "Judge conclusion: neither"])
    assert [p.id for p in sides] == ["lab_leak", "zoonosis"]
    for text, want in (("The lab-leak and the escape", "lab_leak"), ("Evidence against lab leak is strong", "zoonosis"), ("It is more likely that zoonosis happened than a leak", "zoonosis"), ("Nothing at all", None), (None, None)):
        assert one(spark, lambda c: S.stance(c, sides), text) == want, text
    assert one(spark, lambda c: S.stance(c, sides[:1]), "lab leak lab leak") is None


def test_blocks_and_pieces(spark):
    df = spark.createDataFrame([(1, "aa\n\nbb\n\n \n\ncccc\n\ndd")], "capture_id long, body string")
    assert [r["text"] for r in H.blocks(df, 6).orderBy("idx").collect()] == ["aa\n\nbb", "cccc\n\ndd"]
    off = lambda s: one(spark, H.valid_offsets, s)
    assert off("[5, 40.0, 12]") == [5, 40, 12] and off("[5.5]") is None and off("[true]") is None and off("x") is None and off("[]") == []
    got = spark.createDataFrame([("hello world here", [6, 6, 99])], "t string, o array<bigint>").select(H.pieces(F.col("t"), F.col("o"))).first()[0]
    assert got == ["hello", "world here"]
    assert list(one(spark, H.halves, "a\n\nb\n\nc")) == ["a", "b\n\nc"] and list(one(spark, H.halves, "abcd")) == ["ab", "cd"]


def test_roles(spark):
    cols = ["local_path", "url", "author", "content_type", "title", "publication_status", "role"]
    cases = [({"role": "Judge Decision"}, "judge_decision"), ({"role": "odd"}, "unknown"), ({"url": "https://youtu.be/x"}, "debate_transcript"), ({"title": "Reply to X"}, "rebuttal"), ({"url": "https://doi.org/1"}, "primary_research"), ({"url": "https://nature.com/1", "publication_status": "unpublished"}, "unknown"), ({"content_type": "audio"}, "debate_transcript")]
    df = spark.createDataFrame([tuple(c.get(x) for x in cols) for c, _ in cases], ", ".join(f"{x} string" for x in cols))
    assert [r[0] for r in df.select(R.source_role()).collect()] == [w for _, w in cases]


def test_manifest_artifacts_and_writers(spark, tmp_path):
    (tmp_path / "sources.json").write_text('[{"local_path": "", "url": "u"}, {"local_path": "p", "role": "review"}]')
    assert rows(R.manifest(spark, str(tmp_path / "sources.json")).select("source_id")) == [("p",), ("u",)]
    (tmp_path / "art").mkdir()
    (tmp_path / "art" / "c1.json").write_text('{"claim_id": "", "n": 1}')
    (tmp_path / "art" / "bad.json").write_text("{nope")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("claim_id", T.StringType()), T.StructField("n", T.LongType())])
    assert rows(R.artifacts(spark, str(tmp_path / "art"), schema, "claim_id").select("claim_id", "n")) == [("c1", 1)]
    assert R.artifacts(spark, str(tmp_path / "none"), schema).count() == 0
    W.export_csv(spark.createDataFrame([("a", 1.5)], "x string, y double"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_answers(spark):
    req = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = spark.createDataFrame([("polarity", "a", '```json\n{"verdict": "argues_against", "confidence": 0.8}\n```'), ("polarity", "b", "sorry"), ("polarity", "c", " ")], "kind string, k string, response string")
    res = got.select("kind", W.memo_key(F.col("k")).alias("key"), "response")
    out = {r["id"]: (r["how"], r["answer"]["verdict"]) for r in J.answered(req, res, "polarity", F.col("id")).collect()}
    assert out == {"a": ("recorded", "argues_against"), "b": ("unreadable", "asserts"), "c": ("unreadable", "asserts"), "d": ("missing", "asserts")}


def test_memo(spark):
    old = spark.createDataFrame([("l", "1", "x"), ("l", "2", '{"refused": true}')], "level string, key string, response string")
    new = spark.createDataFrame([("l", "1", "y"), ("l", "3", "")], "level string, key string, response string")
    assert rows(W.remember(old, new)) == [("l", "1", "y")]


def test_audit_text():
    paper = "Title\n\nAbstract\n" + "We studied many things. " * 8 + "\nMethods\n" + "A cohort was followed. " * 12 + "\nResults\n" + "There were many of them. " * 6 + "\nDiscussion\nIt was fine."
    got = X.methodology_text(paper, "published")
    assert got.startswith("=== ABSTRACT") and "=== METHODS ===" in got and "=== RESULTS" in got and "It was fine" not in got
    talk = "\n\n".join(["Nothing here at all."] * 5 + ["The base rate and the prior probability matter. " * 12])
    assert X.methodology_text(talk, "").startswith("The base rate") and X.methodology_text("FETCH_ERROR: x", "") == "" and X.methodology_text(None, None) == ""


def test_hashed_vectors_are_unit(spark, tmp_path):
    from claimweave.plans.registry import QUERIES
    import claimweave.plans.queries  # noqa: F401

    spark.createDataFrame([(1, "alpha beta gamma alpha"), (2, "delta words here beta")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["X21_hashed_vectors"](spark, str(tmp_path)).collect()
    assert [r["norm"] for r in out] == [1.0, 1.0]


def test_repair_stops_at_header_and_paragraph():
    body = "Intro line ends here.\n\nMethods of the panel\nThe panel met on a day and saw it all. It left.\n\nNext: the harbour"
    assert X.repair_quote("met on a day", body) == "The panel met on a day and saw it all."
    assert X.repair_quote("Next: the", body) == "Next: the harbour"
    assert X.repair_quote("It left.", body) == "It left."
    long = "word " * 2000
    assert len(X.repair_quote("word word word", "x. " + long)) <= 4000


def test_parsed_json_and_sample_sizes(spark):
    def kind(text):
        df = spark.createDataFrame([(text,)], "c string")
        return df.select(X.parsed_json(F.col("c"))[0]).first()[0]

    assert [kind(x) for x in ('```json\n{"a": 1}\n```', "[1, 2]", '```\n{"a"', "")] == ["object", "list", "parse_error", "parse_error"]
    assert [one(spark, X.n_needed, x) for x in ('{"n_needed": {"value": 4}}', '{"n_needed": {}}', '{"n_needed": 7}', "{}", None)] == ["4", "TBD", "7", "", ""]


def test_briefing_html(spark):
    assert one(spark, X.briefing_html, "# A & b\r\n\r\n one \n two\n\n## C") == '<h2 class="briefing-h2">A &amp; b</h2><p class="briefing-p">one two</p><h3 class="briefing-h3">C</h3>'
    assert one(spark, X.briefing_html, "  ") == '<p class="briefing-p">  </p>'
