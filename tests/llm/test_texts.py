import random

from hypothesis import given, settings
from hypothesis import strategies as st

from claimweave.llm import looks as L
from claimweave.llm import splitting as S
from claimweave.llm import truncation as T


def test_one_form():
    same = [("ﬁne", "fine"), ("ｔｈｅ", "the"), ("a b", "a b"), ("a\xa0b", "a b"), ("é", "é"), ("co­op", "coop"), ("ѕаme", "same"), ("Το", "To"), ("x​", "x"), ("pro‑a", "pro-a"), (" a  b ", "a b"), ("έ", "έ"), ("օ", "o"), ("Ꭺ", "A"), ("ɡɑ", "ga"), ("ꓮ", "A")]
    for a, b in same:
        assert L.one_form(a) == L.one_form(b), (a, b)
    for a, b in [("é", "e"), ("A", "a"), ("x²", "x2"), ("①", "1"), ("a.", "a!"), ("6", "9"), ("a–b", "a-b"), ("ü", "u")]:
        assert L.one_form(a) != L.one_form(b), (a, b)
    assert L.folded("Straße") == L.folded("STRASSE")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_one_form_is_stable(text):
    assert L.one_form(L.one_form(text)) == L.one_form(text)


def test_looks_nulls_blanks_and_clashes(spark):
    rows = [("a", "ﬁ", "fi", 1), ("b", None, "x", 1), ("c", "​", " ", 1), ("d", "X", "x", 1), ("e", "x", "x", 1), (None, "ﬁ", "fi", 1), ("a", "ﬁ", "fi", 1)]
    df = spark.createDataFrame(rows, "id string, t string, q string, t_form int")
    assert [r["id"] for r in L.alike_but_different(df, "id", "t", "q").collect()] == ["a"]
    assert L.alike_but_different(df.limit(0), "id", "t", "q").count() == 0


def body(n, seed):
    r = random.Random(seed)
    parts = []
    while sum(map(len, parts)) < n:
        kind = r.random()
        if kind < 0.1:
            parts.append("Results\n\n")
        elif kind < 0.2:
            parts.append("x" * r.randrange(3000, 9000) + "\n \t\n")
        else:
            parts.append(" ".join("word" * r.randrange(1, 3) + r.choice([".", "", ",", "\n"]) for _ in range(r.randrange(5, 400))) + "\n\n")
    return S.cleaned("".join(parts))


def test_pieces_round_trip():
    for seed in range(40):
        text = body(random.Random(seed).randrange(100, 40_000), seed)
        for kind in (None, "video"):
            got, _ = S.split(text, kind)
            assert all(0 < len(p) <= S.LIMIT for p, _ in got)
            assert "".join(p[k:] for p, k in got) == text
            for (a, _), (b, k) in zip(got, got[1:]):
                assert k == min(S.OVERLAP, len(a)) and b[:k] == a[-k:]


def test_oversized_nodes():
    text = S.cleaned("short\r\n \r\n" + "y" * 4001 + "\r\n\r\n" + "z" * 4000 + "\r\n")
    assert S.split(text)[1] == [(0, len(text)), (2, 4001)]
    assert S.split("q" * 4000) == ([("q" * 4000, 0)], []) and S.split("") == ([], [])


def test_no_piece_crosses_a_section_while_both_fit_apart():
    """The rest of an oversized section is not glued to the next one, whole small sections are merged, and a subsection stays
    with its section."""
    say = lambda n, w: " ".join([w + "."] * n)
    text = "\n\n".join(["# Alpha", say(60, "alpha"), "# Beta", say(400, "beta"), "## Below", say(300, "below"), say(60, "gone"), "# Gamma", say(60, "gamma"), "# Delta", say(60, "delta")])
    pieces, _ = S.split(text, None, 2000, 100)
    own = [p[k:] for p, k in pieces]
    assert "".join(own) == text
    assert not any("gone" in p and "gamma" in p for p in own) and not any("alpha" in p and "beta." in p for p in own)
    assert any("gamma" in p and "# Delta" in p for p in own)
    assert [n.level for n in S.tree(text).children] == [1, 1, 1, 1] and S.tree(text).children[1].children[-1].level == 2


def test_heading_levels():
    assert [S.heading_level(x) for x in ("# A", "### A", "1. Results", "2.3. Results", "Title: x", "Materials and methods", "A plain sentence, with more.")] == [1, 3, 1, 2, 1, 7, 0]


def test_rejoined(spark):
    docs = spark.createDataFrame([(1, "s", "abc"), (2, "s", "word " * 3000)], "capture_id bigint, source_id string, body string")
    kinds = S.content_kinds(spark.createDataFrame([("s", "pdf")], "source_id string, content_type string"))
    got = {r["capture_id"]: r for r in S.rejoined(S.split_bodies(docs, kinds)).collect()}
    assert all(r["fits"] and r["repeats"] for r in got.values()) and got[2]["n_chars"] == len(("word " * 3000).strip())


def test_split_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "s", None), (2, "s", "  "), (3, None, "abc"), (4, "t", "w " * 5000)], "capture_id bigint, source_id string, body string")
    kinds = S.content_kinds(spark.createDataFrame([("s", " Video "), ("s", "PDF"), ("t", None), (None, "x")], "source_id string, content_type string"))
    out = S.split_bodies(docs, kinds)
    assert {r["capture_id"] for r in out.collect()} == {3, 4}
    assert S.split_bodies(docs.limit(0), kinds).count() == 0


CUT = ["The cohort follows the quot", "He said that the", 'One. "The panel shows', "Text is cut here [...]", "Half a sentence (continued)", "One two. Next &am", "One two. Next <a hre", "Broken �", "It ends with a comma,", "Some. Then (near Pore"]
WHOLE = ["A sentence.", "Is it so?", '"Quoted," said he, "to the end."', "A sentence. (Sadern)", "One two.\nOpen points:\n- first\n- second", "", "  ", "Done!", "Fine.)"]


def test_endings():
    for text in CUT:
        got = T.ending(text)
        assert got[0] in ("cut", "open", "line", "remark") or (got[0] == "marked" and not got[3]) or got[4], text
    for text in WHOLE:
        got = T.ending(text)
        assert got[0] in ("closed", "blank", "list") or (got[0] == "marked" and got[3]), text
    assert T.ending("So it was. And so it goes...")[:2] == ("remark", "And so")


def test_the_automaton_reads_the_whole_text():
    """A quote, bracket or element opened 6,000 characters before the end is still open there."""
    for opened in ("\u201cIt was", "[after it was", "<div><b>It was"):
        text = "The panel met. " + opened + " seen by all. " + "All voted for it. " * 400 + "It was so."
        assert T.ending(text)[4], opened
    assert not T.ending("He said \u201cit was\u201d [so]. " * 400)[4]


def test_terminators_are_judged_by_the_source(spark):
    """In a source whose texts go without terminators a missing one tells nothing; a broken-off word does."""
    plain = "The panel of the harbour Number {} saw the register and the residue"
    rows = [(k, plain.format(k), "plain") for k in range(12)] + [(20, "The panel of the harbour saw the regis", "plain")]
    rows += [(30 + k, "The panel saw the register. It saw the residue.", "full") for k in range(12)] + [(50, "The panel saw the register. It saw the residue", "full")]
    got = {r["doc_id"] for r in T.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "plain").where("truncated").collect()}
    assert got == {20, 50}


def test_markers_of_cuts_are_learnt(spark):
    """What stands in brackets after broken-off texts marks a cut after a full stop too; names after full stops do not."""
    rows = [(k, f"The panel saw the regis [abridged here]", "a") for k in range(4)] + [(9, "The panel saw it all. [abridged here]", "a")]
    rows += [(20 + k, f"The panel saw it all, number {k}. (Pore)", "a") for k in range(6)]
    got = {r["doc_id"] for r in T.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "marks").where("truncated").collect()}
    assert got == {0, 1, 2, 3, 9}


def test_left_open():
    assert T.left_open("a (b [c] d") == "(" and T.left_open('"a" (b) <em>c</em>') == "" and T.left_open("a) b]") == "" and T.left_open("x <em>y") == "<"


def test_judged_with_baselines(spark):
    rows = [(k, f"Text number {k} says that all is well. It was seen.\nFiled by Nam{'x' * k}", "a") for k in range(8)]
    rows += [(20 + k, "The panel met. " + "The panel shows a thing and more of it" [: 20 + k], "a") for k in range(3)]
    rows += [(30, None, "a"), (31, "", None), (32, "The end is cut he", "b"), (33, "The end is cut he", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"] for r in T.judged(df).where("truncated").collect()}
    assert got == {20, 21, 22, 32, 33}
    assert T.rates(T.judged(df)).count() == 3
    assert T.judged(df.limit(0)).count() == 0


def test_open_brackets_and_broken_list_items(spark):
    """The automaton counts for every kind of end, but not in a source that leaves brackets open by habit."""
    fine = "The panel met near the harbour. All of it was seen by the register."
    rows = [(k, f"{fine} Number {k} (of {k}) is \"well\".", "a") for k in range(40)]
    rows += [(50, f"{fine} It was small (approx.", "a"), (51, f"{fine}\nOpen points:\n- harbour\n- the panel (near", "a"), (52, f"{fine}\nOpen points:\n- panel\n- the regis", "a"), (53, f"{fine}\nOpen points:\n- panel\n- Saturn", "a")]
    rows += [(60 + k, f"{fine} Point {k} ( was made.", "b") for k in range(5)]
    got = {r["doc_id"] for r in T.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "held").where("truncated").collect()}
    # source a: 2 of 44 texts hold something open, within OPEN_SHARE
    assert got == {50, 51, 52}


def test_transcripts_need_a_broken_word(spark):
    words = "the cohort follows every register near the harbour while transcript readings amplify the measured gap between salinity and drought during each hearing of the panel"
    rows = [(k, f"{words} {words} {w}", "c") for k, w in enumerate(["register", "regis", "salinity", "tran"])]
    got = {r["doc_id"] for r in T.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("truncated").collect()}
    assert got == {1, 3}


def test_ascii_pairs_are_settled_like_the_others(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate([("a  b", "a b"), ("a\tb ", " a b"), ("a b", "A b"), ("a\x1cb", "a b"), ("", " "), ("ab", "a b"), ("a\nb", "a  b"), ("a b", "a\u00a0b")])]
    df = spark.createDataFrame(rows, "id bigint, t string, q string")
    want = {k for k, a, b in rows if a != b and L.one_form(a) == L.one_form(b) != ""}
    assert {r["id"] for r in L.alike_but_different(df, "id", "t", "q").collect()} == want


def test_short_words_are_known_by_their_source(spark):
    """A fragment that is a word of another source's language is broken off where its own source has no such word."""
    english = "the panel of the harbour saw the deviation while the register and the residue of it amplify the measured gap between salinity and drought"
    spanish = "El informe de la presa. El coste de la obra. "
    rows = [(k, english + " during each hearing", "plain") for k in range(6)] + [(9, english + " de", "plain"), (10, english + " of it", "plain")] + [(20 + k, spanish * 3, "es") for k in range(4)]
    got = {r["doc_id"] for r in T.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "short").where("truncated").collect()}
    assert got == {9}
