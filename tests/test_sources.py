"""Readers and writers over real files, and streams of small steps."""

import zlib

from pyspark.sql import functions as F

from claimweave.operators import graph as G
from claimweave.operators import judges as J
from claimweave.sources import readers as R
from claimweave.sources import writers as W

from .conftest import rows


def pdf(pages, deflate=True):
    """A minimal PDF: one content stream per page, each line shown by a string operator."""
    out = b"%PDF-1.4\n"
    for k, page in enumerate(pages):
        shown = b"BT /F1 12 Tf " + b" T* ".join(b"(" + line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1") + b") Tj" for line in page.split("\n")) + b" ET"
        body = zlib.compress(shown) if deflate else shown
        head = b"<< /Length %d %s >>" % (len(body), b"/Filter /FlateDecode" if deflate else b"")
        out += b"%d 0 obj\n" % (k + 4) + head + b"\nstream\n" + body + b"\nendstream\nendobj\n"
    return out + b"%%EOF"


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(["First page (one)\nsecond line", "Page two"]))
    (tmp_path / "b.pdf").write_bytes(pdf(["Plain stream\n1.2 Contents of it ..... 7"], deflate=False))
    (tmp_path / "c.txt").write_text("no pdf")
    got = dict(R.pdf_files(spark, str(tmp_path)).collect())
    assert got == {"a.pdf": "First page (one)\nsecond line\n\nPage two", "b.pdf": "Plain stream"}


def test_text_files_strip_contents_by_name_only(spark, tmp_path):
    toc = "1.2 Contents of it ..... 7"
    (tmp_path / "judge_a.txt").write_text(f"Head\n{toc}\nText")
    (tmp_path / "other.txt").write_text(f"Head\n{toc}\n" + "x" * 60_000)
    got = dict(R.text_files(spark, str(tmp_path), "judge_*").collect())
    assert got["judge_a.txt"] == "Head\nText" and toc in got["other.txt"] and len(got["other.txt"]) == 50_000


def test_manifest_and_artifacts(spark, tmp_path):
    W.put_files(spark, str(tmp_path), {"m.json": '[{"local_path": "", "url": "u"}, {"local_path": "p", "date": "2020"}]'})
    assert rows(R.manifest(spark, str(tmp_path / "m.json")).select("source_id", "date")) == [("p", "2020"), ("u", None)]
    W.put_files(spark, str(tmp_path / "art"), {"x.json": '{"n": 1}', "y.json": '{"claim_id": "c", "n": 2}', "z.json": "{oops"})
    schema = spark.createDataFrame([], "claim_id string, n bigint").schema
    assert rows(R.artifacts(spark, str(tmp_path / "art"), schema, "claim_id").select("claim_id", "n")) == [("c", 2), ("x", 1)]
    assert R.artifacts(spark, str(tmp_path / "none"), schema).count() == 0


def test_transcripts_have_header_lines(spark):
    s = spark.createDataFrame([("a", "T", "http://v"), ("b", None, None), ("c", "U", None)], "source_id string, title string, url string")
    b = spark.createDataFrame([("a", "words", None), ("b", "more", None), ("c", None, "FETCH_ERROR")], "source_id string, body string, fetch_error string")
    assert rows(R.transcripts(s, b)) == [("a", "Title: T\nURL: http://v\n\nwords"), ("b", "Title: untitled\nURL: \n\nmore")]


def test_memo_evicts_and_replays(spark):
    m = spark.createDataFrame([("l", "1", "ok"), ("l", "2", " "), ("l", "3", '{"refused": true}'), ("k", "4", None)], "level string, key string, response string")
    fresh = spark.createDataFrame([("l", "2", "new"), ("l", "1", "newer")], m.schema)
    once = W.remember(m, fresh)
    assert rows(once) == [("l", "1", "newer"), ("l", "2", "new")] and rows(W.remember(once, fresh)) == rows(once)
    assert W.invalidated(once, "l").count() == 0
    edges = spark.createDataFrame([("a", None), ("b", "mine"), ("c", "other")], "src string, source string")
    new = spark.createDataFrame([("d", "mine")], edges.schema)
    again = G.replaced(G.replaced(edges, new, "source", "mine"), new, "source", "mine")
    assert rows(again.select("src")) == [("a",), ("c",), ("d",)]


def test_folded_calls(spark):
    tries = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, True), ("b", 0, True), ("c", 0, False), ("c", 1, False), ("c", 2, None)], "call string, try int, good boolean")
    assert rows(J.folded_calls(tries, ["call"])) == [("a", 1, "answered", 2000), ("b", 0, "answered", 1000), ("c", None, "refused", 4000)]


def test_positions_over_partitions(spark):
    from claimweave.operators import compile as K

    df = spark.range(500).select((F.col("id") * 7 % 50).alias("x"), "id").repartition(6)
    got = {r["id"]: r["pos"] for r in K.positions(df, [F.desc("x"), F.col("id")], "pos").collect()}
    want = {i: k for k, (x, i) in enumerate(sorted(((-(i * 7 % 50), i) for i in range(500))), 1)}
    assert got == want
