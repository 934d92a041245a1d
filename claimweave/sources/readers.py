"""Readers: manifests, bodies, pages, transcripts and directories of artifacts."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave import config as C
from claimweave.functions import patterns as P
from claimweave.functions import text as X

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("local_path", "url", "author", "date", "content_type", "title", "bibliography", "publication_status", "role")])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of source entries; missing fields are null."""
    return spark.read.option("multiLine", True).schema(MANIFEST).json(path).withColumn("source_id", source_id())


def source_id() -> Column:
    return F.coalesce(F.nullif("local_path", F.lit("")), F.nullif("url", F.lit("")), F.lit(""))


def text_files(spark: SparkSession, path: str, toc_names: str | None = None) -> DataFrame:
    """(name, body): whole text files under a folder, cut to the body limit; of files whose names match the pattern toc_names
    (* for anything) the lines of a table of contents are then left out. A folder name=… names the files in it."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), r"/name=([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    cut = rows.select(name.alias("name"), F.substring("value", 1, C.DEFAULT.body_chars).alias("body"))
    if toc_names is None:
        return cut
    return cut.withColumn("body", F.when(F.col("name").like(toc_names.replace("_", r"\_").replace("*", "%")), X.without_toc(F.col("body"))).otherwise(F.col("body")))


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page of a PDF: with a reader where one is installed, else the strings shown by its content streams."""
    try:
        import io

        from pypdf import PdfReader

        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]
    except ImportError:
        return _shown_strings(data)


def _shown_strings(data: bytes) -> list[str]:
    """One text per content stream (plain or deflated) that shows any: literal strings of Tj, TJ, ' and ", a line for each move."""
    pages = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        out: list[str] = []
        for op in re.finditer(rb"\((?:\\.|[^\\()])*\)|(?<![A-Za-z])(?:T\*|Td|TD|'|\")(?![A-Za-z])", body, re.S):
            if op[0][:1] == b"(":
                text = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(e[1], e[1]), op[0][1:-1], flags=re.S)
                out.append(text.decode("latin-1"))
            else:
                out.append("\n")
        if any(x != "\n" for x in out):
            pages.append("".join(out).strip("\n"))
    return pages


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, body): PDF files of a folder; pages are joined by blank lines, tables of contents left out, then cut to the limit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)

    def read(frames):
        for frame in frames:
            yield frame.assign(body=["\n\n".join(pdf_pages(bytes(x))) for x in frame["content"]])[["path", "body"]]

    rows = files.select("path", "content").mapInPandas(read, "path string, body string")
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.substring(X.without_toc(F.col("body")), 1, C.DEFAULT.body_chars).alias("body"))


def transcripts(sources: DataFrame, bodies: DataFrame) -> DataFrame:
    """(source_id, text) of sources with a good body fetched before: header lines, a blank line and the transcript."""
    title, url = F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")), F.coalesce("url", F.lit(""))
    good = bodies.where("fetch_error IS NULL AND body IS NOT NULL")
    return good.join(sources.select("source_id", title.alias("title"), url.alias("url")), "source_id").select("source_id", F.concat(F.lit("Title: "), "title", F.lit("\nURL: "), "url", F.lit("\n\n"), "body").alias("text"))


def artifacts(spark: SparkSession, folder: str, schema: T.StructType, key: str | None = None) -> DataFrame:
    """JSON artifacts of a directory with their file name; unreadable files are skipped, a missing directory is empty.

    key names a field that falls back to the file's stem.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).schema(schema).json(folder)
    rows = rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return rows.withColumn(key, F.coalesce(F.nullif(key, F.lit("")), F.regexp_extract("file", r"(.+)\.json$", 1))) if key else rows


def optional_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of that schema where it does not exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def resolved_bodies(captures: DataFrame) -> DataFrame:
    """(source_id, body, fetch_error): the last good capture of a source, else its last error."""
    error = F.coalesce("fetch_error", F.when(F.col("body").isNull(), F.lit("no body")).when(F.startswith("body", F.lit("FETCH_ERROR")), F.col("body")))
    rows = captures.select("source_id", "capture_id", "fetched_at", F.when(error.isNull(), F.substring("body", 1, C.DEFAULT.body_chars)).alias("body"), error.alias("fetch_error"))
    last = F.struct(F.col("body").isNotNull(), F.col("fetched_at"), F.col("capture_id"))
    best = rows.groupBy("source_id").agg(F.max_by(F.struct("capture_id", "body", "fetch_error"), last).alias("r"))
    return best.select("source_id", "r.*")


def page_text(pages: DataFrame, html: str) -> DataFrame:
    """pages with text (markup, scripts and navigation dropped, at most the body limit) and blocked."""
    text = F.substring(X.html_text(F.col(html)), 1, C.DEFAULT.body_chars)
    return pages.withColumn("text", text).withColumn("blocked", X.blocked_page(F.col("text")))


def video_id(url: str = "url") -> Column:
    return F.nullif(F.regexp_extract(url, P.YOUTUBE, 1), F.lit(""))


def is_transcript_source() -> Column:
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return (kind == "video") & video_id().isNotNull() & (F.coalesce("local_path", F.lit("")) == "")


def trust_type(kind: str = "content_type") -> Column:
    known = F.create_map(*[F.lit(x) for item in C.TRUST_TYPES.items() for x in item])
    return F.coalesce(known[F.coalesce(kind, F.lit("text"))], F.lit("essay_reflection"))


def source_role() -> Column:
    """The declared role, else the first rule that holds; roles outside the closed set are unknown."""
    declared = F.replace(F.lower(F.trim("role")), F.lit(" "), F.lit("_"))
    url, title, author = (F.lower(F.coalesce(c, F.lit(""))) for c in ("url", "title", "author"))
    named = F.lower(F.coalesce(F.nullif("title", F.lit("")), F.nullif("local_path", F.lit("")), "url", F.lit("")))

    def any_of(c: Column, *words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(c, F.lit(w))
        return out

    return (
        F.when(F.coalesce("role", F.lit("")) != "", F.when(declared.isin(*C.ROLES), declared).otherwise("unknown"))
        # The rules in order.
        .when(any_of(url, "youtube.com", "youtu.be"), "debate_transcript")
        .when(any_of(author, "judge") | any_of(title, "judge"), "judge_decision")
        .when(any_of(named, "response to", "response-to", "response_to", "rebuttal", "reply"), "rebuttal")
        .when(any_of(url, "doi.org", "pubmed", "arxiv.org", "biorxiv", "ncbi.nlm.nih.gov"), "primary_research")
        .when(any_of(url, "academic.oup.com", "sciencedirect.com", "springer.com", "nature.com", "wiley.com", "cell.com", "thelancet.com") & (F.coalesce("publication_status", F.lit("")) != "unpublished"), "primary_research")
        .when(any_of(title, "meta-analysis", "systematic review", "meta analysis"), "review")
        .when(any_of(url, "substack.com", "medium.com", "blogspot", "wordpress.com"), "commentary")
        .when(F.coalesce("content_type", F.lit("")).isin("video", "audio"), "debate_transcript")
        .otherwise("unknown")
    )


def source_label() -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in ("title", "author", "local_path", "url")], F.lit("untitled"))
