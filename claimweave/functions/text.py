"""Text scalars as Column functions; all stay in the JVM except the three marked as vectorised Python."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave import config as C
from claimweave.functions import patterns as P


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def matching_form(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed, punctuation dropped (word characters of any script stay)."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"\s+", " "), r"[^\p{L}\p{N}_\s]", "")


def collapsed_lower(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def token_set(c: Column, stop: list[str]) -> Column:
    """Distinct runs of four or more letters a-z, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]{4,})"), 1)), F.array(*[F.lit(w) for w in stop]))


def stance_tokens(c: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z][a-z0-9-]*)\b"), 1))
    return F.array_except(F.filter(found, lambda w: F.length(w) >= 3), F.array(*[F.lit(w) for w in C.STANCE_STOP_WORDS]))


def slug(c: Column, size: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, size)


def shared_question(field: Column, rationale: Column) -> Column:
    """The field itself, else what a rationale ends with in '(shared question: …)'; else ''."""
    return F.coalesce(F.nullif(F.trim(field), F.lit("")), F.trim(F.regexp_extract(rationale, r"\(shared question:\s*(.*)\)\s*$", 1)), F.lit(""))


def summary_line(c: Column, size: int = 120) -> Column:
    """One line of at most size characters, cut at a word, with an ellipsis where something was cut."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, size - 1), r"\s+\S*$", ""), F.lit("…")))


def section_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+)\.", 1), F.lit("")).cast("int")


def cited_ids(c: Column) -> Column:
    """Distinct ids cited in a text; bare ids of eight hex digits need a letter among them."""
    low = F.lower(c)
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), 1) for p in P.CITED]))
    return F.array_distinct(F.filter(found, lambda x: x.contains("_") | (F.length(x) != 8) | x.rlike("[a-f]")))


def normal_id(c: Column) -> Column:
    return F.regexp_replace(c, r"^(gap_|claim_)", "")


def is_section(c: Column) -> Column:
    return c.rlike(P.SECTION)


def section_hint(c: Column) -> Column:
    """The hint of the first known name a section's name contains."""
    out: Column | None = None
    for name, hint in C.SECTION_HINTS.items():
        test = F.contains(F.lower(c), F.lit(name))
        out = F.when(test, F.lit(hint)) if out is None else out.when(test, F.lit(hint))
    return out.otherwise(F.lit(C.NO_HINT))


def toc_line(line: Column) -> Column:
    return line.rlike(P.TOC_DOTS) | line.rlike(P.TOC_SECTION) | line.rlike(P.PAGE_SECTION)


def is_junk_quote(c: Column) -> Column:
    """Whether a quote is index debris: null, empty or short ones are."""
    q = F.trim(F.coalesce(c, F.lit("")))
    lines = F.filter(F.transform(F.split(q, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    votes = F.size(F.filter(lines, toc_line))
    junk = F.length(q) < 8
    for pattern in (*P.JUNK_ANYWHERE, P.TOC_DOTS, P.TOC_EMBEDDED, P.PAGE_SECTION):
        junk = junk | q.rlike(pattern)
    junk = junk | (F.size(F.regexp_extract_all(q, F.lit(f"({P.ELLIPSIS})"), 1)) >= 2)
    return junk | ((votes > 0) & (votes >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2).cast("int"))))


def without_toc(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, r"\r\n|\r|\n"), lambda x: (F.trim(x) == "") | ~toc_line(F.trim(x))), "\n")


def html_text(c: Column) -> Column:
    """Text of a page without scripts, navigation and forms; one trimmed line per text node."""
    out = F.regexp_replace(c, r"(?is)<(" + "|".join(P.DROPPED_TAGS) + r")\b.*?</\1\s*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def escaped(c: Column) -> Column:
    """Text for a page: markup characters as entities."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def badge_html(label: Column, tier: Column) -> Column:
    return F.concat(F.lit('<span class="badge '), escaped(tier), F.lit('">'), escaped(label), F.lit("</span>"))


def briefing_html(c: Column) -> Column:
    """Headings and paragraphs of a briefing as a page; a text without any is one paragraph."""
    white = F.lit(" \t\n\r\f")
    paras = F.filter(F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n\n"), lambda p: F.btrim(p, white)), lambda p: p != "")

    def block(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), lambda x: F.btrim(x, white)), lambda x: x != "")
        title = lambda n, tag: F.concat(F.lit(f'<{tag} class="briefing-{tag}">'), escaped(F.btrim(F.substr(p, F.lit(n)), white)), F.lit(f"</{tag}>"))
        body = F.concat(F.lit('<p class="briefing-p">'), F.array_join(F.transform(lines, escaped), " "), F.lit("</p>"))
        return F.when(F.startswith(p, F.lit("## ")), title(4, "h3")).when(F.startswith(p, F.lit("# ")), title(3, "h2")).otherwise(body)

    html = F.array_join(F.transform(paras, block), "")
    return F.when(html == "", F.concat(F.lit('<p class="briefing-p">'), escaped(c), F.lit("</p>"))).otherwise(html)


def anchor_slug(c: Column) -> Column:
    """The anchor of a group by subfield."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("uncategorized"))), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("cross-"), F.coalesce(F.nullif(F.substring(slug, 1, 56), F.lit("")), F.lit("other")))


def file_safe(c: Column, size: int = 80) -> Column:
    """An id as a file name."""
    return F.substring(F.translate(c, "/\\:", "___"), 1, size)


def parsed_json(c: Column) -> tuple[Column, Column]:
    """(kind, text) of a model's answer without its fence: object, list, value, or parse_error where it is no JSON."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", ""))
    fine = F.try_parse_json(bare).isNotNull()
    kind = F.when(~fine, "parse_error").when(bare.startswith("{"), "object").when(bare.startswith("["), "list").otherwise("value")
    return kind, bare


def n_needed(study: Column) -> Column:
    """The sample size of a study as text: its value where it is an object (TBD without one), else what stands there."""
    n = F.get_json_object(study, "$.n_needed")
    return F.when(F.coalesce(n, F.lit("")).startswith("{"), F.coalesce(F.nullif(F.get_json_object(study, "$.n_needed.value"), F.lit("")), F.lit("TBD"))).otherwise(F.coalesce(n, F.lit("")))


def blocked_page(text: Column) -> Column:
    low = F.lower(F.substring(text, 1, 2000))
    out = F.length(text) < 800
    for phrase in C.BLOCK_PHRASES:
        out = out | F.contains(low, F.lit(phrase))
    return out


def looks_like_paper(c: Column) -> Column:
    low = F.lower(F.substring(c, 1, 12000))
    total = F.lit(0)
    for m in C.PAPER_MARKERS:
        total = total + F.contains(low, F.lit(m)).cast("int")
    return total >= 2


def entity_overlap(content: Column, entities: Column) -> Column:
    """Share of entities mentioned: half of their words of four or more characters, or the whole where there are none."""
    low = F.lower(content)

    def mentioned(e: Column) -> Column:
        words = F.filter(F.split(F.lower(e), r"\s+"), lambda w: F.length(w) > 3)
        hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
        need = F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))
        return F.when(F.size(words) == 0, F.contains(low, F.lower(e))).otherwise(hits >= need)

    return F.when(F.size(entities) < 1, F.lit(1.0)).otherwise(F.size(F.filter(entities, mentioned)) / F.size(entities))


def specific_reference(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    vague = F.lit(False)
    for v in P.REFERENCE_VAGUE:
        vague = vague | F.contains(low, F.lit(v))
    return (F.length(low) >= 20) & ~(vague & ~low.rlike(P.REFERENCE_YEAR)) & low.rlike(P.REFERENCE_MARK)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where either is empty."""
    return F.when((F.size(a) < 1) | (F.size(b) < 1), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score_of(c: Column, default: float = 0.5) -> Column:
    """A score from a number or word, within [0, 1]; the default where it can't be read."""
    key = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    words = F.create_map(*[F.lit(x) for item in C.SCORE_WORDS.items() for x in item])
    number = F.trim(c).try_cast("double")
    return F.coalesce(words[key], F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), F.lit(default))


def _norm(text: str) -> str:
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", text.lower().strip()))


def fuzzy_grounded(quote: str, body: str, ratio: float) -> bool:
    """Whether some window of as many words as the quote resembles it; whole texts are compared for very short quotes."""
    q, c = _norm(quote), _norm(body)
    words = q.split()
    matcher = difflib.SequenceMatcher(None, autojunk=True)
    matcher.set_seq1(q)
    if len(words) < 4:
        matcher.set_seq2(c)
        return matcher.ratio() >= ratio
    there = c.split()
    for i in range(len(there) - len(words) + 1):
        matcher.set_seq2(" ".join(there[i : i + len(words)]))
        if matcher.real_quick_ratio() >= ratio and matcher.quick_ratio() >= ratio and matcher.ratio() >= ratio:
            return True
    return False


def fuzzy_grounding(ratio: float):
    """Vectorised Python: run it only on rows whose quote is not literally contained."""

    @F.pandas_udf(T.BooleanType())
    def check(quote: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([bool(q) and bool(b) and len(_norm(q)) >= 20 and fuzzy_grounded(q, b, ratio) for q, b in zip(quote, body)])

    return check


# How a quote is widened: the head it is searched by where it is not found whole, how far back and forward it may
# grow, the longest header line, and the end of a sentence in running text.
HEAD_CHARS, HEAD_LEAST, HEAD_SPARE = 40, 8, 20
BACK, COLON, PARAGRAPH, SPARE, HEADER, QUOTE_CAP = 200, 160, 200, 80, 90, 4000
SENTENCE_END = re.compile(r"[.!?][\"')\]]*(?:\s+|$)")
CLOSERS = "\"')]}"


def _located(quote: str, body: str) -> tuple[int, int] | None:
    """Where a quote stands in a body, by all of it or by its head, whatever the case."""
    low, wanted = body.lower(), quote.lower()
    if (at := low.find(wanted)) >= 0:
        return at, at + len(quote)
    head = wanted[:HEAD_CHARS].strip()
    if len(head) < HEAD_LEAST or (at := low.find(head)) < 0:
        return None
    return at, min(len(body), at + max(len(quote), len(head) + HEAD_SPARE))


def _whole(body: str, start: int, end: int) -> bool:
    """Whether a span begins after the end of a sentence and ends with one, closing marks aside."""
    before, inside = body[:start].rstrip(), body[:end].rstrip(CLOSERS)
    begins = not before or before[-1] in ".!?" or (len(before) > 1 and before[-1] in CLOSERS)
    return begins and (end >= len(body) or not inside or inside[-1] in ".!?")


def _back(body: str, start: int, end: int) -> int:
    """The start of the sentence a span lies in, within its paragraph and not far back; after a header line where one leads it."""
    paragraph = body.rfind("\n\n", 0, start) + 2 if "\n\n" in body[:start] else 0
    last = max((m.end() for m in SENTENCE_END.finditer(body[paragraph:start])), default=0) + paragraph
    begin = last if start - last < BACK else start
    line, newline, rest = body[begin:end].partition("\n")
    line, rest = line.strip(), rest.lstrip()
    header = newline and line and len(line) < HEADER and line[-1] not in ".!?" and rest[:1].isupper()
    return body.index("\n", begin) + 1 if header else begin


def _forward(body: str, begin: int, end: int, cap: int) -> int:
    """The end of the sentence a span ends in: of a line's colon, of the paragraph or at the cap where none comes."""
    ahead = body[end : begin + cap]
    if m := SENTENCE_END.search(ahead):
        return end + m.end()
    if m := re.search(r":\s*(?:\n|$)", ahead[:COLON]):
        return end + m.end()
    gap = body.find("\n\n", end)
    out = gap if end < gap < end + PARAGRAPH else min(len(body), begin + cap)
    return out if out > end else min(len(body), end + SPARE)


def repair_quote(quote: str | None, body: str | None, cap: int = QUOTE_CAP) -> str | None:
    """A quote widened to whole sentences of the text it comes from, without a header line above it; as it was (trimmed) where it
    is not found, is whole already, or what came out does not cover it."""
    plain = (quote or "").strip()
    if not plain or not body:
        return quote
    span = _located(plain, body)
    if span is None or _whole(body, *span):
        return plain
    begin = _back(body, *span)
    out = body[begin : _forward(body, begin, span[1], cap)].strip()
    if len(out) > cap:
        cut = out[:cap]
        out = (cut.rsplit(" ", 1)[0] if " " in cut else cut).rstrip(".,;:") + "…"
    at = body.lower().find(out.lower()) if out else -1
    covers = 0 <= at <= span[0] and at + len(out) >= span[1] - 2
    return out if covers and len(out) >= len(plain) else plain


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Vectorised Python: the Ratcliff-Obershelp ratio of two texts; null where one is."""
    return pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 6) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def repaired(quote: pd.Series, body: pd.Series) -> pd.Series:
    """Vectorised Python."""
    return pd.Series([repair_quote(q, b) for q, b in zip(quote, body)])


def methodology_text(body: str | None, status: str | None, cap: int = 18000) -> str:
    """The part of a text that can be audited: abstract, methods and results of a paper, paragraphs on method elsewhere."""
    if not body or body.startswith("FETCH_ERROR"):
        return ""
    low = body[:12000].lower()
    paper = (status or "").lower() not in ("", "unpublished") or sum(m in low for m in C.PAPER_MARKERS) >= 2
    if not paper:
        kept = "\n\n".join(p.strip() for p in body.split("\n\n") if p.strip() and re.search(P.DEBATE_WORDS, p))
        return (kept if len(kept) >= 500 else body)[:cap]
    parts = []
    for title, first, last, least, most in (("ABSTRACT / STUDY DESIGN", P.ABSTRACT_START, P.METHODS_START, 100, cap), ("METHODS", P.METHODS_START, P.METHODS_END, 200, cap), ("RESULTS (sample sizes / outcomes)", P.RESULTS_START, P.RESULTS_END, 80, 4000)):
        a = re.search(first, body)
        if a:
            b = re.compile(last).search(body, a.end())
            text = body[a.start() : b.start() if b else len(body)].strip()
            if len(text) >= least:
                parts.append(f"=== {title} ===\n{text[:most]}")
    return ("\n\n".join(parts) if parts else body)[:cap]


@F.pandas_udf(T.StringType())
def audit_text(body: pd.Series, status: pd.Series) -> pd.Series:
    """Vectorised Python."""
    return pd.Series([methodology_text(b, s) for b, s in zip(body, status)])
