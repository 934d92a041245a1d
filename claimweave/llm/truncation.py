"""Problem 9: text cut off by field limits.

A structural completeness check with a stack automaton: quotes, brackets, markup, escapes and multibyte sequences left open,
and missing terminators, judged against baselines of each source (terminators, things left open, field limits) and of the
corpus (closing lines, markers of cuts, words).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import bounded, keyed_join, ship, stash

#: A closing line or remark counts as one where so many texts end with it and this share of its uses are at an end.
CLOSER_SUPPORT, CLOSER_SHARE = 3, 0.8
#: A length is a field limit where it is the source's greatest and so many texts, and this share of its texts, have it.
LIMIT_SUPPORT, LIMIT_SHARE = 3, 0.005
#: A byte limit that drops a broken sequence leaves up to so many bytes less.
BYTE_SLACK = 3
#: Texts with fewer than one full stop in so many words are unpunctuated transcripts.
WORDS_PER_STOP = 150
#: In a source where so many texts and more than this share leave a bracket, quote or element open, an open one tells nothing.
OPEN_SUPPORT, OPEN_SHARE = 3, 0.05
#: In a source where so many texts, and less than this share of all, end with a terminator, a missing one tells nothing.
PLAIN_SUPPORT, PLAIN_SHARE = 3, 0.5
#: What stands in brackets at the end of so many texts, this share of which break off before it, marks a cut.
MARKER_SUPPORT, MARKER_SHARE = 3, 0.5
#: Words of at most so many letters are known by the source's own texts: some language has nearly each of them.
SHORT = 3
_FLUSH = 200_000

_STOP = re.compile(r"[.?!…]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENDS = re.compile(r"[.?!][\"”»’')\]]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)$")
_MARKER = re.compile(r"\s*[\[(<{]\s*(?:\.{2,}|…|[^\[\](){}<>.?!]{0,40})\s*[\])>}]\s*$")
# what a broken multibyte sequence, element, entity or escape leaves at the very end: at most 210 characters
_DEBRIS = re.compile(r"(?:�+|<[/!]?[A-Za-z][^<>]{0,200}|<[/!]?|&#?\w{0,8}|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|%[0-9A-F]?|[ÃÂâ][\x80-\xbf€]?|=[0-9A-F]?)$")
_LIST = re.compile(r"(?:[-*•–]|\d{1,3}[.)]|[a-z]\))\s+\S")
_OPENER = re.compile(r"(?:(?<=^)|(?<=[.?!…][\"”»)]\s)|(?<=[.?!…]\s)|(?<=\n))[\s\"“«(¿¡—–-]*([^\W_][^\s]*)[ \t]+([^\s]+)")
_OPEN, _CLOSE = "([{“«", ")]}”»"


def left_open(text: str) -> str:
    """What a stack automaton over brackets, quotes and markup still holds at the end; closers without an opener are passed over."""
    stack: list[str] = []
    straight = False
    for m in re.finditer(r"[()\[\]{}“”«»\"]|</?([A-Za-z][A-Za-z0-9]*)\b[^<>]*(/?)>", text):
        token = m[0]
        if token == '"':
            if straight:
                while stack and stack[-1] != '"':
                    stack.pop()
                if stack:
                    stack.pop()
            else:
                stack.append('"')
            straight = not straight
        elif token[0] == "<":
            name = (m[1] or "").lower()
            if name in ("br", "hr", "img", "p", "li", "td", "tr") or m[2]:
                continue
            if token[1] == "/":
                if "<" + name in stack:
                    while stack.pop() != "<" + name:
                        pass
            else:
                stack.append("<" + name)
        elif token in _OPEN:
            stack.append(token)
        else:
            want = _OPEN[_CLOSE.index(token)]
            if stack and stack[-1] == want:
                stack.pop()
    return "".join(x[0] for x in stack)


def opener(line: str) -> str | None:
    """The first two words (the first alone before a colon) of a sentence or line; digits are taken as one."""
    m = _OPENER.match(line)
    return _key(m[1], m[2]) if m else None


def _key(first: str, second: str) -> str:
    return re.sub(r"\d+", "0", first if first[-1] == ":" else f"{first} {second}").rstrip(".…,")


def ending(text: str) -> tuple[str, str | None, str | None, bool, bool]:
    """(kind, key, word, ended, holds) of how a text ends.

    kind: blank, closed (complete), cut (broken off for certain), remark (ellipsis), line (an unterminated last line that may
    be a signature or note), list, marked (a bracketed end), transcript (unpunctuated), open (nothing closes it). key: the
    opener or marker to look up; word: the last word where it may decide; ended: whether a terminator stands at the end, or
    before the marker or last line; holds: whether the automaton, run over the whole text, still has a bracket or element open, or a
    quote that the text does not end with.
    """
    end = text.rstrip()
    if not end:
        return "blank", None, None, False, False
    held = left_open(end)
    holds = bool(set(held) - set('"“«')) or (bool(held) and end[-1] not in '"”»')
    ended = bool(_ENDS.search(end) or _ELLIPSIS.search(end))
    last = end.split()[-1].lower()
    word = last if _TOKEN.fullmatch(last) else None
    if _DEBRIS.search(end[-210:]):
        return "cut", None, None, ended, holds
    m = _MARKER.search(end)
    if m:
        before = bool(_ENDS.search(end[: m.start()].rstrip()))
        return "marked", re.sub(r"[\W\d_]+", " ", m[0].lower()).strip() or m[0].strip()[1:-1].strip(), None, before, holds
    words = len(end.split())
    plain = words >= 25 or not re.search(r"[A-Z,;:]", end)
    if len(_STOP.findall(end)) * WORDS_PER_STOP < words and plain and end[-1] not in ".?!…":
        return ("transcript" if word else "open" if not last[-1].isdigit() else "closed"), None, word, ended, holds
    if _ELLIPSIS.search(end):
        body = _ELLIPSIS.sub("", end).rstrip()
        sentence = re.split(r"(?<=[.?!…])[\"”»)]*\s+|\n", body)[-1]
        if not sentence or _ENDS.search(body):
            return "closed", None, None, ended, holds
        key = opener(sentence)
        return ("remark", key, None, ended, holds) if key and len(sentence.split()) <= 8 else ("cut", None, None, ended, holds)
    if ended:
        # a quote that is still open above all else makes the stop one within it
        return ("cut" if holds and held[-1:] in ('"', "“", "«") else "closed"), None, None, ended, holds
    line = end.rsplit("\n", 1)[-1].strip() if "\n" in end else ""
    if line:  # a signature, note or list item has the terminator before it
        ended = bool(_ENDS.search(end[: end.rindex("\n")].rstrip()))
    if not line or end[-1] in ",;:-–—(\"'“«¿¡/":
        return "open", None, word, ended, holds
    if _LIST.match(line):
        return "list", None, word, ended, holds
    return "line", opener(line), word, ended, holds


def endings(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, n_chars, n_bytes, kind, key, word, ended, holds) of every row; a null text counts as blank."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(2):
                text = text.as_py() or ""
                rows.append((xxhash.xxh3_128_digest(text), len(text), len(text.encode("utf-8", "surrogatepass")), *ending(text)))
            c = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c[0], pa.binary()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), *[pa.array(x, pa.string()) for x in c[3:6]], *[pa.array(x, pa.bool_()) for x in c[6:8]]], ["doc_id", "source", "digest", "n_chars", "n_bytes", "kind", "key", "word", "ended", "holds"])

    return docs.select("doc_id", "source", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, source string, digest binary, n_chars int, n_bytes int, kind string, key string, word string, ended boolean, holds boolean")


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(what, key, n): how many texts hold a sentence opener ('o') or a word not at the very end ('w'; 's' for short words, with
    the source before the word), over all rows.

    Counts are added up within a partition before the shuffle; the table held there is bounded.
    """
    ship(docs.sparkSession)

    def run(batches):
        counts: dict[tuple[str, str], int] = {}
        for batch in batches:
            for text, source in zip(batch.column(0), batch.column(1).to_pylist()):
                text = (text.as_py() or "").rstrip()
                if not text:
                    continue
                seen = {("o", _key(a, b)) for a, b in _OPENER.findall(text)}
                low = text.lower()
                cut = max(low.rfind(" "), low.rfind("\n"), 0) if text[-1].isalpha() else len(low)
                words = set(_TOKEN.findall(low[:cut]))
                seen |= {("w", w) for w in words}
                seen |= {("s", f"{source or ''}\0{w}") for w in words if len(w) <= SHORT}
                for k in seen:
                    counts[k] = counts.get(k, 0) + 1
            if len(counts) > _FLUSH:
                yield made(counts)
                counts = {}
        yield made(counts)

    def made(counts):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["what", "key", "n"])

    return docs.select(F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).mapInArrow(run, "what string, key string, n bigint").groupBy("what", "key").agg(F.sum("n").alias("n"))


def source_baselines(ends: DataFrame, label: str = "cut") -> DataFrame:
    """(source, rows, max_chars, max_bytes, habit, plain), a row per source: the lengths at which it cuts its texts (null where
    it has no such limit), whether it leaves things open by habit, and whether its texts go without terminators."""
    blank = F.col("kind") == "blank"
    size = ends.where("source IS NOT NULL").groupBy("source").agg(
        F.max("n_chars").alias("c"), F.max("n_bytes").alias("b"), F.count("*").alias("rows"), F.count_if(~blank).alias("texts"), F.count_if("ended").alias("ended"),
        # what is judged cut or open for other reasons doesn't count as a habit
        F.count_if(F.col("holds") & ~F.col("kind").isin("cut", "open")).alias("held"),
    )
    size = stash(size, label + "-b")
    habit = (F.col("held") >= OPEN_SUPPORT) & (F.col("held") > OPEN_SHARE * F.col("rows"))
    plain = (F.col("texts") >= PLAIN_SUPPORT) & (F.col("ended") < PLAIN_SHARE * F.col("texts"))
    sized = keyed_join(ends.select("source", "n_chars", "n_bytes"), size.select("source", "c", "b", "rows", F.col("rows").alias("n")), "source")
    near = sized.groupBy("source").agg(
        F.first("rows").alias("r"), F.count_if(F.col("n_chars") == F.col("c")).alias("at_c"), F.count_if(F.col("n_bytes") > F.col("b") - BYTE_SLACK).alias("at_b"), F.count_if((F.col("n_bytes") <= F.col("b") - BYTE_SLACK) & (F.col("n_bytes") > F.col("b") - 10 * BYTE_SLACK)).alias("below_b")
    )
    enough = lambda n: (F.col(n) >= LIMIT_SUPPORT) & (F.col(n) >= LIMIT_SHARE * F.col("r"))
    out = size.join(near, "source").select("source", "rows", F.when(enough("at_c"), F.col("c")).alias("max_chars"), F.when(enough("at_b") & (F.col("at_b") > F.col("below_b")), F.col("b")).alias("max_bytes"), habit.alias("habit"), plain.alias("plain"))
    return stash(out, label + "-l")


def judged(docs: DataFrame, label: str = "cut") -> DataFrame:
    """(doc_id, source, truncated): one row per row of docs.

    Blank and null texts are complete. A text is judged with its copies: one broken-off copy makes all of them cases.
    Null sources have no baseline. Extra columns are ignored.
    """
    ends = stash(endings(docs), label + "-e")
    counts = stash(corpus_counts(docs), label + "-s")
    known = keyed_join(ends, source_baselines(ends, label), "source", "left", n="rows")
    no = lambda c: F.coalesce(c, F.lit(False))
    full = no(F.col("n_chars") == F.col("max_chars")) | no(F.col("n_bytes") > F.col("max_bytes") - BYTE_SLACK)
    # in a source without terminators a text is judged like a transcript, by its last word
    kind = F.when(no(F.col("plain")) & F.col("kind").isin("open", "line") & F.col("word").isNotNull(), "transcript").otherwise(F.col("kind"))
    placed_word = F.when(F.length("word") <= SHORT, F.concat(F.coalesce("source", F.lit("")), F.lit("\0"), "word")).otherwise(F.col("word"))
    based = known.select("doc_id", "source", "digest", kind.alias("kind"), "key", "word", "ended", full.alias("full"), (F.col("holds") & ~no(F.col("habit"))).alias("held"), placed_word.alias("at"))
    # closing lines and remarks: openers that stand at the end of texts nearly always; markers: bracketed ends after a break
    last = ends.where("kind IN ('remark', 'line') AND key IS NOT NULL").groupBy("kind", "key").agg(F.count("*").alias("at_end"))
    closers = last.join(counts.where("what = 'o'").select("key", "n"), "key").where((F.col("at_end") >= CLOSER_SUPPORT) & (F.col("at_end") >= CLOSER_SHARE * F.col("n"))).select("kind", "key")
    markers = ends.where("kind = 'marked'").groupBy("kind", "key").agg(F.count("*").alias("at_end"), F.count_if(~F.col("ended")).alias("broken")).where((F.col("at_end") >= MARKER_SUPPORT) & (F.col("broken") >= MARKER_SHARE * F.col("at_end"))).select("kind", "key")
    told = stash(closers.unionByName(markers).withColumn("told", F.lit(True)), label + "-c")
    # broken-off words: nowhere else a word, and the beginning of words that are
    # (short ones: nowhere else in their source)
    wanted = ends.where("word IS NOT NULL").select(placed_word.alias("at"), "word").distinct()
    words = counts.where("what = 'w'").select(F.col("key").alias("word"), "n")
    known_words = words.where(F.length("word") > SHORT).select(F.col("word").alias("at")).unionByName(counts.where("what = 's'").select(F.col("key").alias("at")))
    strange = wanted.join(known_words, "at", "left_anti")
    begins = words.where("n >= 2").select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> left(word, i))")).alias("word"))
    broken = stash(strange.join(begins, "word", "left_semi").select("at", F.lit(True).alias("broken")), label + "-w")
    # texts without key or word take keys of their own, so that they don't meet in one task
    own_key = lambda c: F.coalesce(c, F.concat(F.lit("\0"), F.col("doc_id").cast("string"))).alias(c)
    spread = based.select("doc_id", "source", "digest", "kind", "ended", "full", "held", own_key("key"), own_key("at"))
    seen = spread.join(bounded(told), ["kind", "key"], "left").join(bounded(broken), "at", "left")
    verdict = (
        F.when(F.col("kind").isin("cut", "open") | F.col("held"), True)
        .when(F.col("kind").isin("blank", "closed"), False)
        .when(F.col("kind") == "marked", ~F.col("ended") | F.col("told").isNotNull())
        .when(F.col("kind") == "remark", F.col("told").isNull())
        .when(F.col("kind") == "line", F.col("full") | F.col("told").isNull())
        .when(F.col("kind") == "list", F.col("full") | no(F.col("broken")))
        .otherwise(no(F.col("broken")))
    )
    own = stash(seen.select("doc_id", "source", "digest", verdict.alias("own")), label + "-v")
    copies = stash(own.groupBy("digest").agg(F.count("*").alias("n"), F.bool_or("own").alias("hit")).where("n > 1"), label + "-d")
    return keyed_join(own, copies, "digest", "left").select("doc_id", "source", F.coalesce("hit", "own").alias("truncated"))


def rates(verdicts: DataFrame) -> DataFrame:
    """(source, n_docs, n_truncated, rate): how often each source truncates; the null source is a row of its own."""
    return verdicts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("truncated").cast("long")).alias("n_truncated")).withColumn("rate", F.round(F.col("n_truncated") / F.col("n_docs"), 6))
