"""Problem 4: splitting oversized items at natural boundaries.

Structure-tree packing: a body is parsed into a tree of sections (nested by the level of their headings) and paragraphs;
sibling subtrees that fit are merged to the limit from the bottom up, and only oversized nodes are descended into, below
paragraphs by turns or list items, sentences, lines and words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import bounded, ship, table

LIMIT, OVERLAP = 4000, 250
WHITE = " \t\r\n\f"
_HEAD = re.compile(r"(?m)^(?:#{1,6} [^\n]*|(?:\d+\.)+ [A-Z][^\n.?!]{0,70}|[A-Z][A-Za-z ]{2,40}:?|Title: [^\n]*)$")
_GAP = re.compile(r"\n[ \t\r\f]*(?:\n[ \t\r\f]*)+")
_SPEECH = re.compile(r"\n(?=\[\d+:\d\d|[A-Z][A-Z ]{2,30}: |- |\* |\d+\. )")
_LINE = re.compile(r"\n")
_STOP = re.compile(r"[.?!…][\"”»)\]]?\s+")
_SPACE = re.compile(r"\s+")

Span = tuple[int, int]


def cleaned(body: str) -> str:
    """CR LF as one line end, and no white space around."""
    return body.replace("\r\n", "\n").strip(WHITE)


def _cuts(text: str, span: Span, at: list[int]) -> list[Span]:
    edges = [span[0], *sorted({x for x in at if span[0] < x < span[1]}), span[1]]
    return list(zip(edges[:-1], edges[1:]))


def paragraphs(text: str, span: Span) -> list[Span]:
    """Spans that start where text follows a run of blank lines; the blank lines belong to the paragraph before."""
    return _cuts(text, span, [m.end() for m in _GAP.finditer(text, *span)])


@dataclass
class Node:
    """A section (level > 0), the body (level 0) or a paragraph (no > 0) of a text."""

    start: int
    end: int
    level: int = 0
    no: int = 0
    children: list[Node] = field(default_factory=list)


def heading_level(line: str) -> int:
    """The level of a heading line, 1 the highest; 0 for other lines. A numbered heading is as deep as its number; a bare
    title line is the deepest."""
    if not _HEAD.fullmatch(line):
        return 0
    if line.startswith("#"):
        return len(line) - len(line.lstrip("#"))
    number = re.match(r"(?:\d+\.)+", line)
    return number[0].count(".") if number else 1 if line.startswith("Title: ") else 7


def tree(text: str) -> Node:
    """The body as a node: a heading opens a section that holds all up to the next heading of its level or a higher one."""
    body = Node(0, len(text))
    open_ = [body]
    for no, (a, b) in enumerate(paragraphs(text, (0, len(text))), 1):
        level = heading_level(text[a:b].strip(WHITE).split("\n")[0].strip(WHITE))
        if level:
            while open_[-1].level >= level:
                open_.pop()
            section = Node(a, b, level)
            open_[-1].children.append(section)
            open_.append(section)
        open_[-1].children.append(Node(a, b, 0, no))
        for node in open_[1:]:
            node.end = b
    return body


def _by(pattern: re.Pattern, end: bool):
    return lambda text, span: _cuts(text, span, [m.end() if end else m.start() + 1 for m in pattern.finditer(text, *span)])


def _hard(limit: int):
    return lambda text, span: [(x, min(span[1], x + limit)) for x in range(span[0], span[1], limit)]


def levels(kind: str | None) -> list:
    """The splitters of a paragraph from the coarsest to the finest; lines of transcripts come before sentences."""
    fine = [_by(_LINE, True), _by(_STOP, True)] if kind == "video" else [_by(_STOP, True), _by(_LINE, True)]
    return [_by(_SPEECH, False), *fine, _by(_SPACE, True)]


def packed(text: str, span: Span, splitters: list, limit: int) -> list[Span]:
    """Consecutive spans of at most limit characters that cover a paragraph; only what is larger is split further, and a word
    beyond the limit by characters."""
    if span[1] - span[0] <= limit:
        return [span]
    if not splitters:
        return _hard(limit)(text, span)
    parts = splitters[0](text, span)
    if len(parts) == 1:
        return packed(text, span, splitters[1:], limit)
    out: list[Span] = []
    for part in parts:
        for piece in packed(text, part, splitters[1:], limit):
            if out and piece[1] - out[-1][0] <= limit:
                out[-1] = (out[-1][0], piece[1])
            else:
                out.append(piece)
    return out


def packed_tree(text: str, node: Node, splitters: list, limit: int, entered: list[Node]) -> list[Span]:
    """Consecutive spans of at most limit characters that cover a node; the nodes descended into are added to entered.

    Whole sibling subtrees are merged while they fit. The parts of an oversized paragraph may be merged with its neighbours
    in the section, those of an oversized section with nothing outside it.
    """
    if node.end - node.start <= limit:
        return [(node.start, node.end)]
    entered.append(node)
    if node.no:
        return packed(text, (node.start, node.end), splitters, limit)
    out: list[Span] = []
    closed = True
    for child in node.children:
        parts = packed_tree(text, child, splitters, limit, entered)
        split_section = not child.no and len(parts) > 1
        if out and not closed and not split_section and parts[0][1] - out[-1][0] <= limit:
            out[-1] = (out[-1][0], parts[0][1])
            parts = parts[1:]
        out += parts
        closed = split_section
    return out


def split(text: str, kind: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
    """Of a cleaned body the pieces (piece, characters repeated), which join to it again without what is repeated, and the
    oversized nodes (para_no, length) of body (0) and paragraph level that were descended into."""
    if not text:
        return [], []
    if len(text) <= limit:
        return [(text, 0)], []
    entered: list[Node] = []
    pieces: list[tuple[str, int]] = []
    before = ""
    for a, b in packed_tree(text, tree(text), levels(kind), limit - overlap, entered):
        head = before[-overlap:] if overlap else ""
        pieces.append((head + text[a:b], len(head)))
        before = pieces[-1][0]
    sizes = [(n.no, len(text[n.start : n.end].strip(WHITE))) for n in entered if not n.level]
    return pieces, [(no, size) for no, size in sizes if size > limit]


def content_kinds(sources: DataFrame) -> DataFrame:
    """(source_id, kind): content_type in even spelling; of repeated entries the least non-empty one."""
    kind = F.lower(F.trim("content_type"))
    return sources.where("source_id IS NOT NULL").groupBy("source_id").agg(F.min(F.when(kind != "", kind)).alias("kind"))


def split_bodies(docs: DataFrame, kinds: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(capture_id, node, no, n_chars, repeated, piece): node 'piece' rows are the pieces; 'body' and 'paragraph' rows the
    oversized nodes the tree descended into.

    A null or blank body gives no row; one within the limit gives one piece. A row with a null capture_id keeps it. kinds is
    broadcast where it is small. Nothing else is shuffled.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for cid, body, kind in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = cleaned(body.as_py() or "")
                pieces, oversized = split(text, kind, limit, overlap)
                rows += [(cid, "paragraph" if no else "body", no, size, 0, None) for no, size in oversized]
                rows += [(cid, "piece", no, len(piece), again, piece) for no, (piece, again) in enumerate(pieces, 1)]
                held += len(text)
                if held > 8_000_000:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    def made(rows):
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.string())], ["capture_id", "node", "no", "n_chars", "repeated", "piece"])

    joined = docs.select("capture_id", "source_id", "body").join(bounded(kinds), "source_id", "left").select("capture_id", "body", "kind")
    return joined.mapInArrow(run, "capture_id bigint, node string, no int, n_chars int, repeated int, piece string")


def rejoined(rows: DataFrame) -> DataFrame:
    """(capture_id, n_chars, digest, fits, repeats) of the pieces: what they join to without the repeated characters, whether
    all keep the limit, and whether each begins with the end of the one before. A capture's pieces are as large as its body."""
    p = rows.where("node = 'piece'").groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("no", "n_chars", "repeated", "piece"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.substring(x["piece"], x["repeated"] + 1, x["n_chars"])), "")
    fits = F.forall("p", lambda x: x["n_chars"] <= LIMIT)
    repeats = F.forall(F.slice("p", 2, F.size("p")), lambda x: x["repeated"] > 0)
    again = F.transform("p", lambda x, i: (i == 0) | (F.left(x["piece"], x["repeated"]) == F.right(F.element_at("p", F.greatest(i, F.lit(1)))["piece"], x["repeated"])))
    return p.select("capture_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"), fits.alias("fits"), (repeats & F.forall(again, lambda x: x)).alias("repeats"))


def run(spark, sf_dir: str) -> DataFrame:
    return split_bodies(table(spark, sf_dir, "raw_docs"), content_kinds(table(spark, sf_dir, "sources")))
