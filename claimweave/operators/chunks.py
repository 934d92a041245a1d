"""Passages of bodies: blocks packed to a size, offsets to pieces, halving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed_blocks(parts: Column, limit: int) -> Column:
    """Blocks from an array of paragraphs, joined by blank lines: a block is closed where it and the next paragraph would
    together exceed the limit (without the separator)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        cur, done = acc["cur"], acc["done"]
        full = (cur != "") & (F.length(cur) + F.length(p) > limit)
        return F.struct(
            F.when(full, F.concat(done, F.array(cur))).otherwise(done).alias("done"),
            F.when(full | (cur == ""), p).otherwise(F.concat(cur, F.lit("\n\n"), p)).alias("cur"),
        )

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def valid_offsets(c: Column) -> Column:
    """Offsets of a JSON list where all are whole numbers; null otherwise."""
    numbers = F.from_json(c, "array<double>")
    ok = c.rlike(r"^\s*\[\s*(-?\d+(\.0+)?\s*(,\s*-?\d+(\.0+)?\s*)*)?\]\s*$")
    return F.when(ok, F.transform(numbers, lambda x: x.cast("bigint")))


def pieces(text: Column, offsets: Column) -> Column:
    """Trimmed non-blank pieces of a text between the sorted distinct offsets, 0 and its end."""
    end = F.length(text).cast("bigint")
    inside = F.filter(offsets, lambda x: (x > 0) & (x < end))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), inside, F.array(end))))
    cut = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.trim(F.substring(text, (F.element_at(edges, i) + 1).cast("int"), (F.element_at(edges, i + 1) - F.element_at(edges, i)).cast("int"))))
    return F.when(end == 0, F.array().cast("array<string>")).otherwise(F.filter(cut, lambda p: p != ""))


def halves(text: Column) -> Column:
    """A text in two: at its middle paragraph, or at its middle character where it has one paragraph."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\f\r"))), lambda p: p != "")
    k = F.floor(F.size(parts) / 2).cast("int")
    by_part = F.array(F.array_join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(1))), "\n\n"), F.array_join(F.slice(parts, k + 1, F.size(parts)), "\n\n"))
    m = F.floor(F.length(text) / 2).cast("int")
    return F.when(F.size(parts) >= 2, by_part).otherwise(F.array(F.substring(text, F.lit(1), m), F.substring(text, m + 1, F.length(text))))


def chunk_header(section: Column, hint: Column, context: Column) -> Column:
    head = F.concat(F.lit("[SECTION: "), section, F.lit(" | EPISTEMIC: "), hint, F.lit("]"))
    return F.when(F.coalesce(context, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n[PRIOR CONTEXT: "), context, F.lit("]")))


def blocks(bodies: DataFrame, limit: int) -> DataFrame:
    """(capture_id, idx, text): blocks of a body; blank paragraphs are dropped."""
    parts = F.filter(F.transform(F.split("body", "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\f\r"))), lambda p: p != "")
    return bodies.select("capture_id", F.posexplode(packed_blocks(parts, limit)).alias("idx", "text"))
