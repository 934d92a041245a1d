"""The claim graph: clean relations, source keys, adjacency, merging and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave import config as C


def one_per_id(nodes: DataFrame, *columns: str) -> DataFrame:
    """Deliveries of an id differ in loaded_at only: distinct rows of the wanted columns are its record."""
    return nodes.select("id", *columns).distinct()


def source_key() -> Column:
    """Trimmed source_id, else trimmed author; null where both are blank."""
    return F.coalesce(F.nullif(F.trim("source_id"), F.lit("")), F.nullif(F.trim("author"), F.lit("")))


def keyed_attestations(attestations: DataFrame) -> DataFrame:
    return attestations.withColumn("sk", source_key())


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def relation_type() -> Column:
    return F.translate(F.lower(F.trim("type")), " -", "__")


def clean_relations(relations: DataFrame) -> DataFrame:
    """Ids and types in even spelling, one row per (src, dst, type): the first by rel_ord."""
    flat = relations.select(
        F.lower(F.trim("src")).alias("src"), F.lower(F.trim("dst")).alias("dst"), relation_type().alias("type"), "strength", "rationale", "source", "shared_question", "rel_ord", "created_at"
    )
    order = ["rel_ord", "created_at", F.coalesce("strength", F.lit(-1.0)), F.coalesce("rationale", F.lit("")), F.coalesce("shared_question", F.lit("")), F.coalesce("source", F.lit(""))]
    return first_of(flat, ["src", "dst", "type"], order)


def guarded_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations that may enter the graph: both ends exist, no self-loop, a known type, unique."""
    ids = nodes.select("id").distinct()
    ok = clean_relations(relations).where(F.col("type").isin(*C.RELATION_TYPES) & (F.col("src") != F.col("dst")))
    return ok.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def conflict_pairs(relations: DataFrame) -> DataFrame:
    return undirected(relations.where(F.col("type").isin(*C.CONFLICT_TYPES)))


def without_conflicts(pairs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Pairs (a, b), in either order, that no conflict edge links."""
    keyed = pairs.withColumn("__x", F.least("a", "b")).withColumn("__y", F.greatest("a", "b"))
    return keyed.join(conflicts.select(F.col("a").alias("__x"), F.col("b").alias("__y")), ["__x", "__y"], "left_anti").drop("__x", "__y")


def backfilled(attestations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attestations, and for a node without any but with a source, evidence or quote, one made of these."""
    att = attestations.select("node_id", "source_id", "author", "quote", F.lit(False).alias("made"))
    own = one_per_id(nodes, "source_id", "source_author", "textual_evidence", "quote_exact")
    quote = F.coalesce(F.nullif("textual_evidence", F.lit("")), F.nullif("quote_exact", F.lit("")))
    some = (F.coalesce("source_id", F.lit("")) != "") | quote.isNotNull()
    made = own.join(attestations.select(F.col("node_id").alias("id")).distinct(), "id", "left_anti").where(some).select(F.col("id").alias("node_id"), "source_id", F.col("source_author").alias("author"), quote.alias("quote"), F.lit(True).alias("made"))
    return att.unionByName(made)


def attestation_union(attestations: DataFrame, ids: DataFrame) -> DataFrame:
    """(canonical, source, quote): attestations of merged nodes under the canonical id, one per source and trimmed quote."""
    moved = attestations.join(ids.select(F.col("id").alias("node_id"), "canonical"), "node_id", "left").select(
        F.coalesce("canonical", "node_id").alias("canonical"), F.coalesce(F.trim("source_id"), F.lit("")).alias("source_id"), F.coalesce(F.trim("quote"), F.lit("")).alias("quote")
    )
    return moved.distinct()


def redirected(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Both ends moved to canonical nodes, self-loops dropped, one row per (src, dst, type) with the greatest strength."""
    a = ids.select(F.col("id").alias("src"), F.col("canonical").alias("src2"))
    b = ids.select(F.col("id").alias("dst"), F.col("canonical").alias("dst2"))
    moved = relations.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("src2", "src").alias("src"), F.coalesce("dst2", "dst").alias("dst"), "type", "strength")
    return moved.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("strength").alias("strength"))


def canonical_members(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, canonical): of each group (id, group_id) the node of greatest weight (null as 0), then the least id."""
    rows = groups.join(one_per_id(nodes, "evidential_weight"), "id")
    best = rows.groupBy("group_id").agg(F.min_by("id", F.struct(-F.coalesce("evidential_weight", F.lit(0.0)), F.col("id"))).alias("canonical"))
    return rows.join(best, "group_id").select("id", "canonical")


def expand(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, id, depth): ids reached from each start id over directed edges in at most depth steps, at least depth."""
    seen = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("next")), "id").select("root", F.col("next").alias("id")).distinct()
        front = step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of new replace the non-null columns of old and are inserted where their key is unknown."""
    o, n = old.select(key, *columns), new.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose keys are not there, with `added`."""
    return old.select(*keys, F.lit(False).alias("added")).unionByName(new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").select(*keys, F.lit(True).alias("added")))


def replaced(old: DataFrame, new: DataFrame, column: str, provenance: str) -> DataFrame:
    """old without the rows of one provenance (rows of none stay), and new: running a step again gives the same table."""
    return old.where(F.col(column).isNull() | (F.col(column) != provenance)).unionByName(new)
