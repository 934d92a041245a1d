"""Problem 1: best representative of each duplicate group.

Currency reasoning: precedence between attribute values is learnt from rows with timestamps, each group is given a partial
order, and rows without a timestamp take their place in it, so that the topologically latest values survive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.components import seed_tree_components
from claimweave.runtime import bounded, keyed_join, ship, small_enough, stash

#: A transition counts as precedence when so many groups show it and this share of those that show either direction agrees.
MIN_SUPPORT, MIN_SHARE = 3, 0.6
#: An attribute with more distinct values than this is no closed set and can't be reasoned with.
MAX_VALUES = 256
WHITE = "[\\p{IsWhite_Space}\\x1c-\\x1f]"


def collapsed(text: str) -> Column:
    """Trimmed, each run of white space one blank."""
    return F.trim(F.regexp_replace(F.col(text), f"{WHITE}+", " "))


def trimmed(text: str) -> Column:
    return F.regexp_replace(F.col(text), f"^{WHITE}+|{WHITE}+$", "")


def transitions(rows: DataFrame, group: str, when: str, attribute: str) -> DataFrame:
    """(old, new, n): in how many groups all dated rows with value old come before all with value new.

    Each group contributes first and last time per value, so it is never gathered, however large it is.
    """
    span = rows.where(F.col(when).isNotNull() & F.col(attribute).isNotNull()).groupBy(F.col(group).alias("g"), F.col(attribute).cast("string").alias("v")).agg(F.min(when).alias("lo"), F.max(when).alias("hi"))
    a, b = span.alias("a"), span.alias("b")
    return a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.hi") < F.col("b.lo"))).groupBy(F.col("a.v").alias("old"), F.col("b.v").alias("new")).agg(F.count("*").alias("n"))


def learnt_precedence(rows: DataFrame, group: str, when: str, attribute: str) -> set[tuple[str, str]]:
    """The pairs (earlier, later) of values of a closed-set attribute, closed under transitivity and free of cycles.

    A transition counts where MIN_SUPPORT groups show it and MIN_SHARE of those that show either direction agree; of those
    that would close a cycle the worst supported are left out. An attribute with more than MAX_VALUES values is not one of a
    closed set and is refused.
    """
    values = rows.select(F.col(attribute).cast("string").alias("v")).where("v IS NOT NULL").distinct()
    if not small_enough(values, MAX_VALUES):
        raise ValueError(f"{attribute} has more than {MAX_VALUES} values: it is no closed set")
    seen = {(r["old"], r["new"]): r["n"] for r in transitions(rows, group, when, attribute).collect()}  # at most MAX_VALUES squared
    strong = [(-n, old, new) for (old, new), n in seen.items() if n >= MIN_SUPPORT and n >= MIN_SHARE * (n + seen.get((new, old), 0)) and n > seen.get((new, old), 0)]
    before: set[tuple[str, str]] = set()
    for _, old, new in sorted(strong):
        if (new, old) not in before and old != new:
            lower = {x for x, y in before if y == old} | {old}
            upper = {y for x, y in before if x == new} | {new}
            before |= {(x, y) for x in lower for y in upper}
    return before


def placed_states(frame: pd.DataFrame, values: list[str], orders: list[set[tuple[str, str]]]) -> list[tuple[int, object, int]]:
    """(row, at, step) of each undated state of one group: frame has the values, `hi` (latest time of its dated rows) and `undated`.

    State s precedes t where some attribute says so and none says the opposite. An undated state stands right after the
    latest dated row among those that precede it, directly or through others; step is its place in the chain of undated
    states that stand there. States in a ring of contradicting attributes share their place.
    """
    rows = [tuple(r) for r in frame[values].itertuples(index=False)]
    hi, undated = frame["hi"].tolist(), frame["undated"].tolist()

    def precedes(s: tuple, t: tuple) -> bool:
        return any((x, y) in o for x, y, o in zip(s, t, orders)) and not any((y, x) in o for x, y, o in zip(s, t, orders))

    todo = [k for k in range(len(rows)) if undated[k]]
    under = {k: [j for j in range(len(rows)) if j != k and precedes(rows[j], rows[k])] for k in todo}
    at: dict[int, object] = {}
    for k in todo:  # everything below k, through undated states too
        seen, open_ = {k}, [k]
        while open_:
            for j in under.get(open_.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    open_ += [j] if undated[j] else []
        times = [hi[j] for j in seen if j != k and not pd.isna(hi[j])]
        at[k] = max(times) if times else None
    step: dict[int, int] = {}

    def depth(k: int, path: frozenset) -> int:
        if k not in step:
            below = [depth(j, path | {k}) for j in under[k] if undated[j] and j not in path and at[j] == at[k]]
            step[k] = 1 + max(below, default=0)
        return step[k]

    return [(k, at[k], depth(k, frozenset([k]))) for k in todo]


def currency(rows: DataFrame, group: str, when: str, attributes: list[str], label: str = "currency") -> DataFrame:
    """rows with `cur_at` and `cur_step`: order by both for the topologically latest.

    A row with a timestamp keeps it, at step 0. The rows of a group without one take their place in the group's partial
    order of states (combinations of attribute values), built from the learnt precedence of each attribute; where nothing
    precedes them, or their values are null, cur_at is null: older than all. States are as many per group as the closed sets
    allow, whatever its rows.
    """
    if not rows.where(F.col(when).isNull()).limit(1).count():
        return rows.withColumn("cur_at", F.col(when)).withColumn("cur_step", F.lit(0))
    orders = [learnt_precedence(rows, group, when, a) for a in attributes]
    names = [f"__v{i}" for i in range(len(attributes))]
    keyed = rows
    for name, a in zip(names, attributes):
        keyed = keyed.withColumn(name, F.coalesce(F.col(a).cast("string"), F.lit("\0")))
    kind = rows.schema[group].dataType.simpleString()
    states = keyed.groupBy(group, *names).agg(F.max(when).alias("hi"), F.bool_or(F.col(when).isNull()).alias("undated"), F.count_if(F.col(when).isNull()).alias("__n"))
    states = states.join(states.where("undated").select(group).distinct(), group, "left_semi")

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(names, ignore_index=True)
        got = placed_states(frame, names, orders)
        out = frame.loc[[k for k, _, _ in got], [group, *names, "__n"]].copy()
        return out.assign(__at=pd.Series([x for _, x, _ in got], index=out.index, dtype="datetime64[us, UTC]"), __step=[s for _, _, s in got])

    schema = f"`{group}` {kind}, " + ", ".join(f"{n} string" for n in names) + ", __n bigint, __at timestamp, __step int"
    placed = stash(states.groupBy(group).applyInPandas(place, schema), label)
    undated = keyed_join(keyed.where(F.col(when).isNull()), placed, [group, *names], n="__n").withColumnsRenamed({"__at": "cur_at", "__step": "cur_step"}).drop(*names)
    dated = rows.where(F.col(when).isNotNull()).withColumn("cur_at", F.col(when)).withColumn("cur_step", F.lit(0))
    return dated.unionByName(undated.select(*dated.columns))


def distinct_sources(attestations: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n_sources): distinct trimmed non-blank source_id per node in ids; nodes without any are absent."""
    att = attestations.select(F.col("node_id").alias("id"), trimmed("source_id").alias("s")).where("s <> ''")
    return att.join(bounded(ids), "id", "left_semi").distinct().groupBy("id").agg(F.count("*").alias("n_sources"))


def groups_of(members: DataFrame, links: DataFrame, label: str = "survive") -> DataFrame:
    """(group_id, id): ids (members: id, cid) of classes that are linked (links: a, b), directly or through others, or that have
    several ids; group_id is the smallest id. Classes are linked once, whatever the number of their ids."""
    comp = seed_tree_components(links, "a", "b", label).select(F.col("id").alias("cid"), F.col("group_id").alias("root"))
    rooted = stash(members.join(comp, "cid", "left").select("id", F.coalesce("root", "cid").alias("root")).distinct(), label + "-o")
    size = stash(rooted.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1"), label + "-s")
    return keyed_join(rooted, size, "root").select("group_id", "id")


def group_members(groups: DataFrame, nodes: DataFrame, attestations: DataFrame, label: str = "survive") -> DataFrame:
    """One row per grouped id (groups: group_id, id): len, weight, valid, n_sources, cur_at, cur_step and the ordered attributes.

    Repeated deliveries of an id count once. A blank attribute value counts as null.
    """
    ship(nodes.sparkSession)
    groups = stash(groups, label + "-g")
    ids = groups.select("id")
    filled = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    cut = nodes.select("id", F.length(collapsed("content")).alias("len"), F.col("evidential_weight").alias("weight"), "created_at", filled("status"), filled("epistemic_status"))
    one = cut.join(bounded(ids), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("len", "weight", "created_at", "status", "epistemic_status"), F.struct("created_at", "len")).alias("r")).select("id", "r.*")
    rows = groups.join(one, "id").join(distinct_sources(attestations, ids), "id", "left")
    rows = rows.select("group_id", "id", F.coalesce("len", F.lit(0)).alias("len"), "weight", F.coalesce(F.col("weight").between(0.0, 1.0), F.lit(False)).alias("valid"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "created_at", "status", "epistemic_status")
    return stash(currency(stash(rows, label + "-r"), "group_id", "created_at", ["epistemic_status", "status"], label + "-c"), label + "-m")


def _latest() -> list[Column]:
    """Sort keys of the smallest struct for: latest first, then the smallest id."""
    return [-F.coalesce(F.unix_micros("cur_at"), F.lit(-(1 << 62))), -F.col("cur_step"), F.col("id")]


def survivors(members: DataFrame) -> DataFrame:
    """(group_id, size, content_id, weight_id, value_id): for each group the members its fields come from.

    content_id has the longest content; weight_id, of the members with a weight within [0, 1] (null if there is none), most
    distinct sources; value_id is the most current record. Ties: latest, then smallest id.
    """
    pick = lambda first: F.struct(*[x.alias(f"k{i}") for i, x in enumerate([*first, *_latest()])])
    return members.groupBy("group_id").agg(
        F.count("*").alias("size"),
        F.min_by("id", pick([-F.col("len")])).alias("content_id"),
        F.min_by(F.when(F.col("valid"), F.col("id")), F.when(F.col("valid"), pick([-F.col("n_sources")]))).alias("weight_id"),
        F.min_by("id", pick([])).alias("value_id"),
    )


def merged_records(members: DataFrame, nodes: DataFrame, attestations: DataFrame, label: str = "merge") -> DataFrame:
    """One surviving record per group: content and weight from their best members, current status, all attestations counted."""
    best = stash(survivors(members), label)
    att = attestations.join(members.select(F.col("id").alias("node_id"), "group_id"), "node_id")
    kept = att.select("group_id", trimmed("source_id").alias("s"), trimmed("quote").alias("q")).distinct().groupBy("group_id").agg(F.count("*").alias("n_attestations"), F.count_distinct(F.when(F.col("s") != "", F.col("s"))).alias("n_sources"))
    wanted = best.select(F.col("content_id").alias("id"))
    text = nodes.select("id", "content").join(bounded(wanted), "id", "left_semi").groupBy("id").agg(F.first("content").alias("content"))
    weight = members.select(F.col("id").alias("weight_id"), "weight")
    value = members.select(F.col("id").alias("value_id"), "status", "epistemic_status", F.col("cur_at").alias("current_at"))
    return (
        best.join(text.withColumnRenamed("id", "content_id"), "content_id")
        .join(weight, "weight_id", "left")
        .join(value, "value_id")
        .join(kept, "group_id", "left")
        .select("group_id", "size", "content", F.col("weight").alias("evidential_weight"), "status", "epistemic_status", "current_at", F.coalesce("n_attestations", F.lit(0)).alias("n_attestations"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
    )


def kept_attestations(members: DataFrame, attestations: DataFrame) -> DataFrame:
    """Every distinct attestation of a group under its group_id: (group_id, source_id, author, source_date, quote, source_type)."""
    return attestations.join(members.select(F.col("id").alias("node_id"), "group_id"), "node_id").select("group_id", trimmed("source_id").alias("source_id"), "author", "source_date", "quote", "source_type").distinct()
