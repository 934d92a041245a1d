"""Problem 8: mixing sources to target weights.

Pivotal dependent rounding (Deville and Tillé 1998): each document of a source has the same expected number of copies; its
fractional part is settled by pairing documents and moving mass at random until one of the two is integral. Documents are
grouped by a hash, so that the result does not depend on how the table is laid out; what is left over in each group goes
up a reduction tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.hashing import mix64
from claimweave.llm.tokens import DEFAULT_VOCABULARY, with_tokens
from claimweave.runtime import bounded, ship, small_enough, stash

#: Sources in a mix; the plan (a few numbers per source) is made on the driver.
MAX_SOURCES = 100_000
#: Documents settled in one group, and groups whose leftovers meet in the next level of the tree.
GROUP, FAN_IN = 2048, 64
#: A document of more than this part of what its source should give is settled in a first round, so that the others make up.
LARGE = 0.005
MOST_TASKS = 4096


def source_plan(counted: DataFrame, targets: DataFrame) -> pd.DataFrame:
    """One row per source of the mix: size (tokens of its documents), wanted (share x total of all documents), factor (copies
    per document: wanted / size, at most max_repeats) and short (its share can't be reached)."""
    if not small_enough(targets, MAX_SOURCES):
        raise ValueError(f"mix_targets has more than {MAX_SOURCES} rows")
    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"))
    total = float(counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    plan = targets.where("source IS NOT NULL").join(sizes, "source", "left").toPandas()  # a row per source of the mix
    plan["size"] = plan["size"].fillna(0).astype(float)
    plan["n_docs"] = plan["n_docs"].fillna(0).astype("int64")
    plan["wanted"] = plan["target_share"].fillna(0.0) * total
    cap = plan["max_repeats"].fillna(0).clip(lower=0)
    plan["short"] = plan["wanted"] > plan["size"] * cap
    plan["factor"] = np.minimum(np.where(plan["size"] > 0, plan["wanted"] / plan["size"].where(plan["size"] > 0, 1.0), 0.0), cap)
    return plan.sort_values("source", ignore_index=True)


def uniform(doc_id: int, salt: int) -> float:
    return float((mix64(np.array([(doc_id ^ (salt * 0x9E3779B97F4A7C15)) & (2**64 - 1)], dtype=np.uint64))[0] >> np.uint64(11)) / np.float64(1 << 53))


def duel(a: tuple[int, float, int], b: tuple[int, float, int], seed: int) -> tuple[tuple[int, float, int], tuple[int, float, int]]:
    """(settled, open) after one pivotal step between two (doc_id, probability, tokens).

    Mass moves in tokens, p x tokens + q x tokens stays as it was, and neither probability changes in expectation.
    """
    (i, p, m), (j, q, n) = a, b
    m1, n1 = max(m, 1), max(n, 1)
    rise = min(1 - p, q * n1 / m1)
    fall = min(p, (1 - q) * n1 / m1)
    d = rise if uniform(i ^ ((j << 1) & (2**63 - 1)), seed) * (rise + fall) < fall else -fall
    p, q = p + d, q - d * m1 / n1
    one, two = (i, min(max(p, 0.0), 1.0), m), (j, min(max(q, 0.0), 1.0), n)
    return (one, two) if abs(p - round(p)) <= abs(q - round(q)) else (two, one)


def is_whole(p: float) -> bool:
    return abs(p - round(p)) <= 1e-9


def _rates(counted: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """(source, base, part, groups, bar): a row per source of the mix: whole and fractional copies of each document."""
    rows = []
    for r in plan.itertuples():
        base = int(np.floor(r.factor + 1e-12))
        rows.append((r.source, base, float(max(0.0, r.factor - base)), max(1, -(-int(r.n_docs) // GROUP)), float(LARGE * r.wanted)))
    return counted.sparkSession.createDataFrame(rows, "source string, base int, part double, groups int, bar double")


def mix(counted: DataFrame, plan: pd.DataFrame, seed: int = 7, label: str = "mix") -> DataFrame:
    """(doc_id, source, n_tokens, uses) in two rounds over all documents: those above LARGE of what their source should give
    are settled first, and the factor of the others is set to what is then missing, so that no single large document decides a
    share."""
    bars = bounded(_rates(counted, plan).select("source", "bar"), MAX_SOURCES)
    sized = counted.join(bars, "source").withColumn("large", F.col("n_tokens") > F.col("bar"))
    first = mixed(sized.where("large"), plan, seed, label + "-l")
    used = first.groupBy("source").agg(F.sum(F.col("n_tokens").cast("double") * F.col("uses")).alias("used"), F.sum(F.col("n_tokens").cast("double")).alias("large")).toPandas()  # a row per source of the mix
    rest = plan.merge(used, "left", "source").fillna({"used": 0.0, "large": 0.0, "max_repeats": 0})
    left, size = (rest["wanted"] - rest["used"]).clip(lower=0), rest["size"] - rest["large"]
    rest["factor"] = np.minimum(np.where(size > 0, left / size.where(size > 0, 1.0), 0.0), rest["max_repeats"].clip(lower=0))
    return first.unionByName(mixed(sized.where("NOT large"), rest, seed, label))


def mixed(counted: DataFrame, plan: pd.DataFrame, seed: int = 7, label: str = "mix") -> DataFrame:
    """(doc_id, source, n_tokens, uses): every document of a source of the mix, with the number of its uses (0 too).

    Documents of other sources, of none, or without id are left out. A source is settled in groups of about GROUP documents
    by a hash of their ids, whatever its share of all rows; the one document a group leaves open goes on to the next
    level, where FAN_IN groups meet. Within a group the largest documents come first, so that what stays open is small.
    """
    ship(counted.sparkSession)

    def settler(last: bool):
        def settle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
            source, group, base = frame["source"].iloc[0], int(key[1]), int(frame["base"].iloc[0])
            rows, held = [], None
            for one in zip(frame["doc_id"].tolist(), frame["part"].tolist(), frame["n_tokens"].tolist()):
                if held is None:
                    held = one
                    continue
                done, held = duel(held, one, seed)
                rows.append((done[0], source, done[2], base, group, base + round(done[1]), None))
                if is_whole(held[1]):
                    rows.append((held[0], source, held[2], base, group, base + round(held[1]), None))
                    held = None
            if held is not None:  # at the top of the tree what is left is drawn
                uses, part = (base + int(uniform(held[0], seed + 1) < held[1]), None) if last else (0, held[1])
                rows.append((held[0], source, held[2], base, group, uses, part))
            return pd.DataFrame(rows, columns=["doc_id", "source", "n_tokens", "base", "g", "uses", "part"]).astype({"part": "float64"})

        return settle

    schema = "doc_id bigint, source string, n_tokens int, base int, g int, uses int, part double"
    rates = _rates(counted, plan)
    rows = counted.select("doc_id", "source", "n_tokens").where("doc_id IS NOT NULL").join(bounded(rates, MAX_SOURCES), "source")
    # documents whose number of copies is whole need no rounding
    settled = rows.where("part <= 1e-12").select("doc_id", "source", "n_tokens", F.col("base").alias("uses"))
    level = rows.where("part > 1e-12").select("doc_id", "source", "n_tokens", "base", "part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "groups").cast("int").alias("g"))
    most = max((max(1, -(-int(n) // GROUP)) for n in plan["n_docs"]), default=1)
    k = 0
    while True:
        # a number of partitions is given, since groups are small in bytes but not in work
        groups = sum(-(-max(1, -(-int(n) // GROUP)) // FAN_IN**k) for n in plan["n_docs"])
        spread = level.repartition(max(1, min(groups, MOST_TASKS)), "source", "g")
        done = stash(spread.groupBy("source", "g").applyInPandas(settler(most == 1), schema), f"{label}-{k}")
        settled = settled.unionByName(done.where("part IS NULL").select("doc_id", "source", "n_tokens", "uses"))
        if most == 1:
            return settled
        level = done.where("part IS NOT NULL").select("doc_id", "source", "n_tokens", "base", "part", F.floor(F.col("g") / FAN_IN).cast("int").alias("g"))
        most, k = -(-most // FAN_IN), k + 1


def shares(uses: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """(source, target_share, actual_share, size, used_tokens, max_repeats, short): one row per source of the mix."""
    spark = uses.sparkSession
    rows = spark.createDataFrame([(r.source, float(r.target_share), int(r.size), int(r.max_repeats), bool(r.short)) for r in plan.fillna({"target_share": 0.0, "max_repeats": 0}).itertuples()], "source string, target_share double, size bigint, max_repeats int, short boolean")
    used = uses.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("uses")).alias("used"))
    total = float(uses.agg(F.coalesce(F.sum(F.col("n_tokens").cast("long") * F.col("uses")), F.lit(0))).first()[0])
    return rows.join(bounded(used, MAX_SOURCES), "source", "left").select("source", "target_share", F.coalesce(F.try_divide(F.col("used"), F.lit(total)), F.lit(0.0)).alias("actual_share"), "size", F.coalesce("used", F.lit(0)).alias("used_tokens"), "max_repeats", "short")


def checked(uses: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """(source, within_cap, near_target) per source of the mix: no document beyond max_repeats, and the tokens used within 1 % or
    one document of the target, or of all there is where the source falls short."""
    spark = uses.sparkSession
    goal = [(r.source, int(r.max_repeats), float(min(r.wanted, r.size * max(0, r.max_repeats)))) for r in plan.fillna({"max_repeats": 0}).itertuples()]
    got = uses.groupBy("source").agg(F.max("uses").alias("most"), F.max("n_tokens").alias("largest"), F.sum(F.col("n_tokens").cast("double") * F.col("uses")).alias("used"))
    rows = spark.createDataFrame(goal, "source string, cap int, goal double").join(bounded(got, MAX_SOURCES), "source", "left").na.fill(0)
    return rows.select("source", (F.col("most") <= F.col("cap")).alias("within_cap"), (F.abs(F.col("used") - F.col("goal")) <= F.greatest(F.col("goal") * 0.01, F.col("largest"))).alias("near_target"))


def counted_documents(docs: DataFrame, path: str = DEFAULT_VOCABULARY, label: str = "mix") -> DataFrame:
    return stash(with_tokens(docs, ["doc_id", "source"], "text", path).select("doc_id", "source", "n_tokens"), label + "-tok")
