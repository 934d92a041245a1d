"""Problem 7: filling fixed-capacity containers with items.

Vector bin packing with the dot-product heuristic: a container takes, of the items that fit under all limits at once, the
one whose demand vector has the largest weighted dot product with the room that is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.tokens import DEFAULT_VOCABULARY, with_tokens
from claimweave.runtime import ship, stash

CAPACITY, SEGMENTS = 4096, 64
#: Loss-bearing tokens a container may hold; headings bear none.
LOSS = 4064
#: Items packed together at once; containers filled below REPACK go into a second round.
GROUP, REPACK = 2048, 0.97
MOST_TASKS = 4096


def items_of(docs: DataFrame, capacity: int = CAPACITY, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, piece, n_pieces, n_tokens, loss_tokens): a text beyond the capacity is cut at token boundaries into full
    pieces and a rest, and no other text is split. A text without tokens is one item of size 0."""
    counted = with_tokens(docs, ["doc_id"], "text", path)
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(capacity))).cast("int")
    cut = counted.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    size = F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int")
    head = F.col("n_tokens") - F.col("loss_tokens")
    skipped = F.least(size, F.greatest(F.lit(0), head - F.col("piece") * capacity))
    return cut.select("doc_id", "piece", "n_pieces", size.alias("size"), (size - skipped).cast("int").alias("loss")).withColumnRenamed("size", "n_tokens").withColumnRenamed("loss", "loss_tokens")


def fill(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number per item; demand is items x dimensions. Items beyond a limit on their own get their own container."""
    n = len(demand)
    if not n:
        return np.zeros(0, np.int64)
    share = demand / limits
    weight = share.mean(axis=0) + 1e-9
    order = np.argsort(-share[:, 0], kind="stable")
    share, out = share[order], np.full(n, -1, np.int64)
    open_ = np.arange(n)
    number = 0
    while len(open_):
        room = np.ones(share.shape[1])
        left = open_
        while len(left):
            fits = (share[left] <= room + 1e-12).all(axis=1)
            left = left[fits]
            if not len(left):
                break
            best = left[int(np.argmax((share[left] * (weight * room)).sum(axis=1)))]
            out[best] = number
            room -= share[best]
            left = left[left != best]
        taken = out[open_] >= 0
        if not taken.any():
            out[open_[0]] = number
            taken = out[open_] >= 0
        open_ = open_[~taken]
        number += 1
    back = np.empty(n, np.int64)
    back[order] = out
    return back


def packed(items: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int = LOSS, label: str = "pack") -> DataFrame:
    """items with container_id; at most capacity tokens, segments items and loss_limit loss-bearing tokens in each.

    Items are spread evenly by a hash into groups of about GROUP and packed there; the few containers left below REPACK
    full are opened once more and their items packed together. Whole containers never enter the second round. An item that
    alone exceeds the loss limit gets a container of its own.
    """
    ship(items.sparkSession)
    limits = np.array([capacity, segments, loss_limit], dtype=float)
    schema = "doc_id bigint, piece int, n_pieces int, n_tokens int, loss_tokens int, container_id bigint, fill double"

    def packer(turn: int):
        def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return packed_group(turn, int(key[0]), frame)

        return pack

    def packed_group(turn: int, group: int, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        got = fill(np.stack([frame["n_tokens"], np.ones(len(frame)), frame["loss_tokens"]], axis=1).astype(float), limits)
        total = np.bincount(got, weights=frame["n_tokens"])
        base = (turn << 62) | (group << 24)
        return frame[["doc_id", "piece", "n_pieces", "n_tokens", "loss_tokens"]].assign(container_id=base + got, fill=total[got] / capacity)

    items = stash(items, label + "-i")
    once = items
    for turn in range(2):
        groups = max(1, -(-once.count() // GROUP))
        spread = once.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups)).cast("int"))
        # a number of partitions is given, since groups are small in bytes but not in work
        spread = spread.repartition(min(groups, MOST_TASKS), "g")
        done = stash(spread.groupBy("g").applyInPandas(packer(turn), schema), f"{label}-{turn}")
        if turn == 0:
            first, once = done, done.where(F.col("fill") < REPACK).drop("container_id", "fill")
    return first.where(F.col("fill") >= REPACK).unionByName(done).drop("fill")


def checked(items: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int = LOSS) -> DataFrame:
    """(doc_id, whole, within): whether each document is there once, cut only where it exceeds the capacity, and whether all its
    containers keep the three limits (an item beyond the loss limit lies alone)."""
    one = items.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.sum("loss_tokens").alias("l"))
    fine = one.select("container_id", ((F.col("t") <= capacity) & (F.col("k") <= segments) & ((F.col("l") <= loss_limit) | (F.col("k") == 1))).alias("fine"))
    docs = items.join(fine, "container_id").groupBy("doc_id").agg(F.count("*").alias("k"), F.count_distinct("piece").alias("d"), F.max("n_pieces").alias("n"), F.sum("n_tokens").alias("t"), F.bool_and("fine").alias("within"))
    whole = (F.col("k") == F.col("n")) & (F.col("d") == F.col("n")) & ((F.col("n") == 1) | (F.col("t") > capacity)) & (F.col("t") <= F.col("n") * capacity)
    return docs.select("doc_id", whole.alias("whole"), "within")
