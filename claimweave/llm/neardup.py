"""Problem 2: near-duplicate records with small edits.

Improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles, banded, verified by weighted Jaccard
likeness; an exact check of the plain likeness follows. A shingle is a distinct word of four or more letters a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.bucketjoin import HOT_BUCKET, bucket_pairs, odd_sketch, verified
from claimweave.llm.hashing import flat_of, mix64
from claimweave.llm.wordsets import bucket_of, classes_of, document_frequency, idf_weights, word_rows
from claimweave.runtime import keyed_join, ship, stash

LIKENESS = 0.7
BANDS, ROWS = 24, 3
#: The largest ratio of the weights of two words.
TOP_WEIGHT = 2.0
#: Ids of a class that are paired at a time.
ID_BLOCK = 1024
_BLOCK = 3_000_000


def cws_samples(words: np.ndarray, starts: np.ndarray, weights: np.ndarray, first: int, count: int) -> np.ndarray:
    """Identity of samples first..first+count of each non-empty set, as uint64 (rows x count).

    For set S and sample k the word with the least a = c / (y e^r) is drawn, y the quantised weight; equal words
    with equal weights give equal draws in every set, so they are made once per distinct word.
    """
    uniq, back = np.unique(words, return_inverse=True)
    logw = np.log(weights[bucket_of(uniq)])
    base = uniq.view(np.uint64)
    out = np.empty((len(starts) - 1, count), dtype=np.uint64)
    step = max(1, min(count, _BLOCK // max(1, len(words))))
    for lo in range(0, count, step):
        ks = np.arange(first + lo, first + min(count, lo + step), dtype=np.uint64)
        s = mix64(base[:, None] ^ mix64(ks * np.uint64(0x9E3779B97F4A7C15))[None, :])
        halves = []
        for _ in range(3):
            s = mix64(s)
            halves += [((s >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0, ((s & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 4294967296.0]
        r = -np.log(halves[0] * halves[1])
        lnc = np.log(-np.log(halves[2] * halves[3]))
        t = np.floor(logw[:, None] / r + halves[4])
        lna = lnc - r * (t - halves[4]) - r
        # the order of doubles as unsigned integers: the upper half ranks, the lower half names word and quantum
        bits = lna.astype(np.float32).view(np.uint32)
        rank = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        name = mix64(s ^ t.astype(np.int64).view(np.uint64)) >> np.uint64(32)
        packed = (rank << np.uint64(32)) | name
        out[:, lo : lo + len(ks)] = np.minimum.reduceat(packed[back], starts[:-1], axis=0)
    return out


def band_rows(classes: DataFrame, weights_bc, bands: int, rows: int) -> DataFrame:
    """(key, id, n, o0): bands rows per class."""

    def run(batches):
        weights = weights_bc.value
        for batch in batches:
            names = batch.schema.names
            n_all = batch.column(names.index("n")).to_numpy()
            cid = batch.column(names.index("cid")).to_numpy()
            flat, starts = flat_of(batch.column(names.index("words")))
            if not len(cid):
                continue
            size = max(1, int(np.searchsorted(starts, 60_000)))
            for lo in range(0, len(cid), size):
                hi = min(len(cid), lo + size)
                st = starts[lo : hi + 1] - starts[lo]
                fl = flat[starts[lo] : starts[hi]]
                got = cws_samples(fl, st, weights, 0, bands * rows)
                key = np.zeros((hi - lo, bands), dtype=np.uint64)
                for b in range(bands):
                    h = np.full(hi - lo, b + 1, dtype=np.uint64)
                    for i in range(rows):
                        h = mix64(h ^ (got[:, b * rows + i] & np.uint64(0xFFFFFFFF)))
                    key[:, b] = h
                odd = odd_sketch(fl, st)[:, 0].copy().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64).ravel()),
                        pa.array(np.repeat(cid[lo:hi], bands)),
                        pa.array(np.repeat(n_all[lo:hi], bands)),
                        pa.array(np.repeat(odd, bands)),
                    ],
                    ["key", "id", "n", "o0"],
                )

    return classes.mapInArrow(run, "key bigint, id bigint, n int, o0 bigint")


def class_links(classes: DataFrame, threshold: float = LIKENESS, hot: int = HOT_BUCKET, label: str = "neardup") -> DataFrame:
    """(a, b, likeness), a < b: every found pair of classes at or above the threshold, as a written table."""
    spark = classes.sparkSession
    counts, total = document_frequency(classes)
    weights_bc = spark.sparkContext.broadcast(idf_weights(counts, total))
    pairs = bucket_pairs(band_rows(classes, weights_bc, BANDS, ROWS), threshold, 1, hot, label + "-c")
    sets = classes.select(F.col("cid").alias("id"), "words")
    return stash(verified(pairs, sets, threshold, weights_bc, TOP_WEIGHT), label + "-v")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = LIKENESS, hot: int = HOT_BUCKET, label: str = "neardup") -> tuple[DataFrame, DataFrame]:
    """(members: id, cid) of all ids with at least one word and (links: a, b, likeness) between classes of equal word sets.

    Null ids, and null, empty or word-less texts, have no likeness and appear in neither. Rows that repeat an id and its
    text count once. Ids with one word set share a class, so copies are never compared. Other columns are ignored.
    """
    ship(df.sparkSession)
    members, classes = classes_of(word_rows(df, id_col, text_col), label)
    members = stash(members, label + "-i")
    return members, class_links(classes, threshold, hot, label)


def id_pairs(members: DataFrame, links: DataFrame, block: int = ID_BLOCK, label: str = "idpairs") -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids of linked classes and of one class, whatever their number.

    This is the exact form; its rows grow with the square of the copies of one text. documents_with_links says the same in
    one row per id. The ids of a class are hashed into blocks, and blocks are paired, so that no task makes more than the
    pairs of two blocks at a time.
    """
    size = stash(members.groupBy("cid").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int")), label)
    one = keyed_join(members, size, "cid", n="m").select("cid", "id", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("g"))
    meets = links.select("a", "b").unionByName(size.where("m > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b")))
    sized = meets.join(size.select(F.col("cid").alias("a"), F.col("blocks").alias("na")), "a").join(size.select(F.col("cid").alias("b"), F.col("blocks").alias("nb")), "b")
    blocks = sized.select("a", "b", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ga")).select("a", "b", "ga", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("ga")).otherwise(0), F.col("nb") - 1)).alias("gb"))
    left, right = one.select(F.col("cid").alias("a"), F.col("g").alias("ga"), F.col("id").alias("x")), one.select(F.col("cid").alias("b"), F.col("g").alias("gb"), F.col("id").alias("y"))
    pairs = blocks.join(left, ["a", "ga"]).join(right, ["b", "gb"]).where("x <> y AND (a <> b OR ga <> gb OR x < y)")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def documents_with_links(members: DataFrame, links: DataFrame, label: str = "neardup") -> DataFrame:
    """(id, class_id, copies, n_links): one row per id; n_links counts the other classes its class is linked to."""
    stat = members.groupBy("cid").agg(F.count("*").alias("copies"), F.min("id").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    one = stash(stat.join(degree, "cid", "left").select("cid", "class_id", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").alias("m")), label + "-d")
    return keyed_join(members, one, "cid", n="m").select("id", "class_id", "copies", "n_links")
