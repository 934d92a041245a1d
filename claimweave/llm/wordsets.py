"""Word sets of records: one row per id, one representative per distinct set, and bounded word statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.hashing import flat_of, mix64
from claimweave.runtime import bounded, keyed_join, stash

#: Buckets of the document-frequency table: its size bound whatever the vocabulary.
BUCKETS = 1 << 20


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (mix64(words.view(np.uint64)) >> np.uint64(44)).astype(np.int64)


def word_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, words) per row of df with a non-null id; words are the sorted hashes of the distinct runs of four or more
    letters a-z, (k1, k2) a 128-bit digest of the set. A null text has no words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit("([a-z]{4,})"), 1)
    words = F.sort_array(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("words"))
    return rows.select("id", F.size("words").alias("n"), F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), "words")


def classes_of(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(members: id, cid) and (classes: cid, n, words): one class per distinct non-empty word set.

    The words of a row are written once; only digests of sets that occur more than once are joined to choose
    representatives, and a set that many rows share is broadcast for that, not gathered.
    """
    base = stash(rows.where("n > 0").withColumn("cid", F.monotonically_increasing_id()), label)
    key = ["k1", "k2"]
    twice = stash(base.groupBy(*key).agg(F.min("cid").alias("rep"), F.count("*").alias("m")).where("m > 1"), label + "-k")
    rep = stash(keyed_join(base.select("id", *key, "cid"), twice, key, "left", "m").select("id", F.coalesce("rep", "cid").alias("cid"), F.col("cid").alias("row")), label + "-m")
    spare = rep.where("row <> cid").select(F.col("row").alias("cid"))
    return rep.select("id", "cid").distinct(), base.select("cid", "n", "words").join(bounded(spare), "cid", "left_anti")


def document_frequency(classes: DataFrame) -> tuple[np.ndarray, int]:
    """Class count per word bucket over all classes, and the number of classes; at most BUCKETS numbers reach the driver.

    There are no more tasks than about two per core, since each may emit a row per bucket however much it reads.
    """

    def run(batches):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        rows = 0
        for batch in batches:
            flat, starts = flat_of(batch.column(0))
            counts += np.bincount(bucket_of(flat), minlength=BUCKETS)
            rows += len(starts) - 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"bucket": np.append(some, -1), "n": np.append(counts[some], rows)}), preserve_index=False)

    tasks = 2 * classes.sparkSession.sparkContext.defaultParallelism
    got = classes.select("words").coalesce(tasks).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if len(got) == 0:
        return counts, 0
    own = got["bucket"].to_numpy() >= 0
    counts[got["bucket"].to_numpy()[own]] = got["n"].to_numpy()[own]
    return counts, int(got["n"].to_numpy()[~own].sum())


def idf_weights(counts: np.ndarray, total: int) -> np.ndarray:
    """A damped inverse document frequency per bucket within [1, 2], so that weighted likeness bounds plain likeness.

    The term frequency of a word in a record is 1: a record is the set of its words.
    """
    idf = np.log((total + 1.0) / (counts + 1.0))
    top = max(float(np.log(total + 1.0)), 1e-9)
    return (1.0 + np.clip(idf / top, 0.0, 1.0)).astype(np.float64)
