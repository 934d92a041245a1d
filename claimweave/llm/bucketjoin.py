"""Pairs of rows that share a bucket and whose parity sketches allow a likeness: read as a stream, large buckets in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.hashing import flat_of, mix64
from claimweave.llm.wordsets import bucket_of
from claimweave.runtime import bounded, stash

#: A bucket beyond so many rows is paired in blocks of about so many by several tasks instead of whole by one.
HOT_BUCKET = 1024


def sketch_columns(width: int) -> list[str]:
    return [f"o{i}" for i in range(width)]


def odd_sketch(words: np.ndarray, starts: np.ndarray, width: int = 1) -> np.ndarray:
    """64 x width parity bits per non-empty set (rows x width); two sets differ in at least as many words as in bits."""
    place = (mix64(words.view(np.uint64) ^ np.uint64(0x5BD1E995)) % np.uint64(64 * width)).astype(np.int64)
    out = np.empty((len(starts) - 1, width), dtype=np.uint64)
    for i in range(width):
        bits = np.where(place >> 6 == i, np.uint64(1) << (place & 63).astype(np.uint64), np.uint64(0))
        out[:, i] = np.bitwise_xor.reduceat(bits, starts[:-1])
    return out


def _allowed(threshold: float, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m words with these sketches may be alike; never false where they are."""
    apart = np.floor((1 - threshold) / (1 + threshold) * (n + m) + 1e-9)
    ok = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    return ok & (np.bitwise_count(x ^ y).sum(axis=-1) <= apart)


def _columns(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """key, id, n and the sketch as one array of rows x width."""
    key, ids, n = (batch.column(i).to_numpy() for i in range(3))
    odd = np.stack([batch.column(3 + i).to_numpy().view(np.uint64) for i in range(width)], axis=1) if len(key) else np.zeros((0, width), np.uint64)
    return [key, ids, n.astype(np.int64), odd]


def bucket_pairs(rows: DataFrame, threshold: float, width: int = 1, hot: int = HOT_BUCKET, label: str = "bucket") -> DataFrame:
    """(a, b), a < b: the distinct pairs of ids of rows (key, id, n, o0, …) of one key that the sketches allow.

    Rows arrive sorted by key and are read as a stream, so that no more than a batch and `hot` rows are held. Rows of a key
    with more than that come out of the stream again and are paired block against block: no pair is lost at any size.
    """
    names = ["a", "b", "key", "n", *sketch_columns(width)]

    def pairs_of(cols):
        key, ids, n, odd = cols
        at, d, out_a, out_b = np.arange(len(key)), 1, [], []
        while True:
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            other = at + d
            ok = _allowed(threshold, odd[at], odd[other], n[at], n[other]) & (ids[at] != ids[other])
            out_a.append(np.minimum(ids[at[ok]], ids[other[ok]]))
            out_b.append(np.maximum(ids[at[ok]], ids[other[ok]]))
            d += 1
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def made(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.int64())] * (2 + width)], names)

    def passed(cols):
        key, ids, n, odd = cols
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(key), pa.array(n), *[pa.array(odd[:, i].copy().view(np.int64)) for i in range(width)]], names)

    def run(batches):
        held: list[np.ndarray] | None = None
        split: int | None = None

        def settle(cols):
            """Pairs within the runs of cols; the rows of a run that is too long come out one by one."""
            key = cols[0]
            if len(key):
                edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(edge, len(key)))
                long = np.repeat(size > hot, size)
                if long.any():
                    yield passed([c[long] for c in cols])
                    cols = [c[~long] for c in cols]
            a, b = pairs_of(cols)
            if len(a):
                both = np.unique(np.stack([a, b], axis=1), axis=0)
                yield made(both[:, 0].copy(), both[:, 1].copy())

        for batch in batches:
            new = _columns(batch, width)
            if split is not None and len(new[0]):  # the rest of a hot key passes through
                same = new[0] == split
                if same.any():
                    yield passed([c[same] for c in new])
                    new = [c[~same] for c in new]
                if len(new[0]):
                    split = None
            if not len(new[0]):
                continue
            cols = new if held is None else [np.concatenate([h, c]) for h, c in zip(held, new)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            yield from settle([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
            if len(held[0]) > hot:
                split = int(held[0][0])
                yield passed(held)
                held = None
        if held is not None:
            yield from settle(held)

    cols = ["key", "id", "n", *sketch_columns(width)]
    schema = "a bigint, b bigint, key bigint, n bigint, " + ", ".join(f"{c} bigint" for c in sketch_columns(width))
    found = stash(rows.select(*cols).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema), label)
    pairs = found.where("b IS NOT NULL").select("a", "b")
    rest = found.where("b IS NULL").select("key", F.col("a").alias("id"), *cols[2:])
    if rest.limit(1).count():
        pairs = pairs.unionByName(block_pairs(rest, threshold, width, hot, label))
    return pairs.distinct()


def block_pairs(rows: DataFrame, threshold: float, width: int, block: int, label: str) -> DataFrame:
    """(a, b), a < b, for rows of large keys: each key's rows are hashed into blocks of about `block`, and each pair of blocks
    is compared by itself, so that no task holds more than two blocks."""
    size = stash(rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")), label + "-hot")
    own = rows.join(bounded(size), "key").withColumn("g", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda h: F.struct(F.least("g", h).alias("x"), F.greatest("g", h).alias("y")))
    odd = sketch_columns(width)
    sent = own.select("key", "id", "n", *odd, "g", F.explode(meets).alias("p")).select("key", "id", "n", *odd, "g", "p.x", "p.y")

    def product(cols):
        ids, n, sketch, g, x, y = cols[1], cols[2], cols[3], cols[4], cols[5], cols[6]
        left, right = np.flatnonzero(g == x[0]), np.flatnonzero(g == y[0])
        step = max(1, 256 // width)
        for lo in range(0, len(left), step):
            part = left[lo : lo + step, None]
            ok = _allowed(threshold, sketch[part], sketch[right][None, :, :], n[part], n[right])
            ok &= ids[part] < ids[right] if x[0] == y[0] else ids[part] != ids[right]
            i, j = np.nonzero(ok)
            a, b = ids[part[i, 0]], ids[right[j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [*_columns(batch, width), *(batch.column(3 + width + i).to_numpy() for i in range(3))]
            cols = cols if held is None else [np.concatenate([h, c]) for h, c in zip(held, cols)]
            edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[5][1:] != cols[5][:-1]) | (cols[6][1:] != cols[6][:-1])) + 1
            for lo, hi in zip(np.append(0, edge[:-1]), edge):
                yield from product([c[lo:hi] for c in cols])
            held = [c[edge[-1] if len(edge) else 0 :] for c in cols]
        if held is not None:
            yield from product(held)

    key = ["key", "x", "y"]
    return sent.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float, weights_bc=None, top: float = 1.0) -> DataFrame:
    """(a, b, likeness) of pairs of sets (id, words) at or above the threshold, exactly; with weights, by word bucket and of a
    ratio of at most top, those below the weighted likeness that no such pair can have are dropped first."""
    floor = threshold / (threshold + top * (1 - threshold))

    def run(batches):
        weights = weights_bc.value if weights_bc else None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, xs = flat_of(batch.column(2))
            y, ys = flat_of(batch.column(3))
            rows = np.arange(len(xs) - 1)
            word = np.concatenate([x, y])
            row = np.concatenate([np.repeat(rows, np.diff(xs)), np.repeat(rows, np.diff(ys))])
            order = np.lexsort((word, row))
            word, row = word[order], row[order]
            twin = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
            shared = np.bincount(row[twin], minlength=len(rows))
            either = np.bincount(row, minlength=len(rows)) - shared
            ok = shared >= threshold * either - 1e-9
            if weights is not None:
                w = weights[bucket_of(word)]
                w_shared = np.bincount(row[twin], weights=w[twin], minlength=len(rows))
                ok &= w_shared >= floor * (np.bincount(row, weights=w, minlength=len(rows)) - w_shared) - 1e-9
            likeness = shared / np.maximum(either, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(likeness[ok])], ["a", "b", "likeness"])

    left = sets.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = sets.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a bigint, b bigint, likeness double")
