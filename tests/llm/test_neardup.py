import random
import re

import numpy as np
from pyspark.sql import functions as F

from claimweave.llm import neardup as N
from claimweave.llm.wordsets import BUCKETS

random.seed(4)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
VOCABULARY = ["".join(random.choices(LETTERS, k=random.randint(4, 9))) for _ in range(900)]


def words(text):
    return frozenset(re.findall("[a-z]{4,}", (text or "").lower()))


def corpus(groups=60, size=3, n=24, edits=3):
    out = []
    for g in range(groups):
        base = random.sample(VOCABULARY, n)
        for k in range(size):
            w = base[:]
            for _ in range(random.randint(0, edits)):
                w[random.randrange(n)] = random.choice(VOCABULARY)
            random.shuffle(w)
            out.append((f"{g:03d}{k}", "  ".join(w).upper() if k % 2 else ", ".join(w)))
    return out


def brute(rows, t):
    sets = {i: words(c) for i, c in rows if i is not None}
    ids = sorted(i for i, w in sets.items() if w)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def found(spark, rows, block=1024, **kw):
    df = spark.createDataFrame(rows, "id string, content string")
    return set(map(tuple, N.id_pairs(*N.near_duplicates(df, "id", "content", **kw), block=block).collect()))


def test_matches_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows, 0.7)


def test_nulls_blanks_repeats_and_ties(spark):
    rows = [("a", None), ("b", ""), ("c", "   "), ("d", "the of 12"), (None, "some words here again"), ("e", "some words here again"), ("e", "some words here again"), ("f", "AGAIN here words some")]
    assert found(spark, rows) == {("e", "f")}


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_clashing_columns(spark):
    df = spark.createDataFrame([("x", "alpha beta gamma", 1, 2, "q"), ("y", "alpha beta gamma", 1, 2, "q")], "id string, content string, cid int, band int, words string")
    members, links = N.near_duplicates(df, "id", "content")
    assert set(map(tuple, N.id_pairs(members, links).collect())) == {("x", "y")}
    assert {r["copies"] for r in N.documents_with_links(members, links).collect()} == {2}


def test_copies_give_all_pairs_whatever_their_number(spark):
    """65, 130 and 200 ids of one word set, in blocks of 32: copies, texts that differ in numbers and short words, a neighbour."""
    rows = [(f"a{k:03d}", "alpha beta gamma delta") for k in range(65)] + [(f"b{k:03d}", f"alpha beta not gamma delta {k}") for k in range(65)] + [("zz", "alpha beta gamma delta epsilon")]
    rows += [(f"c{k:03d}", "other words than those above") for k in range(70)]
    assert found(spark, rows, block=32) == brute(rows, 0.7)


def test_hot_buckets_are_split_without_losing_pairs(spark):
    """With a tiny bucket bound nearly every bucket is hot; the pairs stay."""
    rows = corpus(groups=12, size=12, edits=2)
    truth = brute(rows, 0.7)
    got = found(spark, rows, hot=4)
    assert got <= truth and len(got) >= 0.97 * len(truth)


def test_hot_buckets_lose_nothing_against_pairing_them_whole(spark):
    """A template of 20 words with four own words each: every pair is a true one, and the shared words are the frequent ones."""
    base = VOCABULARY[:20]
    rows = [(f"{g:04d}", " ".join(base + [f"own{LETTERS[g % 26]}{LETTERS[g // 26]}{x}" for x in "abcd"])) for g in range(400)]
    whole = found(spark, rows, hot=10**6)
    assert len(whole) >= 0.98 * 400 * 399 / 2
    assert found(spark, rows, hot=64) == whole


def test_very_long_text(spark):
    long = " ".join("".join(random.choices(LETTERS, k=8)) for _ in range(150_000))
    assert found(spark, [("a", long), ("b", long + " tail word")]) == {("a", "b")}


def test_samples_agree_as_often_as_the_weighted_likeness():
    rng = np.random.default_rng(3)
    w = rng.integers(-(2**62), 2**62, 60)
    a, b = np.sort(w[:40]), np.sort(w[20:60])
    weights = np.ones(BUCKETS)
    flat, starts = np.concatenate([a, b]), np.array([0, 40, 80])
    s = N.cws_samples(flat, starts, weights, 0, 4000)
    assert abs((s[0] == s[1]).mean() - 20 / 60) < 0.03


def test_odd_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        w = rng.integers(-(2**62), 2**62, 50)
        k = int(rng.integers(1, 49))
        a, b = w[:k], w[max(0, k - 10) :]
        s = N.odd_sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 1 + k % 6)
        assert int(np.bitwise_count(s[0] ^ s[1]).sum()) <= len(set(a) ^ set(b))


def test_documents_with_links_keeps_every_document(spark):
    rows = corpus(groups=10)
    df = spark.createDataFrame(rows, "id string, content string")
    members, links = N.near_duplicates(df, "id", "content")
    out = N.documents_with_links(members, links)
    assert out.count() == len(rows) and out.select("class_id", "n_links").distinct().agg(F.sum("n_links")).first()[0] == 2 * links.count()
