import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import mixing as M
from claimweave.llm import packing as P
from claimweave.llm import tokens as K

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(K.DEFAULT_VOCABULARY), reason="no vocabulary file")


def test_fill_respects_every_limit():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(0, 900, 400), np.ones(400), rng.integers(0, 400, 400)], axis=1).astype(float)
    limits = np.array([1000.0, 7.0, 600.0])
    got = P.fill(demand, limits)
    assert (got >= 0).all()
    for k in range(got.max() + 1):
        assert (demand[got == k].sum(axis=0) <= limits + 1e-9).all()
    assert P.fill(np.zeros((0, 3)), limits).size == 0


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int")


def test_packed_items(spark):
    rows = [(k, "word " * (7 * k % 90), "s", 9) for k in range(300)] + [(500, "token " * 9000, "s", 9), (501, None, "s", 9), (502, "", "s", 9)]
    items = P.items_of(docs(spark, rows), 1000)
    got = P.packed(items, 1000, loss_limit=980)
    assert {tuple(r)[1:] for r in P.checked(got, 1000, loss_limit=980).collect()} == {(True, True)}
    out = got.toPandas()
    assert out.groupby("container_id")["n_tokens"].sum().max() <= 1000
    assert len(out) == items.count() and set(out["doc_id"]) == {r[0] for r in rows}
    long = out[out["doc_id"] == 500]
    assert len(long) == long["n_pieces"].iloc[0] and long["n_tokens"].sum() == K.token_count("token " * 9000)
    assert (out[out["n_pieces"] == 1]["n_tokens"] <= 1000).all()
    used = out["n_tokens"].sum() / (1000 * out["container_id"].nunique())
    assert used > 0.93


def test_packing_empty(spark):
    assert P.packed(P.items_of(docs(spark, []))).count() == 0


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix_reaches_its_shares(spark):
    rows = [(k, "some words of text " * (1 + k % 9), "big" if k % 3 else "small", 0) for k in range(1500)] + [(9000, "other text", None, 0), (9001, "other text", "outside", 0)]
    counted = M.counted_documents(docs(spark, rows).drop("n_tokens").repartition(5))
    plan = M.source_plan(counted, targets(spark, [("big", 0.5, 2), ("small", 0.5, 2), ("none", 0.0, 1)]))
    out = M.mix(counted, plan)
    uses = out.toPandas()
    assert len(uses) == 1500 and uses["uses"].between(0, 2).all()
    got = {r["source"]: r for r in M.shares(out, plan).collect()}
    assert abs(got["big"]["actual_share"] - 0.5) < 0.01 and not got["small"]["short"] and got["none"]["used_tokens"] == 0


def test_mix_does_not_depend_on_the_layout(spark):
    rows = [(k, "some words of text " * (1 + k % 9), "big", 0) for k in range(900)]
    whole = M.counted_documents(docs(spark, rows).drop("n_tokens"))
    plan = M.source_plan(whole, targets(spark, [("big", 0.4, 2)]))
    one = {r["doc_id"]: r["uses"] for r in M.mix(whole.repartition(1), plan, label="one").collect()}
    many = {r["doc_id"]: r["uses"] for r in M.mix(whole.orderBy(F.desc("doc_id")).repartition(7), plan, label="many").collect()}
    assert one == many and {tuple(r)[1:] for r in M.checked(M.mix(whole, plan, label="chk"), plan).collect()} == {(True, True)}


def test_tree_of_groups_keeps_the_share(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 4)
    monkeypatch.setattr(M, "FAN_IN", 3)
    rows = [(k, "some words of text " * (1 + k % 9), "big", 0) for k in range(500)]
    counted = M.counted_documents(docs(spark, rows).drop("n_tokens"))
    plan = M.source_plan(counted, targets(spark, [("big", 0.35, 1)]))
    got = M.mix(counted, plan, label="tree")
    assert got.count() == 500 and abs(M.shares(got, plan).first()["used_tokens"] / plan["wanted"].iloc[0] - 1) < 0.01


def test_short_sources(spark):
    counted = M.counted_documents(docs(spark, [(1, "few words", "a", 0), (2, "many words " * 50, "b", 0)]).drop("n_tokens"))
    plan = M.source_plan(counted, targets(spark, [("a", 0.5, 2), ("b", 0.3, 1), ("gone", 0.2, 3)]))
    assert [r.source for r in plan.itertuples() if r.short] == ["a", "gone"]
    assert {r["doc_id"]: r["uses"] for r in M.mix(counted, plan).collect()}[1] == 2


def test_mix_empty(spark):
    counted = M.counted_documents(docs(spark, []).drop("n_tokens"))
    plan = M.source_plan(counted, targets(spark, [("a", 1.0, 2)]))
    assert M.mix(counted, plan).count() == 0 and M.shares(M.mix(counted, plan), plan).count() == 1


def test_duel_keeps_mass_and_expectation():
    total, n = 0.0, 4000
    for k in range(n):
        done, rest = M.duel((k, 0.3, 5), (k + 10**6, 0.6, 2), 1)
        assert M.is_whole(done[1]) and abs(done[1] * done[2] + rest[1] * rest[2] - (0.3 * 5 + 0.6 * 2)) < 1e-9
        total += done[1] if done[0] == k else rest[1]
    assert abs(total / n - 0.3) < 0.03


def test_loss_tokens(spark):
    d = docs(spark, [(1, "Heading\nbody text here", "s", 0), (2, "No heading. At all\nmore", "s", 0)]).drop("n_tokens")
    got = {r["doc_id"]: (r["n_tokens"], r["loss_tokens"]) for r in K.with_tokens(d, ["doc_id"], "text").collect()}
    assert got[1][1] < got[1][0] and got[2][0] == K.token_count("No heading. At all\nmore")
    assert K.with_tokens(d, ["doc_id"], "text").agg(F.sum("n_tokens")).first()[0] > 0
