from datetime import datetime

import pandas as pd
import pytest

from claimweave.llm import survivors as V
from claimweave.llm.components import seed_tree_components


def day(k):
    return datetime(2024, 1, k)


SCHEMA = "id string, content string, evidential_weight double, created_at timestamp, status string, epistemic_status string"


def setup(spark, nodes, pairs, atts=()):
    n = spark.createDataFrame(nodes, SCHEMA)
    p = spark.createDataFrame(list(pairs), "id_a string, id_b string")
    a = spark.createDataFrame([(i, s, "q") for i, s in atts], "node_id string, source_id string, quote string")
    groups = seed_tree_components(p, "id_a", "id_b")
    return V.group_members(groups, n, a), n, a


def test_fields_come_from_the_best_members(spark):
    nodes = [
        ("a", "x  y ", 0.5, day(1), "active", "single_source"),
        ("b", "longer text", 1.4, day(2), "active", "supported"),
        ("c", "longer text", 0.2, day(3), "active", "supported"),
        ("d", None, None, day(4), "active", "supported"),
        ("z", "not grouped", 0.9, day(4), "active", "supported"),
    ]
    members, *_ = setup(spark, nodes, [("a", "b"), ("b", "c"), ("c", "d")], [("a", "s1"), ("a", " s1 "), ("c", "s1"), ("c", "s2"), ("c", " "), ("b", "s1"), ("b", "s2"), ("b", "s3")])
    assert [tuple(r)[:4] for r in V.survivors(members).collect()] == [("a", 4, "c", "c")]


def test_ties_go_to_the_latest_then_the_smallest_id(spark):
    nodes = [(i, "same", 0.5, day(k), "active", "supported") for i, k in (("a", 1), ("b", 2), ("c", 2))]
    members, *_ = setup(spark, nodes, [("a", "b"), ("a", "c")])
    assert [tuple(r)[:4] for r in V.survivors(members).collect()] == [("a", 3, "b", "b")]


def test_no_valid_weight(spark):
    members, *_ = setup(spark, [("a", "x", None, day(1), "s", "e"), ("b", "y", 2.0, day(2), "s", "e")], [("a", "b")])
    assert [tuple(r)[:4] for r in V.survivors(members).collect()] == [("a", 2, "b", None)]


def test_empty(spark):
    members, n, a = setup(spark, [], [])
    assert V.survivors(members).count() == 0 and V.merged_records(members, n, a).count() == 0


def test_learnt_order_places_undated_rows(spark):
    rows = []
    for g in range(6):
        rows += [(f"g{g}", f"{g}a", day(1), "draft"), (f"g{g}", f"{g}b", day(5), "active"), (f"g{g}", f"{g}c", day(9), "archived")]
    rows += [("h", "h1", day(2), "draft"), ("h", "h2", None, "archived"), ("h", "h3", day(3), "active"), ("h", "h4", None, None), ("h", "h5", None, "active")]
    rows += [("i", "i1", None, "archived"), ("i", "i2", None, "draft"), ("i", "i3", None, "active")]
    df = spark.createDataFrame(rows, "g string, id string, at timestamp, status string")
    assert V.learnt_precedence(df, "g", "at", "status") == {("draft", "active"), ("active", "archived"), ("draft", "archived")}
    out = {r["id"]: (r["cur_at"], r["cur_step"]) for r in V.currency(df, "g", "at", ["status"]).collect()}
    assert out["h2"] == (day(3), 1) and out["h5"] == (day(2), 1) and out["h4"] == (None, 1) and out["h3"] == (day(3), 0)
    assert [out[k] for k in ("i2", "i3", "i1")] == [(None, 1), (None, 2), (None, 3)] and len(out) == len(rows)


def test_undated_rows_decide_the_surviving_value(spark):
    """An undated later state wins over all dated rows; one that precedes a dated row loses to it."""
    nodes = []
    for g in range(4):
        nodes += [(f"{g}a", "x", 0.5, day(1), "draft", "e"), (f"{g}b", "x", 0.5, day(5), "active", "e")]
    nodes += [("p1", "x", 0.5, day(2), "draft", "e"), ("p2", "x", 0.5, None, "active", "e"), ("q1", "x", 0.5, day(2), "active", "e"), ("q2", "x", 0.5, None, "draft", "e")]
    members, *_ = setup(spark, nodes, [*[(f"{g}a", f"{g}b") for g in range(4)], ("p1", "p2"), ("q1", "q2")])
    got = {r["group_id"]: r["value_id"] for r in V.survivors(members).collect()}
    assert got["p1"] == "p2" and got["q1"] == "q1" and got["0a"] == "0b"


def test_orders_of_two_attributes_are_not_mixed():
    """Nothing is said about states whose attributes disagree: neither stands above the other."""
    orders = [{("a", "b")}, {("x", "y")}]
    frame = pd.DataFrame({"s": ["a", "b", "b"], "t": ["y", "x", "y"], "hi": [pd.Timestamp(day(1)), pd.NaT, pd.NaT], "undated": [False, True, True]})
    got = {k: (at, step) for k, at, step in V.placed_states(frame, ["s", "t"], orders)}
    assert got[1] == (None, 1) and got[2] == (pd.Timestamp(day(1)), 1)


def test_held_out_timestamps_are_recovered(spark):
    """Groups whose status only moves forward, with the date of the last record withheld: its record survives all the same."""
    order, nodes, pairs = ["draft", "active", "corroborated", "archived"], [], []
    for g in range(60):
        last = 1 + g % 3
        for k in range(last + 1):
            nodes.append((f"{g:02d}{k}", "x", 0.5, None if k == last and g % 2 else day(2 + 3 * k), order[k], "e"))
            pairs += [(f"{g:02d}0", f"{g:02d}{k}")] if k else []
    members, *_ = setup(spark, nodes, pairs)
    got = {r["group_id"][:2]: r["value_id"] for r in V.survivors(members).collect()}
    assert sum(v == f"{g}{1 + int(g) % 3}" for g, v in got.items()) == 60


def test_open_sets_are_refused(spark):
    df = spark.range(600).selectExpr("id % 3 AS g", "cast(id AS string) AS s", "timestamp_seconds(id) AS at")
    with pytest.raises(ValueError, match="closed set"):
        V.learnt_precedence(df, "g", "at", "s")


def test_cycles_drop_the_weaker_precedence(spark):
    rows = []
    for g in range(5):
        rows += [(f"x{g}", day(1), "a"), (f"x{g}", day(2), "b"), (f"y{g}", day(1), "b"), (f"y{g}", day(2), "c")]
    for g in range(3):
        rows += [(f"z{g}", day(1), "c"), (f"z{g}", day(2), "a")]
    assert V.learnt_precedence(spark.createDataFrame(rows, "g string, at timestamp, s string"), "g", "at", "s") == {("a", "b"), ("b", "c"), ("a", "c")}


def test_groups_of_linked_classes_and_copies(spark):
    members = spark.createDataFrame([("b", 1), ("a", 2), ("c", 2), ("d", 3), ("e", 4), ("f", 4), ("f", 5)], "id string, cid bigint")
    links = spark.createDataFrame([(1, 2, 0.8)], "a bigint, b bigint, likeness double")
    got = {(r["group_id"], r["id"]) for r in V.groups_of(members, links).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("e", "e"), ("e", "f")}


def test_every_attestation_is_kept(spark):
    members, n, a = setup(spark, [("a", "x", 0.5, day(1), "s", "e"), ("b", "yy", 0.4, day(2), "s", "e")], [("a", "b")], [("a", "s1"), ("b", "s1"), ("b", "s2")])
    row = V.merged_records(members, n, a).first()
    assert (row["content"], row["evidential_weight"], row["n_attestations"], row["n_sources"]) == ("yy", 0.4, 2, 2)
