"""The history of validations: what is validated again, what stood when, and the hash tree that tells."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from batonflow import fixed
from batonflow.operators import lineage
from batonflow.plans import handoff, history

T0 = datetime(2026, 10, 1)
OBJ = "id long, tenant_id long, entity_id long, subject_key string, stage string, type string, authority int, status string, role string, valid_from timestamp_ntz, version int"
NAME = ["tenant_id", "entity_id", "contract", "field", "subject_key", "upstream_id", "downstream_id", "slot", "outcome", "inherited", "conflict"]


def statements(seed: int, accounts: int = 6, each: int = 14):
    rng, rows, slots = random.Random(seed), [], []
    for i in range(accounts * each):
        a = i % accounts
        rows.append((i, a % 2, a, f"e{a}:c{rng.randint(1, 2)}", rng.choice(fixed.STAGES), rng.choice(["requirement", "problem", "commitment", "decision"]), rng.randint(0, 4), rng.choice(["active", "active", "superseded", "conflicting"]), rng.choice(["customer", "sales", "product"]), T0 + timedelta(days=rng.randint(0, 20)), 1))
        for slot in ("protocol", "region", "quantity", "due_date", "plan"):
            if rng.random() < 0.6:
                slots.append((i, slot, rng.choice(["a", "b", " A ", '["x"]', ""])))
    return rows, slots


def tables(spark, rows, slots):
    o = spark.createDataFrame(rows, OBJ)
    return o, spark.createDataFrame(slots, "id long, slot string, value string"), lineage.edges(o)


def names(df):
    return sorted((tuple(r[c] for c in NAME) for r in df.collect()), key=repr)


def test_only_what_moved_is_validated_again(spark, tmp_path):
    rows, slots = statements(1)
    fields = handoff.contract_fields(spark)
    o, s, r = tables(spark, rows, slots)
    runs, gaps = history.validate_changed(o, s, fields, r, None, 1, T0)
    runs, gaps = history.append(runs, f"{tmp_path}/runs"), history.append(gaps, f"{tmp_path}/gaps")
    first = names(handoff.validate(o, s, fields, r))
    assert names(gaps) == first and first
    pairs = {(x.tenant_id, x.entity_id, x.contract) for x in runs.collect()}

    # Nothing changed: nothing is added.
    again, none = history.validate_changed(o, s, fields, r, runs, 2, T0 + timedelta(1))
    assert again.count() == 0 and none.count() == 0

    # A new statement in one account, a new version with another value in a second one.
    rows.append((1000, 0, 2, "e2:c1", "product", "requirement", 4, "active", "product", T0 + timedelta(30), 1))
    rows[3] = (*rows[3][:7], "active", *rows[3][8:-1], 2)
    slots.append((3, "idp", "Okta"))
    o, s, r = tables(spark, rows, slots)
    new_runs, new_gaps = history.validate_changed(o, s, fields, r, runs, 2, T0 + timedelta(2))
    moved = {(x.tenant_id, x.entity_id) for x in new_runs.collect()}
    assert moved == {(0, 2), (1, 3)} and {(x.tenant_id, x.entity_id) for x in new_gaps.collect()} <= moved
    runs, gaps = history.append(new_runs, f"{tmp_path}/runs"), history.append(new_gaps, f"{tmp_path}/gaps")
    assert names(history.gaps_at(runs, gaps)) == names(handoff.validate(o, s, fields, r))
    assert names(history.gaps_at(runs, gaps, T0 + timedelta(1))) == first
    assert names(history.gaps_at(runs, gaps, T0 - timedelta(1))) == []

    # What was opened and closed leads from the one state to the other.
    key = ["tenant_id", "entity_id", "contract", "field", "subject_key", "slot", "outcome"]
    kept = {tuple(x[c] for c in key) for x in gaps.where("run_no = 1").collect()}
    for x in history.changes(runs, gaps).where("run_no = 2").collect():
        (kept.add if x.change == "opened" else kept.remove)(tuple(x[c] for c in key))
    assert kept == {tuple(x[c] for c in key) for x in history.gaps_at(runs, gaps).collect()}

    # A contract that changed is validated for every account that it is about, the others for none.
    other = [c if c[0] != "sales_to_product" else (*c[:3], c[3][:1]) for c in fixed.CONTRACTS]
    less = handoff.contract_fields(spark, other)
    new_runs, new_gaps = history.validate_changed(o, s, less, r, runs, 3, T0 + timedelta(3))
    assert {(x.tenant_id, x.entity_id, x.contract) for x in new_runs.collect()} == {p for p in pairs if p[2] == "sales_to_product"}
    assert names(new_gaps) == names(handoff.validate(o, s, less, r).where("contract = 'sales_to_product'"))


def test_runs_without_statements_and_without_gaps(spark):
    fields = handoff.contract_fields(spark)
    o, s, r = tables(spark, [], [])
    runs, gaps = history.validate_changed(o, s, fields, r, None, 1, T0)
    assert runs.count() == 0 and gaps.count() == 0
    o, s, r = tables(spark, [(1, 1, 1, "a:b", "sales", "requirement", 4, "superseded", "customer", T0, 1)], [])
    new, none = history.validate_changed(o, s, fields, r, runs, 2, T0)
    assert new.count() > 0 and none.count() == 0
    assert {x.total for x in new.collect()} == {0}


def tree(ids, levels: int):
    sha = lambda xs: hashlib.sha256("|".join(xs).encode()).hexdigest()
    level = {}
    for i, version in sorted(ids):
        level.setdefault(i >> 10, []).append(f"{i}:{version}")
    level = {k: sha(v) for k, v in level.items()}
    for _ in range(levels):
        up = {}
        for k in sorted(level):
            up.setdefault(k >> 10, []).append(level[k])
        level = {k: sha(v) if len(v) > 1 else v[0] for k, v in up.items()}
    top = [level[k] for k in sorted(level)]
    return sha(top) if len(top) > 1 else top[0]


@pytest.mark.parametrize("ids", [[5], list(range(3000)), [1, 2**40, 2**40 + 1, 2**62], [-5, -2000, 7, 2**20], [2**62 + i for i in range(2000)]])
def test_input_tree(spark, ids):
    rng = random.Random(2)
    seen = [(i, rng.randint(1, 3)) for i in ids]
    df = spark.createDataFrame([(1, i, v) for i, v in seen] + [(2, 4, 1)], "account long, id long, version int")
    found = {r.account: r.tree for r in handoff.input_tree(df.repartition(5), ["account"]).collect()}
    assert found == {1: tree(seen, 7), 2: tree([(4, 1)], 1)}
    # No row of any level holds more than 2 ** FANOUT ids.
    widest = df.groupBy("account", F.shiftright("id", handoff.FANOUT)).count().agg(F.max("count")).first()[0]
    assert widest <= 2**handoff.FANOUT
