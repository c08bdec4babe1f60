"""Golden hand-offs, and invariants of validation."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from batonflow import derived, fixed
from batonflow.operators import lineage
from batonflow.plans import handoff

T0 = datetime(2026, 10, 2, 0, 14, 32)
OBJ = "id long, tenant_id long, entity_id long, subject_key string, stage string, type string, authority int, status string, role string, valid_from timestamp_ntz, version int"


def tables(spark, rows, slots):
    objects = spark.createDataFrame([(i, 1, 1, s, stage, kind, a, status, role, T0 + timedelta(days=d), 1) for i, s, stage, kind, a, status, role, d in rows], OBJ)
    return objects, spark.createDataFrame(slots, "id long, slot string, value string")


def gaps(spark, rows, slots, contract):
    objects, s = tables(spark, rows, slots)
    fields = handoff.contract_fields(spark, [c for c in fixed.CONTRACTS if c[0] == contract])
    found = handoff.validate(objects, s, fields).collect()
    return sorted((r.slot or "", r.outcome, float(r.severity), r.band, r.inherited, r.upstream_id, r.downstream_id) for r in found)


SALES = (1, "acme:sso", "sales", "requirement", 4, "active", "customer", 0)
PRODUCT = (2, "acme:sso", "product", "requirement", 3, "active", "product", 2)
OWN = [(1, "protocol", "SAML"), (1, "idp", "Okta"), (1, "priority", "P0"), (1, "due_date", "2026-12-15"), (1, "due_date_precision", "day"), (2, "priority", "P0"), (2, "due_date", "2026-12-01"), (2, "due_date_precision", "month")]


def test_sales_to_product(spark):
    assert gaps(spark, [SALES, PRODUCT], OWN, "sales_to_product") == [
        ("due_date", "generalized", 1.8, "medium", False, 1, 2), ("idp", "missing", 2.7, "high", False, 1, 2), ("protocol", "generalized", 1.8, "medium", False, 1, 2),
    ]


def test_product_to_engineering_inherits(spark):
    rows = [SALES, PRODUCT, (3, "acme:sso", "engineering", "requirement", 3, "active", "engineering", 5)]
    slots = [x for x in OWN if x[:2] not in ((1, "due_date"), (1, "due_date_precision"))] + [(3, "priority", "P0")]
    assert gaps(spark, rows, slots, "product_to_engineering") == [
        ("acceptance_criteria", "missing", 1.44, "medium", False, None, 3), ("due_date", "missing", 2.16, "high", False, 2, 3),
        ("idp", "missing", 2.7, "high", True, 1, 3), ("protocol", "generalized", 1.8, "medium", True, 1, 3),
    ]


def test_sales_to_customer_success(spark):
    rows = [
        (1, "globex:data_residency", "sales", "requirement", 4, "conflicting", "customer", 0), (2, "globex:data_residency", "sales", "requirement", 2, "conflicting", "sales", 1),
        (3, "globex:seats", "sales", "requirement", 4, "conflicting", "customer", 0), (4, "globex:seats", "sales", "requirement", 2, "conflicting", "sales", 1),
        (5, "globex:integration", "sales", "requirement", 4, "active", "customer", 0), (6, "globex:onboarding", "sales", "requirement", 4, "active", "customer", 0),
        (7, "globex:data_residency", "customer_success", "requirement", 3, "active", "other", 3), (8, "globex:seats", "customer_success", "requirement", 3, "active", "other", 3),
        (9, "globex:onboarding", "customer_success", "requirement", 3, "active", "other", 3),
    ]
    slots = [(1, "region", "eu-west-1"), (2, "region", "us-east-1"), (3, "quantity", "500"), (4, "quantity", "50"), (5, "integrations", '["Salesforce"]'), (6, "due_date", "2027-01-10"), (6, "due_date_precision", "day"), (7, "region", "us-east-1"), (8, "quantity", "50"), (9, "due_date_precision", "quarter")]
    found = gaps(spark, rows, slots, "sales_to_customer_success")
    assert [(s, o) for s, o, *_ in found] == [("", "object_missing"), ("due_date", "generalized"), ("quantity", "contradicted"), ("region", "contradicted")]
    assert found[3][2:4] == (3.0, "high") and found[3][5] == 1


def test_incident(spark):
    key = "acme:incident:INC-2311"
    rows = [
        (1, key, "engineering", "problem", 3, "superseded", "engineering", 0), (2, key, "engineering", "problem", 3, "active", "engineering", 1),
        (3, key, "engineering", "resolution", 3, "active", "engineering", 2), (4, key, "sales", "problem", 3, "active", "sales", 3),
    ]
    slots = [(1, "root_cause", "our bad deploy"), (2, "root_cause", "ELB degradation"), (2, "impact", '{"data_loss":"some"}'), (2, "time_window", '{"start":"a"}'), (2, "sla_impact", '{"breached":true}'), (3, "remediation", "x"), (4, "root_cause", "our bad deploy"), (4, "impact", '{"data_loss":"none"}')]
    found = gaps(spark, rows, slots, "engineering_to_customer_facing::sales")
    assert [(s, o) for s, o, *_ in found] == [("", "object_missing"), ("impact", "contradicted"), ("root_cause", "stale_reference"), ("sla_impact", "missing"), ("time_window", "missing")]


def test_equivalent_values_make_no_gap(spark):
    assert gaps(spark, [SALES, PRODUCT], [(1, "protocol", "SAML 2.0"), (2, "protocol", "saml ")], "sales_to_product") == []


def test_evidence_link(spark):
    found = gaps(spark, [(2, "acme:audit", "product", "requirement", 3, "active", "product", 2)], [(2, "idp", "x")], "sales_to_product")
    assert found == [("", "missing", 1.44, "medium", False, None, 2)]


def test_chains_and_summary(spark):
    rows = [SALES, PRODUCT, (3, "acme:sso", "engineering", "requirement", 3, "active", "engineering", 5)]
    objects, slots = tables(spark, rows, OWN)
    edges = lineage.edges(objects)
    assert sorted(map(tuple, edges.collect())) == [(2, 1), (3, 2)]
    up = lineage.upstream_chain(edges, spark.createDataFrame([(3,)], "id long"))
    assert sorted((r.node, r.depth) for r in up.collect()) == [(1, 2), (2, 1), (3, 0)]
    found = handoff.validate(objects, slots, handoff.contract_fields(spark))
    total = handoff.summary(found).groupBy().sum("total", "inherited", "origin").first()
    assert total[0] == found.count() == total[1] + total[2]
    said = handoff.explain(found, objects.withColumn("content", F.concat(F.lit("said "), F.col("id"))))
    assert said.where("explanation IS NULL").count() == 0
    lost = [r.explanation for r in said.where("slot = 'idp' AND upstream_id = 1 AND contract = 'sales_to_product'").collect()]
    assert all(t.startswith('**Dependency loss (dropped)** — upstream requirement "said 1" (') and "specifies `idp = " in t and t.endswith("requires this slot to survive.") for t in lost)


def test_lists_and_objects(spark):
    """Order, case and blanks in a list or an object don't count; of a nested slot one key stands for it."""
    for slot, contract, kind in (("integrations", "sales_to_customer_success", "requirement"),):
        rows = [(1, "acme:sso", "sales", kind, 3, "active", "sales", 1), (2, "acme:sso", "customer_success", kind, 3, "active", "other", 2)]
        assert gaps(spark, rows, [(1, slot, '["Okta","Jira"]'), (2, slot, '["jira", " okta "]')], contract) == []
        assert [o for _, o, *_ in gaps(spark, rows, [(1, slot, '["Okta","Jira"]'), (2, slot, '["jira"]')], contract)] == ["contradicted"]
    rows = [(1, "acme:incident:X", "engineering", "problem", 3, "active", "engineering", 1), (2, "acme:incident:X", "sales", "problem", 3, "active", "sales", 2)]
    same = [(1, "impact", '{"data_loss":"None","n":"1"}'), (2, "impact", '{"n":"2","data_loss":" none"}')]
    assert gaps(spark, rows, same, "engineering_to_customer_facing::sales") == []
    assert [o for _, o, *_ in gaps(spark, rows, [same[0], (2, "impact", '{"data_loss":"some"}')], "engineering_to_customer_facing::sales")] == ["contradicted"]


@pytest.mark.parametrize("slot", ["region", "protocol"])
def test_empty_tables(spark, slot):
    objects, slots = tables(spark, [], [(1, slot, "x")])
    assert handoff.validate(objects, slots, handoff.contract_fields(spark)).count() == 0


def test_statements_are_not_dealt_by_stage(spark, capsys):
    # Five stages would be five tasks, however many statements there are.
    objects, slots = tables(spark, [SALES, PRODUCT], OWN)
    fields = handoff.contract_fields(spark)
    known = handoff.packed(objects, slots, handoff.slot_names(fields))
    for found in (handoff.reference_picks(known, fields), handoff.counterpart_picks(known, fields), handoff.present_gaps(known, lineage.edges(objects), fields)):
        found.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin [from_stage" in plan or "BroadcastHashJoin [to_stage" in plan
        assert "hashpartitioning(from_stage" not in plan and "hashpartitioning(to_stage" not in plan


def test_values_of_the_row_are_the_slots(spark):
    rows = derived.objects(spark, "/root/testdata/sf0.001")
    wide, long = derived.with_values(rows), derived.slots_long(rows)
    told = {(r.id, s, v) for r in wide.select("id", "values").collect() for s, v in r["values"].asDict().items() if v is not None}
    sql = spark.sql(derived.SLOTS.replace("{", "{{").replace("}", "}}").replace("FROM obj", "FROM {obj}"), obj=rows)
    assert told == set(map(tuple, long.collect())) == set(map(tuple, sql.collect())) and long.count() == sql.count()
    fields = handoff.contract_fields(spark)
    found = [sorted(map(str, handoff.validate(o, s, fields).collect())) for o, s in ((wide, None), (rows, long))]
    assert found[0] == found[1] and len(found[0]) > 20


def test_the_greatest_of_a_slot_counts(spark):
    objects, slots = tables(spark, [SALES, PRODUCT], [(1, "idp", "a"), (1, "idp", None), (1, "idp", "b"), (1, "plan", None), (2, "other", "x"), (None, "idp", "z"), (1, None, "y")])
    got = {r.id: r["values"].asDict() for r in handoff.packed(objects, slots, ["idp", "plan", "due_date_precision"]).collect()}
    none = {"idp": None, "plan": None, "due_date_precision": None}
    assert got == {1: none | {"idp": "b"}, 2: none}
